import random
import time

import numpy as np

from sitelens.llm import leaks as K

rnd = random.Random(3)
VOCAB = [f"w{i}" for i in range(400)]
PASSAGE = [rnd.choice(VOCAB) for _ in range(60)]
ZH = "在切换到新的网关以后条镜像路径中有返回了而不是预期的页面模板内容核查组比较了镜像环境"


def test_tiles():
    a, b = list("xxabcdefyyghijklzz"), list("ghijklabcdef")
    assert K.tiles(a, b, 4) == [(2, 6, 6), (10, 0, 6)]
    assert K.tiles(list("aaaaaaaa"), list("aaaa"), 3) == [(0, 0, 4)] and K.tiles([], list("abc"), 2) == []


def brute_tiles(a, b, least):
    """Greedy string tiling by comparing every pair of positions."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        i, j, n = best
        if n < least:
            return out
        free_a[i : i + n], free_b[j : j + n] = [False] * n, [False] * n
        out.append(best)


def test_tiles_against_brute_force():
    for letters in ("ab", "abc", "abcdefgh"):
        for _ in range(25):
            a, b = ([rnd.choice(letters) for _ in range(rnd.randrange(30))] for _ in "ab")
            got = K.tiles(a, b, 3)
            assert [n for _, _, n in got] == [n for _, _, n in brute_tiles(a, b, 3)] and all(a[i : i + n] == b[j : j + n] for i, j, n in got)


def test_repetitive_texts_take_linear_time():
    def took(n):
        t = time.perf_counter()
        K.tiles(["x"] * n, ["x"] * n, 6), K.tiles(["x", "y"] * n, ["y", "x"] * n, 6)
        return time.perf_counter() - t

    took(1000)
    assert took(80_000) < 16 * max(took(10_000), 0.01)


def test_rolling_hash_is_that_of_each_run():
    units = np.array([5, 7, 5, 7, 5, 9, 2**63], np.uint64)
    h = K.rolling(units, 2)
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 4 and h[4] == K.rolling(units[4:6], 2)[0] and len(K.rolling(units, 8)) == 0


def test_reordered_passage_is_found(spark):
    pieces = [PASSAGE[k : k + 8] for k in range(0, 56, 8)]
    shuffled = " ".join(w for k, p in enumerate(pieces[::-1]) for w in [f"between{k}", *p])
    few = " ".join(w for k, p in enumerate(pieces[:3]) for w in [*p, f"between{k}"])
    zh = "甲".join(ZH[k : k + 14] for k in (26, 13, 0))
    got = run(spark, [(1, shuffled, "x"), (2, few, "x"), (3, zh, "x")], [(1, "en", " ".join(PASSAGE), 0), (2, "zh", ZH, 0)])
    assert set(got) == {(1, 1), (3, 2)} and not got[1, 1].in_one_piece and got[1, 1].coverage == 56 / 60 and got[1, 1].tiles == 7


def test_widely_leaked_item(spark):
    docs = [(n, f"doc {n} " + " ".join(PASSAGE), "x") for n in range(500)]
    assert set(run(spark, docs, [(1, "en", " ".join(PASSAGE), 0)])) == {(n, 1) for n in range(500)}


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, hash string")
    i = spark.createDataFrame(items, "item_id bigint, lang string, passage string, key int")
    return {(r.doc_id, r.item_id): r for r in K.find_leaks(d, "doc_id", "text", i, "item_id", "lang", "passage").collect()}


def test_leaks(spark):
    noise = lambda n: " ".join(rnd.choice(VOCAB) for _ in range(n))
    text = " ".join(PASSAGE)
    docs = [
        (1, noise(50) + " " + text + " " + noise(20), "x"), (2, noise(30) + " " + " ".join(PASSAGE[20:32]) + " end", "x"), (3, "begin " + " ".join(PASSAGE[20:31]) + " end", "x"),
        (4, "**" + "** **".join(PASSAGE[5:25]).upper() + "**", "x"), (5, " ".join(PASSAGE[30:45]) + " stop " + " ".join(PASSAGE[:15]), "x"), (6, None, "x"), (7, "", "x"), (8, text, "x"), (8, text, "x"),
        (9, "前" + ZH[3:27] + "后", "x"), (10, "前" + ZH[3:26] + "后", "x"), (11, "，\n".join(ZH[3:30]) + "​", "x"), (12, noise(50_000) + " " + text, "x"), (13, "­".join(text), None),
    ]
    items = [(1, "en", text, 0), (2, "zh", ZH, 0), (3, "en", None, 0), (4, None, "too short", 0)]
    got = run(spark, docs, items)
    assert {k for k, r in got.items() if r.in_one_piece} == {(n, 1) for n in (1, 2, 4, 5, 8, 12, 13)} | {(9, 2), (11, 2)}
    assert {k for k, r in got.items() if not r.in_one_piece} == {(10, 2)} and got[10, 2].coverage >= K.COVERAGE  # one letter short of a full run, but over half of the passage
    assert got[1, 1].coverage == 1 and got[2, 1].longest == 12 and got[5, 1].tiles == 2 and got[5, 1].coverage == 0.5
    assert run(spark, [], items) == {} and run(spark, docs, []) == {}


def test_runs_stay_inside_their_text():
    h1, o1 = K.runs_of(["a b c d", "e f g"], 2, 3)
    h2, o2 = K.runs_of(["a b c d"], 2, 3)
    assert set(h2.tolist()) == {h for h, o in zip(h1.tolist(), o1.tolist()) if o == 0}
