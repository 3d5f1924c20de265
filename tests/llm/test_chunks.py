import random

import numpy as np

from sitelens.llm import chunks as C

WORDS = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()


def prose(n, seed=1):
    rnd = random.Random(seed)
    out = []
    while sum(map(len, out)) < n:
        out.append(" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(4, 14))).capitalize() + ". " + ("\n\n" if rnd.random() < 0.2 else ""))
    return "".join(out)[:n]


def check(heading, content):
    ps = C.pieces(heading, content)
    heading, content = heading or "", content or ""
    lead = heading + "\n" if heading else ""
    assert all(len(t) <= C.LIMIT for _, _, t in ps)
    if len(lead) + C.OVERLAP + C.ROOM > C.LIMIT:
        lead, content = "", lead + content
    assert ps[0][0] == 0 and ps[-1][1] == len(content) and all(a[1] == b[0] for a, b in zip(ps, ps[1:]))  # nothing is lost or doubled
    for a, z, t in ps:
        assert t == lead + content[max(0, a - C.OVERLAP) : z] and z > a or len(ps) == 1
    return ps


def test_pieces():
    for n in (0, 10, 1189, 1200, 1300, 5000, 60_000):
        for h in (None, "", "Head", "x" * 500, "y" * 2000):
            check(h, prose(n))
    assert len(check("H", "a" * 1198)) == 1 and len(check("H", "a" * 1199)) > 1 and check(None, None) == [(0, 0, "")]


def test_ends_at_natural_boundaries():
    text = prose(20_000)
    for _, z, _ in check("H", text)[:-1]:
        assert text[z - 2 : z] in (". ", "\n\n")
    rows = "\n".join(f"| {i} | {'x' * 40} |" for i in range(200))
    assert all(rows[z - 1] == "\n" for _, z, _ in check("T", rows)[:-1])
    words = " ".join(["word"] * 3000)
    assert all(words[z - 1] == " " for _, z, _ in check("", words)[:-1])


def test_the_nearest_boundary_is_taken():
    text = prose(20_000, 5)
    marks = np.flatnonzero((C.rolling_hash(np.frombuffer(text.encode("utf-32-le"), "<u4")) & np.uint64(C._MASK)) == 0) + 1
    ends = np.unique(np.concatenate(C.boundaries(text)[:3]))
    most, start = 1000, 0
    for cut in C.cuts(text, most)[:-1]:
        low, high = start + most // 3, start + most
        inside = marks[(marks > low) & (marks <= high)]
        mark = inside[0] if len(inside) else (low + high) // 2
        near = ends[(ends >= low) & (ends <= high)]
        assert abs(cut - mark) == np.abs(near - mark).min()
        start = cut
    line = "these words go on and on in wrapped lines of prose\n"
    head = line * 10 + "and this sentence ends. "
    assert C.cuts(head + "But the next one " + line * 60, 1000)[0] == len(head)  # a wrapped line is no end, a sentence is


def test_written_characters_stay_whole():
    text = "é" * 3000
    assert all(text[z] != "́" for _, z, _ in check("H", text)[:-1])
    family = "\U0001f468‍\U0001f469‍\U0001f467" * 700
    assert all(family[z] not in "‍" and family[z - 1] != "‍" for _, z, _ in check("", family)[:-1])
    check("", "́" * 4000)  # one endless cluster


def test_an_edit_changes_only_neighbours():
    text = prose(40_000, 3)
    old = [text[a:z] for a, z, _ in C.pieces("H", text)]
    edited = text[:20_000] + "An inserted sentence of some length. " + text[20_000:]
    new = [edited[a:z] for a, z, _ in C.pieces("H", edited)]
    assert len(set(new) - set(old)) <= 6


def test_table(spark):
    rows = [(1, "h", prose(3000), "x"), (2, None, None, "x"), (3, "", prose(100), None), (3, "", prose(100), None), (4, None, prose(200_000), "x")]
    df = spark.createDataFrame(rows, "chunk_no bigint, heading string, content string, text string")
    got = C.split_oversized(df, "chunk_no").collect()
    assert {r.chunk_no for r in got if r.piece_count > 1} == {1, 4} and sum(r.chunk_no == 3 for r in got) == 2
    assert sorted(r.piece_no for r in got if r.chunk_no == 1) == list(range(1, max(r.piece_count for r in got if r.chunk_no == 1) + 1))
    assert [r.text for r in got if r.chunk_no == 2] == [""]
    assert C.split_oversized(df.where("false"), "chunk_no").count() == 0
