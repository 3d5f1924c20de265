import math
import random
import time

from sitelens.llm import neighbours as N


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "chunk_no bigint, vector array<float>, vec_id string, members int")
    got = N.nearest(df, "chunk_no", "vector", dims=8, **kw).collect()
    return {(r.chunk_no, r.neighbour, r.similarity, r["rank"]) for r in got}


def want(rows, k=5):
    import numpy as np

    b = N.brute_force([r[0] for r in rows], [None if r[1] is None else [None if x is None else float(np.float32(x)) for x in r[1]] for r in rows], k=k, dims=8)
    return {(int(i), int(j), float(s), int(n)) for i, j, s, n in b.itertuples(index=False, name=None)}


def test_against_brute_force(spark):
    rnd = random.Random(2)
    base = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    rows = [(i, rnd.choice(base) if rnd.random() < 0.5 else [rnd.gauss(0, 1) for _ in range(8)], "x", 1) for i in range(300)]
    rows += [(900, [250 * x for x in base[0]], "x", 1), (901, [0.01 * x for x in base[0]], "x", 1)]
    rows += [(902, None, "x", 1), (903, [], "x", 1), (904, [0.0] * 8, "x", 1), (905, [math.nan] + [1.0] * 7, "x", 1), (906, [None] + [1.0] * 7, "x", 1), (907, [math.inf] + [1.0] * 7, "x", 1), (908, [1.0] * 7, "x", 1)]
    assert run(spark, rows, block_rows=50) == want(rows[:-7]) == run(spark, rows, block_rows=10_000, least_rows=10_000) == run(spark, rows)


def test_copies_ties_and_few_rows(spark):
    copies = [(i, [1.0, 2.0] + [0.0] * 6, None, None) for i in range(40)] + [(50, [2.0, 1.0] + [0.0] * 6, None, None)]
    assert run(spark, copies, block_rows=1) == want(copies)
    assert run(spark, copies[:1]) == set() and run(spark, []) == set() and run(spark, copies[:3]) == want(copies[:3])
    pairs = N.unordered_pairs(N.nearest(spark.createDataFrame(copies[:3], "chunk_no bigint, vector array<float>, a string, b string"), "chunk_no", "vector", dims=8), "chunk_no")
    assert {(r.a, r.b) for r in pairs.collect()} == {(0, 1), (0, 2), (1, 2)}


def shuffled(spark):
    """Bytes that tasks have written for shuffles so far."""
    time.sleep(0.5)
    spark.range(1).collect()  # the store takes figures in with the next task
    time.sleep(0.5)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_shuffles_grow_with_the_rows_only(spark):
    rnd = random.Random(5)
    n, dims = 600, 256
    df = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(dims)]) for i in range(n)], "chunk_no bigint, vector array<float>")
    written, found = [], []
    for block_rows in (n, n // 20):
        before = shuffled(spark)
        found.append({tuple(r) for r in N.nearest(df, "chunk_no", "vector", dims=dims, block_rows=block_rows, least_rows=1).collect()})
        written.append(shuffled(spark) - before)
    assert found[0] == found[1] and len(found[0]) == 5 * n
    assert 0 < written[1] < 1.2 * written[0]  # a row isn't sent to each of 20 blocks
    assert written[0] < 2 * n * dims * 4  # nor are vectors sent for each pair, or answers for each salt


def test_copies_around_k(spark):
    rows, no = [], 0
    for copies in (1, 2, 5, 6, 7, 8, 30):  # up to k + 1 copies get their answers without a join
        rows += [(no := no + 1, [1.0, float(copies)] + [0.0] * 6, "x", 1) for _ in range(copies)]
    assert run(spark, rows) == want(rows) == run(spark, rows, block_rows=2, least_rows=1)
    twice = [(1, [1.0, 2.0] + [0.0] * 6, "x", 1)] * 2 + [(2, [2.0, 1.0] + [0.0] * 6, "x", 1)]
    df = spark.createDataFrame(twice, "chunk_no bigint, vector array<float>, vec_id string, members int")
    assert sorted((r.chunk_no, r.neighbour) for r in N.nearest(df, "chunk_no", "vector", dims=8).collect()) == [(1, 2), (1, 2), (2, 1)]
