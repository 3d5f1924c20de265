import datetime as dt
import random

import numpy as np
import pytest

from sitelens.operators import orphans as O

REFS = "src_table string, src_key bigint, src_item string, ref_key string, key string, t timestamp"
PARENTS = "key string, live_from timestamp, live_to timestamp"
DAY = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)


def brute(refs, parents):
    out = set()
    for s, k, i, r, key, t in refs:
        if r and not any(p == key and key is not None and t is not None and a is not None and a <= t and (b is None or t < b) for p, a, b in parents):
            out.add((s, k, i, r))
    return out


def run(spark, refs, parents):
    got = O.orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)).collect()
    assert len(got) == len({(r.src_table, r.src_key, r.src_item, r.ref_key) for r in got})
    return {(r.src_table, r.src_key, r.src_item, r.ref_key) for r in got}


def test_random_against_brute_force(spark):
    rnd = random.Random(5)
    keys = [f"k{i}" for i in range(30)]
    parents = [(rnd.choice(keys[:25]), DAY(a := rnd.randrange(200)), rnd.choice([None, DAY(a + rnd.randrange(90))])) for _ in range(40)]
    refs = [(rnd.choice("ab"), n, "", k := rnd.choice(keys + ["k1"] * 15), k, DAY(rnd.randrange(200))) for n in range(400)]
    assert run(spark, refs, parents) == brute(refs, parents)


def test_edges(spark):
    refs = [
        ("t", 1, "", "a", "a", DAY(31)), ("t", 1, "", "a", "a", DAY(31)), ("t", 2, "", "a", "a", DAY(59)), ("t", 3, "", "", "", DAY(3)), ("t", 4, "", None, None, DAY(3)),
        ("t", 5, "", "b", None, DAY(40)), ("t", 6, "", "a", "a", None), ("t", 7, "", "c", "c", DAY(40)),
    ]
    parents = [("a", DAY(31), DAY(59)), ("a", DAY(31), DAY(59)), ("c", None, None), (None, DAY(0), None)]
    assert run(spark, refs, parents) == brute(refs, parents) == {("t", k, "", r) for k, r in ((2, "a"), (5, "b"), (6, "a"), (7, "c"))}
    assert run(spark, refs, []) == {("t", k, "", r) for k, r in ((1, "a"), (2, "a"), (5, "b"), (6, "a"), (7, "c"))}
    assert run(spark, [], parents) == set()


@pytest.mark.parametrize("share", [0, 0.0005, 0.3, 0.999, 1])
def test_containers(share):
    flags = np.random.default_rng(1).random(O.RANGE_BITS) < share
    bits = np.packbits(flags, bitorder="little").tobytes()
    assert (O.unpack(O.pack(bits)) == flags).all() and len(O.pack(bits)) <= len(bits) + 1


def test_keys(spark):
    df = spark.createDataFrame([(" \tGeo:X ", "a"), (None, None)], "x string, y string")
    rows = df.select(O.normal_key("x").alias("x"), O.compound("x", "y").alias("c")).collect()
    assert rows[0].x == "geo:x" and rows[1].c is None


def test_a_long_life_is_one_span(spark):
    parents = spark.createDataFrame([("a", dt.datetime(1990, 1, 1), None), ("a", dt.datetime(1990, 1, 9), dt.datetime(2020, 1, 1)), ("b", dt.datetime(2020, 1, 2), dt.datetime(2020, 2, 20)), ("c", dt.datetime(2019, 6, 1), dt.datetime(2020, 3, 1))], PARENTS)
    month = lambda y, m: y * 12 + m - 1
    got = {tuple(r) for r in O.whole_months(parents, month(2020, 1), month(2020, 12)).collect()}
    assert got == {("a", month(2020, 1), month(2020, 12)), ("c", month(2020, 1), month(2020, 2))}


def test_hot_border_key(spark):
    refs = [("t", n, "", "k", "k", DAY(45) + dt.timedelta(seconds=n - 500)) for n in range(1000)]
    assert run(spark, refs, [("k", DAY(45), None)]) == {("t", n, "", "k") for n in range(500)}
