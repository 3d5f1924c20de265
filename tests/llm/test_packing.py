import math
import os
import random

import numpy as np
import pytest

from sitelens.llm import packing as P

pytestmark = pytest.mark.skipif(not os.path.exists(P.VOCABULARY), reason="no vocabulary here")


def test_pack_respects_all_limits():
    rnd = random.Random(4)
    tokens = np.array([rnd.randrange(1, 100) for _ in range(3000)])
    loss = np.array([rnd.randrange(0, t + 1) for t in tokens])
    for cap, seats, most in ((100, 64, 100), (100, 3, 100), (100, 64, 60)):
        ok = loss <= most
        no = P.pack(tokens[ok], loss[ok], cap, seats, most)
        for b in range(no.max() + 1):
            assert 0 < (no == b).sum() <= seats and tokens[ok][no == b].sum() <= cap and loss[ok][no == b].sum() <= most
    assert P.pack(tokens, loss, 100, 64, 100).max() + 1 <= math.ceil(tokens.sum() / 100) * 1.01


@pytest.mark.parametrize("limits, bound", [((100, 9, 100), 0), ((100, 3, 100), 1), ((100, 9, 70), 2)])
def test_each_limit_can_bind(limits, bound):
    tokens = np.array([20] * 500)
    no = P.pack(tokens, np.array([18] * 500), *limits)
    for b in range(no.max()):
        used = (tokens[no == b].sum() / limits[0], (no == b).sum() / limits[1], 18 * (no == b).sum() / limits[2])
        assert max(used) <= 1 and used[bound] + (0.2, 0, 18 / 70)[bound] >= 1 and max(used) == used[bound]


def test_numbers_are_unique_and_limits_hold(spark):
    rnd = random.Random(6)
    text = lambda n: "Start here. " + " ".join(rnd.choice(["page", "title", "crawl", "Seite"]) for _ in range(n))
    twice = text(900)
    rows = [(7, twice), (7, twice)] + [(i, text(rnd.choice([3, 30, 400, 505]))) for i in range(8, 200)]
    got = P.fill_containers(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", group_items=50).collect()
    fill = {}
    for r in got:
        fill.setdefault(r.container, []).append(r)
    assert sum(r.doc_id == 7 and r.tokens == 512 for r in got) == len({r.container for r in got if r.doc_id == 7 and r.tokens == 512}) == 2
    for c in fill.values():
        assert sum(r.tokens for r in c) <= P.CAPACITY and len(c) <= P.SEGMENTS and (len(c) == 1 or sum(r.loss for r in c) <= P.MOST_LOSS)
    assert max(len(c) for c in fill.values()) == P.SEGMENTS and any(len(c) == 1 and c[0].loss > P.MOST_LOSS and c[0].tokens < P.CAPACITY for c in fill.values())
    assert all(r.loss == r.tokens - 3 for r in got if r.part == 0) and all(r.loss == r.tokens for r in got if r.part)


def test_table(spark):
    rnd = random.Random(1)
    text = lambda n: " ".join(rnd.choice(["page", "title", "crawl", "Seite"]) for _ in range(n))
    rows = [(i, text(rnd.randrange(1, 200)), "x") for i in range(300)] + [(1000, text(5000), "x"), (1001, None, "x"), (1002, " \n​", "x"), (1003, text(50), None), (1003, text(50), None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tokens string")
    got = P.fill_containers(df, "doc_id", "text", group_items=100).collect()
    enc = P.encoder(P.VOCABULARY)
    assert {r.doc_id for r in got} == {*range(300), 1000, 1003}
    fill = {}
    for r in got:
        fill.setdefault(r.container, []).append(r)
    assert all(sum(r.tokens for r in c) <= 512 for c in fill.values())
    size = {k: len(enc.encode_ordinary(t)) for k, t, _ in rows if k in (5, 1000)}
    assert sum(r.tokens for r in got if r.doc_id == 1000) == size[1000] and sorted(r.part for r in got if r.doc_id == 1000) == list(range(math.ceil(size[1000] / 512)))
    assert [r.tokens for r in got if r.doc_id == 5] == [size[5]]
    assert P.fill_containers(df.where("false"), "doc_id", "text").count() == 0
