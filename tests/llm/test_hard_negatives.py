"""Hard negatives against a plain search of all pairs in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, block string, score string"


def usable(row):
    return row[0] is not None and row[2] is not None and row[1] is not None and all(x is not None and math.isfinite(x) for x in row[1])


def brute(rows):
    whole = lambda v: tuple(H._whole(x) for x in v)
    rows = [(r[0], whole(r[1]), r[2]) for r in rows if usable(r)]
    out = []
    for anchor in {r for r in rows if r[0] % 50 == 0}:
        scored = [(-sum(a * b for a, b in zip(anchor[1], r[1])), r[0], r[2]) for r in rows if len(r[1]) == len(anchor[1])]
        positives = sorted(s for s in scored if s[2] == anchor[2] and s[1] != anchor[0])[:5]
        for p, i, _ in positives:
            inside = sorted(s for s in scored if s[2] != anchor[2] and 50 * -p <= 100 * -s[0] <= 95 * -p)[:3]
            out += [(anchor[0], i, k, n, -p, -s) for k, (s, n, _) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA):
    rows = [(*r, "clash", None, "1") for r in rows]
    found = H.mine(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


@pytest.fixture
def cloud():
    random = np.random.default_rng(3)
    centers = random.normal(size=(6, 12))
    rows = []
    for i in range(420):
        v = centers[i % 6] * (i % 3 != 2) + random.normal(0, 0.4, 12)
        rows.append((i, v.tolist(), int(i % 4 if i % 3 else 0)))  # label 0 holds half of the rows
    return rows


def test_mined_as_by_brute_force(spark, cloud, monkeypatch):
    want = brute(cloud)
    assert len(want) > 50 and mined(spark, cloud) == want
    monkeypatch.setattr(H, "BLOCK_COMPONENTS", 400)
    monkeypatch.setattr(H, "SLICE", 4)
    assert mined(spark, cloud) == want


def test_nulls_copies_ties_and_strange_vectors(spark, cloud, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_COMPONENTS", 600)
    random.seed(1)
    odd = [
        (None, cloud[0][1], 0), (1000, None, 0), (1050, [1.0] * 11 + [None], 1), (1100, [1.0] * 11 + [float("nan")], 1),
        (1150, [float("inf")] * 12, 2), (1200, cloud[50][1], None), (1250, [], 1), (1251, [], 1), (1252, [], 2), (1300, [0.0] * 12, 0),
        (1350, [1.0, 2.0], 1), (1351, [1.0, 2.0], 1), (1352, [0.5, 1.5], 3), (1400, [-1.0] * 12, 9), (1401, [1.0] * 12, 9),
        cloud[100], cloud[100], (100, cloud[7][1], 3),
    ]
    copies = [(2000 + i, cloud[50][1], i % 3) for i in range(60)]
    tied = [(3000 + i, [float(random.randrange(3)) for _ in range(12)], i % 5) for i in range(120)]
    rows = cloud[:200] + odd + copies + tied
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(50, [1.0], 1)]) == []


def test_scores_beyond_doubles_are_exact(spark):
    random.seed(2)
    big = lambda: [random.choice([-1, 1]) * (random.randrange(1 << 22) + 0.3) for _ in range(8)]
    rows = [(i, big(), i % 2) for i in range(150)]
    rows += [(4000 + i, [x * (1 + i * 2.0**-30) for x in rows[50][1]], i % 2) for i in range(12)]
    assert mined(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="exceeds 64 bits"):
        mined(spark, [(50, [1e200], 1), (51, [1e200], 1), (52, [1.0], 2)])


def test_threshold_keeps_every_row_that_reaches_it(cloud):
    ids = np.array([r[0] for r in cloud])
    vectors = np.array([r[1] for r in cloud])
    block = H.Block(ids, vectors)
    assert any(len(a) < len(ids) for a in block.lists)  # covered suffixes are not listed
    whole = H.quantised(vectors)
    for at in (0, 17, 200):
        scores = (whole @ whole[at]).astype(np.int64)
        for least in (-math.inf, 0, np.sort(scores)[-30], np.sort(scores)[-3]):
            rows, got = block.at_least(vectors[at], least, np.arange(len(ids)))
            assert sorted(zip(block.ids[rows], got)) == sorted((i, s) for i, s in zip(ids, scores) if s >= least)
