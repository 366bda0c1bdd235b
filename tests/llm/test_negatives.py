"""Hard negatives against brute force, the bit-sliced products themselves, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import negatives as ng

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, near=5, far=5):
    rows = [(i, v, y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    out = []
    for i, v, y in rows:
        if i % 10:
            continue
        scored = sorted((-dot(v, w), j, z) for j, w, z in rows if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:near]:
            fits = [(t, n) for t, n, z in scored if z != y and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fits[:far])]
    return sorted(out)


def mined(df, **options):
    got = ng.mine_negatives(df, F.col("vec_id") % 10 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    made = [(i, [float(rng.randint(-30, 40)) for _ in range(rng.choice((6, 6, 6, 3)))], rng.randint(0, 3)) for i in range(240)]
    made += [(300 + i, made[10][1], i % 4) for i in range(30)]  # ties
    return made + [(400, None, 1), (410, [1.0, None], 1), (420, [1.0, float("nan")], 1), (430, [1.0], None), (None, [5.0] * 6, 2), (440, [], 1), (450, [2.0], 9), (461, [float(2**30), 3.0], 1)]


def test_equal_to_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert mined(df, shard_rows=37, tile=4) == brute(rows)
    assert mined(df, positives=2, negatives=1) == brute(rows, 2, 1)


def test_blocks_of_anchors(spark, rows):
    assert mined(spark.createDataFrame(rows, SCHEMA), block_rows=7) == brute(rows)


@pytest.mark.parametrize("size", [1, 100, 1 << 40])
def test_products_drop_only_what_cannot_count(size):
    rng = np.random.default_rng(size)
    x, q = rng.integers(-size, size + 1, (300, 5)).astype(float), rng.integers(-size, size + 1, (20, 5)).astype(float)
    planes = ng.Planes(ng.sliced(x), 300, 5)
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(r, c)) for c in x] for r in q], object)
    allowed = rng.random((20, 300)) < 0.9
    low, high = np.full(20, -(2**60)), np.full(20, 2**60)
    for k in (3, None):
        who, col, score = ng.products(q, planes, np.arange(300), low, high, allowed, k)
        assert all(int(s) == exact[w, c] for w, c, s in zip(who, col, score))
        for w in range(20):
            mine = sorted((int(s) for s in score[who == w]), reverse=True)
            want = sorted((exact[w, c] for c in range(300) if allowed[w, c] and low[w] <= exact[w, c] <= high[w]), reverse=True)
            assert mine == want if k is None else mine[:k] == want[:k]
        assert k is None or size == 1 or len(who) < 20 * 100


def test_nothing(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id % 10 <> 0")) == [] and mined(df.where("label is null")) == []
    one = spark.createDataFrame([(0, [1.0], 1), (0, [1.0], 1), (3, [1.0], 2)], SCHEMA)
    assert mined(one) == []


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(0, [2.0], 1, 5), (0, [3.0], 1, 5), (1, [4.0], 1, 5), (1, [4.0], 1, 5), (2, [4.0], 2, 5)], SCHEMA + ", place int")
    assert mined(df) == [(0, 1, 1, 2, 8, 8), (0, 1, 1, 2, 8, 8)]


def test_query(same_rows):
    same_rows(ng.query, ng.SQL)
