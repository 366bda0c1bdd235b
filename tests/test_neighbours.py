"""KD-tree search against all pairs: norms, ties, repeated points, radius, approximation, boxes looked at."""

import math
import random

import numpy as np
import pytest

from seqloom.operators import neighbours as nb

QUERY = "query_id long, vector array<double>"
POINT = "id long, vector array<double>"


def length(a, b, norm):
    gaps = [abs(x - y) for x, y in zip(a, b)]
    return max(gaps) if norm == 0 else sum(gaps) if norm == 1 else math.sqrt(sum(g * g for g in gaps))


@pytest.fixture(scope="module")
def cloud():
    rng = random.Random(1)
    points = [(i, [float(rng.randint(0, 60)), float(rng.randint(0, 60))]) for i in range(900)] + [(1000 + i, [7.0, 7.0]) for i in range(400)]
    queries = [(i, [rng.uniform(-5, 65), rng.uniform(-5, 65)]) for i in range(60)] + [(70, [7.0, 7.0]), (70, [7.0, 7.0]), (None, [30.0, 30.0])]
    return points, queries


def brute(points, query, k, norm, self_match=True):
    found = sorted((length(query, v, norm), i) for i, v in points)
    return [(d, i) for d, i in found if self_match or d > 0][:k]


@pytest.mark.parametrize("norm", [0, 1, 2])
def test_nearest_equals_all_pairs(spark, cloud, norm):
    points, queries = cloud
    tree = nb.build(spark.createDataFrame(points, POINT).repartition(3), norm=norm, box_rows=40, part_rows=64)
    got = {}
    for r in tree.nearest(spark.createDataFrame(queries, QUERY), 6, self_match=norm != 1).collect():
        got.setdefault(r.query_id, []).append((r.rank, round(r.distance, 9), r.id))
    for i, q in queries:
        want = [(n + 1, round(d, 9), j) for n, (d, j) in enumerate(brute(points, q, 6, norm, norm != 1))]
        assert sorted(got[i]) == (sorted(want * 2) if i == 70 else want)


def test_few_boxes_are_looked_at_and_large_ones_in_parts(spark, cloud):
    points, queries = cloud
    tree = nb.build(spark.createDataFrame(points, POINT), box_rows=40, part_rows=64)
    looked = [r.boxes for r in tree.nearest(spark.createDataFrame(queries[:60], QUERY), 3).collect()]
    assert len(tree.rows) > 20 and np.mean(looked) < len(tree.rows) / 3
    assert tree.rows.sum() == len(points) and tree.rows.max() >= 400  # coinciding points can't be split


def test_within_radius(spark, cloud):
    points, queries = cloud
    tree = nb.build(spark.createDataFrame(points, POINT), norm=2, box_rows=50)
    got = {}
    for r in tree.within(spark.createDataFrame(queries[:60], QUERY), 6.0).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    for i, q in queries[:60]:
        assert got.get(i, set()) == {j for j, v in points if length(q, v, 2) <= 6.0}


def test_approximate_distances(spark, cloud):
    points, queries = cloud
    tree = nb.build(spark.createDataFrame(points, POINT), box_rows=40)
    df = spark.createDataFrame(queries[:60], QUERY)
    rough, true = ({(r.query_id, r.rank): r for r in tree.nearest(df, 4, eps=eps).collect()} for eps in (1.0, 0.0))
    assert rough.keys() == true.keys()
    assert all(true[k].distance <= r.distance <= 2 * true[k].distance for k, r in rough.items())
    assert sum(r.boxes for r in rough.values()) < sum(r.boxes for r in true.values())


def test_odd_rows(spark):
    points = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (None, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [2.0]), (1, [0.0, 0.0])], POINT)
    queries = spark.createDataFrame([(1, [0.0, 0.0, 9.0]), (2, None), (3, [float("inf"), 0.0]), (4, [])], QUERY)
    got = sorted((r.query_id, r.rank, r.id, r.distance) for r in nb.build(points).nearest(queries, 5).collect())
    assert got == [(q, n + 1, i, d) for q in (1, 4) for n, (i, d) in enumerate([(1, 0.0), (1, 0.0), (5, 2.0)])]
    assert nb.build(points.limit(0)).nearest(queries, 2).count() == 0
    assert nb.build(points).nearest(queries.limit(0), 2).count() == 0
    assert nb.build(points).within(queries, 0.0).count() == 4
