"""Ranks, moments, percentiles, matrices and tests against plain Python and closed forms."""

import itertools
import math
import random
import statistics as plain

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqloom.functions import numeric
from seqloom.operators import ranks as rk
from seqloom.operators import statistics as st

NAN, INF = float("nan"), float("inf")


def mean_ranks(values):
    return [sum(v < x for v in values) + (sum(v == x for v in values) - 1) / 2 for x in values]


@pytest.fixture(scope="module")
def groups(spark):
    rng = random.Random(6)
    rows = [("hot", 5.0)] * 900 + [(rng.choice("ab"), float(rng.randint(0, 50))) for _ in range(500)] + [("one", 3.0), (None, 1.0), (None, 2.0), (None, 1.0), ("a", None), ("b", NAN), ("gone", None)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, g string, x double").repartition(5)


def own(rows, g):
    return [x for h, x in rows if h == g and x is not None and not math.isnan(x)]


def test_ranks_of_a_table(spark, groups):
    rows, df = groups
    values = [INF if x is not None and math.isnan(x) else x for _, x in rows]
    want = dict(zip([x for x in values if x is not None], mean_ranks([x for x in values if x is not None])))
    got = rk.ranks(df, "x").collect()
    assert len(got) == len(rows) and all(r["rank"] == (None if values[r.id] is None else want[values[r.id]]) for r in got)


def test_ranks_of_groups(spark, groups, monkeypatch):
    rows, df = groups
    monkeypatch.setattr(rk, "HOT_ROWS", 100)
    got = rk.ranks(df.where("not isnan(x) or x is null"), "x", ["g"], name="X_rank", centered=True).collect()
    for g in ("hot", "a", "b", "one", None):
        values = own(rows, g)
        want = dict(zip(values, mean_ranks(values)))
        assert all(r.X_rank == want[r.x] - (len(values) - 1) / 2 for r in got if r.g == g and r.x is not None)
    assert {r.X_rank for r in got if r.x is None} == {None}
    assert rk.ranks(df.limit(0), "x").count() == 0 and rk.ranks(df.limit(0), "x", ["g"], centered=True).count() == 0


def test_no_window_without_a_partition(spark, groups, capsys):
    rk.ranks(groups[1], "x").explain()
    assert "SinglePartition" not in capsys.readouterr().out


def test_row_ranks(spark):
    df = spark.createDataFrame([(1, [3.0, 1.0, 3.0, None]), (2, []), (3, None)], "id int, v array<double>")
    plain_, centered = (dict(df.select("id", rk.row_ranks(F.col("v"), c)).collect()) for c in (False, True))
    assert plain_ == {1: [1.5, 0.0, 1.5, None], 2: [], 3: None} and centered[1] == [0.5, -1.0, 0.5, None]


def test_moments(groups):
    rows, df = groups
    got = {r.g: r for r in st.moments(df, "x", ["g"]).collect()}
    assert set(got) == {"hot", "a", "b", "one", None}
    for g, r in got.items():
        x = np.array(own(rows, g))
        sd = x.std(ddof=1) if len(x) > 1 else 0.0
        z = (x - x.mean()) / sd if sd else np.zeros(1)
        want = [len(x), x.mean(), sd**2, (z**3).mean(), (z**4).mean() - 3 if sd else 0.0, np.abs(x - x.mean()).mean()]
        assert np.allclose([r.n, r["mean"], r.variance, r.skewness, r.kurtosis, r.deviation], want)
    whole = st.moments(df, "x").collect()
    assert len(whole) == 1 and whole[0].n == 1404 and st.moments(df.limit(0), "x").count() == 0


@pytest.mark.parametrize("most", [4096, 3])
def test_percentiles(groups, most):
    """Few values are sorted at once; with 3 at most, the selection has to narrow."""
    rows, df = groups
    shares = [0.0, 0.3, 0.5, 0.77, 1.0]
    got = {(r.g, r.share): r.x for r in st.percentiles(df, "x", shares, ["g"], most=most).collect()}
    want = {(g, s): np.quantile(own(rows, g), s) for g in ("hot", "a", "b", "one", None) for s in shares}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_percentiles_of_wild_values(spark):
    rng = random.Random(9)
    x = [rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300) for _ in range(3000)] + [0.0] * 500 + [1e-320]
    df = spark.createDataFrame([(v,) for v in x], "x double").repartition(4)
    got = {r.share: r.x for r in st.percentiles(df, "x", [0.001, 0.25, 0.45, 0.5, 0.9], most=10).collect()}
    assert all(got[s] == pytest.approx(np.quantile(x, s), rel=1e-9, abs=0) for s in got) and len(got) == 5
    assert st.median(df, "x").first()[0] == plain.median(x) and st.median(df.limit(0), "x").count() == 0


def test_rows_of_a_group_do_not_move_to_its_row(spark, groups, monkeypatch, capsys):
    """Groups that hold a great share of all rows would fill one task."""
    rows, df = groups
    right = spark.createDataFrame([("hot", 1), ("a", 2), (None, 3)], "g string, y int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        st.beside(df, right, ["g"]).explain()
        assert "Exchange hashpartitioning" not in capsys.readouterr().out
        want = {r.g: r for r in st.moments(df, "x", ["g"]).collect()}
        # many groups: the great ones go to all tasks, the others meet in a join
        monkeypatch.setattr(st, "FEW", 3)
        sizes = st.finite(df, "x").groupBy("g").agg(F.count("*").alias("n"))
        hot = st.large(sizes, ["g"])
        assert {r["g_of_"] for r in hot.collect()} == {"hot"}
        got = {r.g: r for r in st.moments(df, "x", ["g"]).collect()}
        assert set(got) == set(want) == {"hot", "a", "b", "one", None}
        assert all(got[g][1:] == pytest.approx(want[g][1:]) for g in want)
        met = [(r.g, r.y) for r in st.beside(df, right, ["g"], hot).collect()]
        of = {"hot": 1, "a": 2, None: 3}
        assert sorted(map(repr, met)) == sorted(repr((g, of[g])) for g, _ in rows if g in of)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_percentiles_leave_the_values_where_they_are(spark, monkeypatch):
    """Many groups, one of them great, several rounds: what is known of the great one goes to its values, every time."""
    rng = random.Random(3)
    values = [("great", rng.choice([7.0, rng.uniform(-9, 9)])) for _ in range(3000)] + [(f"g{i % 40}", float(rng.randint(0, 9))) for i in range(400)]
    df = spark.createDataFrame(values, "g string, x double").repartition(6)
    monkeypatch.setattr(st, "FEW", 3)
    sides, beside = [], st.beside
    monkeypatch.setattr(st, "beside", lambda rows, right, by, hot=None: sides.append(hot) or beside(rows, right, by, hot))
    shares = (0.0, 0.3, 0.5, 0.99, 1.0)
    got = {(r.g, r.share): r.x for r in st.percentiles(df, "x", shares, ["g"], most=20).collect()}
    for g in {g for g, _ in values}:
        own_values = [x for h, x in values if h == g]
        assert [got[g, s] for s in shares] == pytest.approx(list(np.quantile(own_values, shares)))
    assert len(got) == 5 * 41 and len(sides) >= 3
    assert all(hot is sides[0] for hot in sides) and [r["g_of_"] for r in sides[0].collect()] == ["great"]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (300, 5)).astype(float) + 1e6
    x[:, 2] = x[:, 0] * 2 - x[:, 1]
    x[:, 4] = 7.0
    rows = [(v.tolist(),) for v in x] + [(None,), ([1.0, None, 1.0, 1.0, 1.0],), ([NAN] * 5,)]
    return x, spark.createDataFrame(rows, "v array<double>").repartition(6)


def square(df, c, shape):
    out = np.full(shape, NAN)
    for r in df.collect():
        out[r.i, r.j] = r[c]
    return out


def test_matrices(vectors):
    x, df = vectors
    found = st.correlation_matrix(df, "v")
    assert np.allclose(square(found, "covariance", (5, 5)), np.cov(x.T), atol=1e-8)
    assert np.allclose(square(found, "correlation", (5, 5))[:4, :4], np.corrcoef(x[:, :4].T)) and square(found, "correlation", (5, 5))[4].tolist() == [0.0] * 5
    cross = st.correlation_matrix(df, "v", first=2)
    assert np.allclose(square(cross, "covariance", (2, 3)), np.cov(x.T)[:2, 2:], atol=1e-8)
    ordered = np.array([mean_ranks(list(c)) for c in x.T])
    assert np.allclose(square(st.rank_correlation_matrix(df, "v"), "correlation", (5, 5))[:4, :4], np.corrcoef(ordered[:4]))
    assert st.correlation_matrix(df.limit(0), "v").count() == 0
    n, mean, cross_ = st.cross_products(df, "v", fan=2)
    assert n == 300 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cross_, (x - x.mean(0)).T @ (x - x.mean(0)))


# tests of samples


def samples(spark, *named):
    return spark.createDataFrame([(g, f, float(v)) for g, f, xs in named for v in xs], "g string, f boolean, x double")


def test_rank_sums_against_all_splits(spark):
    x, y = [1.1, 5.2, 3.3, 8.0, 9.1, 7.7], [2.0, 2.5, 0.3, 4.4, 3.3, 1.0, 0.1]
    df = samples(spark, ("a", True, x), ("a", False, y), ("b", True, y), ("b", False, x), ("flat", True, [1, 1]), ("flat", False, [1, 1]))
    got = {r.g: r for r in st.rank_sum_test(df, "x", F.col("f"), ["g"]).collect()}
    u = sum((a > b) + (a == b) / 2 for a in x for b in y)
    assert (got["a"].n, got["a"].m, got["a"].u) == (6, 7, u) and got["b"].u == 42 - u
    both, count = x + y, 0
    order = mean_ranks(both)
    splits = list(itertools.combinations(range(13), 6))
    for s in splits:
        count += sum(order[i] for i in s) - 15 >= u
    assert got["a"].right == pytest.approx(count / len(splits), abs=0.01) and got["a"].right < 0.05 < got["b"].right
    assert got["a"].right == pytest.approx(got["b"].left) and got["a"].both == pytest.approx(2 * got["a"].right)
    assert got["flat"].z == 0 and got["flat"].both == 1


def test_signed_ranks_against_all_signs(spark):
    x = [1.5, -0.5, 2.5, 3.0, 4.0, -1.0, 5.5, 6.0, 0.0, 2.5]
    got = st.signed_rank_test(samples(spark, ("a", True, x)), "x").first()
    gaps = [v for v in x if v]
    order = [r + 1 for r in mean_ranks([abs(v) for v in gaps])]
    w = sum(r for r, v in zip(order, gaps) if v > 0)
    share = np.mean([sum(r for r, s in zip(order, signs) if s) >= w for signs in itertools.product((0, 1), repeat=9)])
    assert (got.n, got.w) == (9, w) and got.right == pytest.approx(share, abs=0.01)


def test_sign_test_is_exact(spark):
    got = st.sign_test(samples(spark, ("a", True, [1] * 7 + [-1] * 3 + [0] * 4)), "x").first()
    tail = lambda k: sum(math.comb(10, i) for i in range(k, 11)) / 1024
    assert (got.n, got.above) == (10, 7) and got.right == pytest.approx(tail(7)) and got.left == pytest.approx(1 - tail(8)) and got.both == pytest.approx(2 * tail(7))
    assert st.sign_test(samples(spark, ("a", True, [0])), "x").count() == 0


def test_variance_mean_and_shape_tests(spark):
    x, y = [2.0, 4.0, 4.0, 5.0, 9.0], [1.0, 2.0, 3.0]
    df = samples(spark, ("a", True, x), ("a", False, y), ("short", True, [1.0]), ("short", False, y))
    vx, vy = plain.variance(x), plain.variance(y)
    f = st.variance_ratio_test(df, "x", F.col("f"), ["g"]).collect()
    assert len(f) == 1 and f[0].f == pytest.approx(vx / vy)
    # with two degrees of freedom in the denominator the tail is closed: 1 - (1 + 2 / (4 f)) ** -2
    assert f[0].left == pytest.approx((1 + 2 / (4 * f[0].f)) ** -2)
    welch, pooled = st.mean_test(df, "x", F.col("f"), ["g"]).first(), st.mean_test(df, "x", F.col("f"), ["g"], equal_variances=True).first()
    assert welch.t == pytest.approx((4.8 - 2) / math.sqrt(vx / 5 + vy / 3)) and pooled.df == 6
    assert pooled.left + pooled.right == pytest.approx(1) and pooled.both == pytest.approx(2 * pooled.right)
    chi = st.variance_test(samples(spark, ("a", True, y)), "x", 2.0).first()
    assert chi.chi2 == pytest.approx(1.0) and chi.left == pytest.approx(1 - math.exp(-0.5))  # two degrees of freedom
    jb = st.normality_test(samples(spark, ("a", True, [0.0, 0.0, 0.0, 1.0] * 50)), "x").first()
    assert jb.jb == pytest.approx(200 / 6 * ((4 / 3) + (7 / 3 - 3) ** 2 / 4)) and jb.p == pytest.approx(math.exp(-jb.jb / 2))
    assert tuple(st.normality_test(samples(spark, ("a", True, [1.0] * 5)), "x").first())[1:] == (0.0, 1.0)


def test_correlation_significance(spark):
    df = spark.createDataFrame([(0.0, 10), (0.5, 4), (1.0, 5), (-1.0, 5), (0.3, 2)], "r double, n long")
    got = [tuple(r)[2:] for r in st.correlation_significance(df, "r", "n").collect()]
    assert got[0] == (0.0, 1.0, 0.5, 0.5)
    t = 0.5 * math.sqrt(2 / 0.75)  # two degrees of freedom: a closed tail
    assert got[1][0] == pytest.approx(t) and got[1][3] == pytest.approx(0.5 - t / (2 * math.sqrt(2 + t * t)))
    assert got[2][3] == pytest.approx(0) and got[3][2] == pytest.approx(0) and got[4][0] is None and got[4][1] is None


def test_tails_against_closed_forms():
    for a, x in ((1.0, 2.5), (0.5, 0.7), (3.0, 20.0), (50.0, 48.0), (400.0, 430.0)):
        if a == int(a):
            want = 1 - sum(math.exp(-x + i * math.log(x) - math.lgamma(i + 1)) for i in range(int(a)))
        else:
            want = math.erf(math.sqrt(x))
        assert numeric.incomplete_gamma(np.array([a]), np.array([x]))[0] == pytest.approx(want, rel=1e-10)
    z = numeric.normal_cdf.func(pd.Series([0.0, 1.959963984540054, None]))
    assert z[0] == 0.5 and z[1] == pytest.approx(0.975) and z[2] is None
    assert numeric.incomplete_gamma(np.array([2.0]), np.array([0.0]))[0] == 0


def test_running_sums_of_ranges(spark):
    df = spark.createDataFrame([(g, i, (i * 7) % 5) for g in ("a", None) for i in range(400)], "g string, i int, x int").repartition(4)
    got = {(r.g, r.i): (r.total, r.n) for r in rk.running_sums(df, ["g"], "i", {"total": F.col("x"), "n": F.lit(1)}).collect()}
    totals = np.cumsum([(i * 7) % 5 for i in range(400)])
    assert got == {(g, i): (totals[i], i + 1) for g in ("a", None) for i in range(400)}
