"""Splines over ranges against one dense solution, and their defining conditions."""

import numpy as np
import pytest

from seqloom.operators import splines as sp


def dense(x, y):
    """Second derivatives of the natural spline."""
    n, h = len(x), np.diff(x)
    a, r = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    return np.linalg.solve(a, r)


@pytest.mark.parametrize("cell_rows", [1000, 30, 3, 1])
def test_equal_to_one_dense_system(spark, cell_rows):
    rng = np.random.default_rng(4)
    x = np.sort(rng.uniform(-50, 50, 90))
    y = np.sin(x) * 5 + rng.normal(size=90)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(4)
    spline = sp.natural_spline(rows, cell_rows=cell_rows)
    pieces = sorted(spline.pieces.collect(), key=lambda r: r.x0)
    m = dense(x, y)
    assert np.allclose([r.x0 for r in pieces], x[:-1]) and np.allclose([2 * r.c for r in pieces], m[:-1], atol=1e-8)
    assert len(spline.starts) == 1 if cell_rows == 1000 else len(spline.starts) > 2
    end = pieces[-1]
    assert 2 * end.c + 6 * end.d * (end.x1 - end.x0) == pytest.approx(0, abs=1e-8)
    asked = spark.createDataFrame([(float(v),) for v in [*x, -60.0, 60.0]], "x double")
    got = {r.x: r for r in spline.at(asked).collect()}
    assert np.allclose([got[v].value for v in x], y) and np.allclose([got[v].curvature for v in x], m, atol=1e-7) and len(got) == 92
    area = sum((b - a) * (ya + yb) / 2 - (b - a) ** 3 * (ma + mb) / 24 for a, b, ya, yb, ma, mb in zip(x, x[1:], y, y[1:], m, m[1:]))
    assert spline.integral() == pytest.approx(area)


def test_few_and_odd_knots(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (0.0, 3.0), (2.0, 6.0), (None, 1.0), (1.0, None), (3.0, float("nan"))], "x double, y double")
    asked = spark.createDataFrame([(1.0, "a"), (1.0, "b"), (4.0, "c"), (None, "d")], "x double, name string")
    got = {r.name: (r.value, r.slope, r.curvature) for r in sp.natural_spline(rows).at(asked).collect()}
    assert got == {"a": (4.0, 2.0, 0.0), "b": (4.0, 2.0, 0.0), "c": (10.0, 2.0, 0.0), "d": (None, None, None)}
    none = sp.natural_spline(rows.where("x = 0"))
    assert none.integral() == 0 and {r.value for r in none.at(asked).collect()} == {None} and none.at(asked.limit(0)).count() == 0
