"""Krylov iterations and QR trees against dense solutions, and degenerate, badly scaled and empty systems."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import solvers

ENTRY, SIDE = "row long, col long, value double", "row long, value double"


def sparse(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], ENTRY)


def side(spark, b):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(b)], SIDE)


def values(solution, n):
    out = np.zeros(n)
    for r in solution.x.collect():
        out[r.col] = r.x
    return out


@pytest.fixture(scope="module")
def system():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(60, 6)) * (rng.random((60, 6)) < 0.5)
    a[:, 3] *= 1e4
    return a, rng.normal(size=60)


def test_lsqr_equals_dense_least_squares(spark, system):
    a, b = system
    got = solvers.lsqr(sparse(spark, a), side(spark, b))
    want, *_ = np.linalg.lstsq(a, b, rcond=None)
    assert np.allclose(values(got, 6), want, rtol=1e-6) and got.iterations <= 8 and got.reason == "gradient"
    assert got.residual == pytest.approx(np.linalg.norm(a @ want - b), rel=1e-8)


def test_lsqr_damped(spark, system):
    a, b = system
    a = np.where(np.arange(6) == 3, a / 1e4, a)
    want = np.linalg.solve(a.T @ a + 4 * np.eye(6), a.T @ b)
    assert np.allclose(values(solvers.lsqr(sparse(spark, a), side(spark, b), damp=2.0), 6), want, rtol=1e-6)


def test_lsqr_of_a_compatible_and_of_a_singular_system(spark):
    a = np.array([[1.0, 2.0], [3.0, 4.0], [0.0, 1.0]])
    exact = solvers.lsqr(sparse(spark, a), side(spark, a @ [5.0, -7.0]))
    assert exact.reason == "residual" and np.allclose(values(exact, 2), [5, -7])
    flat = np.array([[1.0, 1.0], [2.0, 2.0]])
    got = solvers.lsqr(sparse(spark, flat), side(spark, [1.0, 2.0]), scaled=False)
    assert np.allclose(values(got, 2), [0.5, 0.5])


def test_lsqr_of_odd_rows(spark):
    a = spark.createDataFrame([(1, 1, 1.0), (1, 1, 1.0), (2, 1, None), (None, 1, 5.0), (3, 2, 4.0)], ENTRY)
    b = spark.createDataFrame([(1, 4.0), (3, None), (9, 7.0), (None, 1.0)], SIDE)
    got = solvers.lsqr(a, b)
    assert np.allclose(values(got, 3)[1:], [2, 0]) and got.residual == pytest.approx(7)
    assert solvers.lsqr(a.limit(0), b).x.count() == 0
    assert {r.x for r in solvers.lsqr(a, b.limit(0)).x.collect()} == {0.0}


def test_conjugate_gradients(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(12, 12)) * (rng.random((12, 12)) < 0.4)
    a = m @ m.T + np.diag(rng.uniform(1, 100, 12))
    x = rng.normal(size=12)
    got = solvers.conjugate_gradients(sparse(spark, a), side(spark, a @ x))
    assert np.allclose(values(got, 12), x, atol=1e-7) and got.iterations <= 14 and got.reason == "residual"
    near = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "col long, x double")
    assert solvers.conjugate_gradients(sparse(spark, a), side(spark, a @ x), start=near, eps=1e-8).iterations == 0
    assert solvers.conjugate_gradients(sparse(spark, a), side(spark, a @ x), most=1).reason == "rounds"


def test_conjugate_gradients_refuses_other_matrices(spark):
    with pytest.raises(ValueError):
        solvers.conjugate_gradients(sparse(spark, np.array([[1.0, 9.0], [9.0, 1.0]])), side(spark, [1.0, -1.0]))
    with pytest.raises(ValueError):
        solvers.conjugate_gradients(sparse(spark, np.array([[-1.0]])), side(spark, [1.0]))


def test_matrix_does_not_move(spark, system, capsys):
    tables = solvers.Buckets(spark)
    a = tables.save(sparse(spark, system[0]), "row")
    u = tables.save(side(spark, system[1]), "row")
    joined = a.hint("merge").join(u, "row")
    joined.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    tables.forget()


def frame(spark, a, b):
    return spark.createDataFrame([(*map(float, r), float(y)) for r, y in zip(a, b)], ", ".join(f"c{i} double" for i in range(a.shape[1])) + ", y double").repartition(5)


def fitted(df, **options):
    return solvers.least_squares(df, [F.col(c) for c in df.columns[:-1]], F.col("y"), **options)


def test_tall_least_squares(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(400, 5))
    b = rng.normal(size=400)
    got, want = fitted(frame(spark, a, b)), np.linalg.lstsq(a, b, rcond=None)[0]
    assert np.allclose(got.coefficients, want) and got.rank == 5 and got.null_space.shape == (5, 0)
    assert got.residual == pytest.approx(np.linalg.norm(a @ want - b))
    r = solvers.qr_factor(frame(spark, a, b), [F.col(f"c{i}") for i in range(5)], fan=2)
    assert np.allclose(r.T @ r, a.T @ a)


def test_tall_least_squares_where_normal_equations_fail(spark):
    e = 1e-9
    a = np.array([[1, 1, 1], [e, 0, 0], [0, e, 0], [0, 0, e]])
    x = np.array([1.0, 2.0, 3.0])
    assert np.linalg.matrix_rank(a.T @ a) == 1
    assert np.allclose(fitted(frame(spark, a, a @ x)).coefficients, x, atol=1e-5)


def test_degenerate_and_empty_systems(spark):
    a = np.array([[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]])
    got = fitted(frame(spark, a, np.array([5.0, 10.0, 15.0])))
    assert got.rank == 1 and np.allclose(got.coefficients, [1, 2]) and np.allclose(a @ got.null_space, 0)
    df = frame(spark, a, np.zeros(3))
    assert fitted(df.limit(0)).rank == 0 and (fitted(df.limit(0)).coefficients == 0).all()
    odd = df.unionByName(spark.createDataFrame([(None, 1.0, 1.0), (float("nan"), 1.0, 1.0)], df.schema))
    assert np.allclose(fitted(odd).coefficients, 0)
