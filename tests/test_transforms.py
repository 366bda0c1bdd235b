"""Convolution, correlation and Fourier transforms against numpy, in chunks and by every path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import transforms as tr


def frame(spark, **sequences):
    rows = [(g, i, float(v)) for g, x in sequences.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "g string, pos long, x double").repartition(4)


def line(rows, g, c="x", start=0):
    found = {r.pos: r[c] for r in rows if r.g == g}
    return np.array([found.get(i + start, 0.0) for i in range(max(found) - start + 1)])


@pytest.mark.parametrize(("width", "chunk"), [(5, 16), (5, 1000), (100, 64), (1, 7)])
def test_convolution_in_chunks(spark, width, chunk):
    rng = np.random.default_rng(width)
    a, b, kernel = rng.normal(size=300), rng.normal(size=9), rng.normal(size=width)
    got = tr.convolve(frame(spark, a=a, b=b), kernel.tolist(), ["g"], chunk=chunk).collect()
    assert len(got) == len({(r.g, r.pos) for r in got}) == 300 + 9 + 2 * (width - 1)
    assert np.allclose(line(got, "a"), np.convolve(a, kernel)) and np.allclose(line(got, "b"), np.convolve(b, kernel))


def test_correlation_finds_a_shifted_pattern(spark):
    rng = np.random.default_rng(0)
    x, pattern = rng.normal(size=200), rng.normal(size=20) * 5
    x[77:97] += pattern
    got = tr.correlate(frame(spark, a=x), pattern.tolist(), ["g"], chunk=32).collect()
    assert max(got, key=lambda r: r.x).pos == 77
    assert np.allclose(line(got, "a", start=-19), np.correlate(x, pattern, "full"))


def test_gaps_repeats_and_nulls(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (3, 1.0), (None, 4.0), (5, None), (-2, 1.0)], "pos long, x double")
    got = {r.pos: r.x for r in tr.convolve(df, [1.0, 10.0], chunk=4).collect()}
    assert {p: v for p, v in got.items() if v} == {-2: 1.0, -1: 10.0, 0: 2.0, 1: 20.0, 3: 1.0, 4: 10.0}
    assert tr.convolve(df.limit(0), [1.0]).count() == 0 and tr.convolve(df, []).count() == 0


@pytest.mark.parametrize(("n", "local"), [(12, 64), (1, 64), (360, 24), (101, 64), (97, 200), (128, 16)])
def test_fourier(spark, n, local):
    """Whole, by factors, and for a prime beyond what a task may hold by chirps."""
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=n), rng.normal(size=n)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "pos long, x double, y double")
    got = {r.pos: complex(r.re, r.im) for r in tr.fourier(rows, im="y", local=local).collect()}
    assert np.allclose([got[i] for i in range(n)], np.fft.fft(x + 1j * y)) and len(got) == n
    back = spark.createDataFrame([(i, v.real, v.imag) for i, v in got.items()], "pos long, x double, y double")
    again = {r.pos: complex(r.re, r.im) for r in tr.fourier(back, im="y", inverse=True, local=local).collect()}
    assert np.allclose([again[i] for i in range(n)], x + 1j * y)


def test_fourier_of_sequences_of_several_lengths(spark):
    rng = np.random.default_rng(8)
    sequences = {"a": rng.normal(size=60), "b": rng.normal(size=103), "c": np.ones(5)}
    got = tr.fourier(frame(spark, **sequences), ["g"], local=40).collect()
    for g, x in sequences.items():
        assert np.allclose(line(got, g, "re") + 1j * line(got, g, "im"), np.fft.fft(x))
    assert tr.fourier(frame(spark, a=[1.0]).limit(0), ["g"]).count() == 0


def test_power_at_a_period(spark):
    x = np.tile([2.0, 0.0, 1.0], 40)
    got = {r.g: r.power for r in tr.power_at(frame(spark, a=x, b=np.ones(120)), 3, ["g"]).collect()}
    assert got["a"] == pytest.approx(abs(np.fft.fft(x)[40]) ** 2) and got["b"] == pytest.approx(0, abs=1e-9)
