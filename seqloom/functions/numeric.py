"""Numeric column builders, and the Student t distribution."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

VARIANCE_FLOOR = 1e-8
SCORE_FLOOR = 1e-5


def floored(variance: Column) -> Column:
    return F.when(variance <= 0, VARIANCE_FLOOR).otherwise(variance)


def log_density(x: Column, mean: Column, variance: Column) -> Column:
    """Natural logarithm of the normal density; variances of zero or less count as 1e-8."""
    v = floored(variance)
    return -0.5 * F.log(2 * math.pi * v) - (x - mean) * (x - mean) / (2 * v)


def log_sum_exp(x: Column, over: WindowSpec) -> Column:
    """Over a window, shifted by the true maximum."""
    most = F.max(x).over(over)
    return most + F.log(F.sum(F.exp(x - most)).over(over))


def softmax(x: Column, over: WindowSpec) -> Column:
    most = F.max(x).over(over)
    return F.exp(x - most) / F.sum(F.exp(x - most)).over(over)


def inverted_distance(score: Column, words: Column) -> Column:
    """Pair-difference score as a similarity: 1 / max(score, 1e-5) / sqrt(words)."""
    return 1.0 / F.greatest(score, F.lit(SCORE_FLOOR)) / F.sqrt(words)


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, rounds):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * c * d
    return out


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    gamma = np.vectorize(math.lgamma, otypes=[float])
    x = np.clip(x, 0.0, 1.0)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    direct = x < (a + 1) / (a + b + 2)
    low = front * beta_fraction(a, b, np.where(direct, inner, 0.0)) / a
    high = 1 - front * beta_fraction(b, a, np.where(direct, 0.0, 1 - inner)) / b
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(direct, low, high)))


def t_cdf(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    tail = 0.5 * incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + t * t))
    return np.where(t > 0, 1 - tail, tail)


@F.pandas_udf(DoubleType())
def right_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(T >= t) with ``df`` degrees of freedom; null where either is null or df < 1."""
    ok = t.notna() & (df >= 1)
    out = pd.Series(np.nan, t.index)
    if ok.any():
        out[ok] = 1 - t_cdf(t[ok].to_numpy(float), df[ok].to_numpy(float))
    return out.astype(object).where(ok, None).astype("Float64").astype(object)


def incomplete_gamma(a: np.ndarray, x: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """P(a, x), the regularised lower incomplete gamma function: its series below a + 1, its continued fraction beyond."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.maximum(np.asarray(x, float), 0.0))
    gamma = np.vectorize(math.lgamma, otypes=[float])
    inner = np.maximum(x, 1e-300)
    front = np.exp(a * np.log(inner) - inner - gamma(a))
    near = x < a + 1
    at = np.where(near, inner, 1.0)
    term = 1 / a
    total = term.copy()
    for i in range(1, rounds):
        term = term * at / (a + i)
        total = total + term
        if (term < 1e-17 * total).all():
            break
    at, tiny = np.where(near, a + 2, inner), 1e-300
    b = at + 1 - a
    c, d = np.full_like(b, 1 / tiny), 1 / b
    out = d.copy()
    for i in range(1, rounds):
        numerator = -i * (i - a)
        b = b + 2
        d = numerator * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + numerator / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        out = out * c * d
        if (np.abs(c * d - 1) < 1e-16).all():
            break
    return np.clip(np.where(x <= 0, 0.0, np.where(near, front * total, 1 - front * out)), 0.0, 1.0)


def over_rows(function, *columns: pd.Series) -> pd.Series:
    """A function of arrays where no argument is null, null elsewhere."""
    ok = np.logical_and.reduce([c.notna() for c in columns])
    out = pd.Series([None] * len(ok), dtype=object)
    if ok.any():
        out[ok] = function(*[c[ok].to_numpy(float) for c in columns]).tolist()
    return out


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    """The standard normal distribution; null for null."""
    return over_rows(lambda x: np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x]), z)


@F.pandas_udf(DoubleType())
def f_cdf(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """The F distribution with df1 and df2 degrees of freedom."""
    return over_rows(lambda x, a, b: incomplete_beta(a / 2, b / 2, a * x / (a * x + b)), f, df1, df2)


@F.pandas_udf(DoubleType())
def chi2_cdf(x: pd.Series, df: pd.Series) -> pd.Series:
    """The chi-square distribution with df degrees of freedom."""
    return over_rows(lambda v, a: incomplete_gamma(a / 2, v / 2), x, df)


@F.pandas_udf(DoubleType())
def half_binomial_cdf(k: pd.Series, n: pd.Series) -> pd.Series:
    """P(X <= k) of n fair coins."""
    return over_rows(lambda a, b: np.where(a >= b, 1.0, incomplete_beta(np.maximum(b - a, 1e-9), a + 1, np.full_like(a, 0.5))), k, n)
