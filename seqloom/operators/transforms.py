"""Convolution, correlation and Fourier transforms of sequences that may be longer than a task should hold."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .loops import cut

#: Sequences up to this length are transformed in one task; it also bounds the shorter factors of longer ones.
LOCAL = 1 << 16


def samples(rows: DataFrame, by: Sequence[str], position: str, value: str) -> DataFrame:
    """(by, pos, x): one number a position; repeated positions are summed, nulls left out."""
    kept = rows.select(*by, F.col(position).cast("long").alias("pos"), F.col(value).cast("double").alias("x")).where("pos is not null and x is not null")
    return kept.groupBy(*by, "pos").agg(F.sum("x").alias("x"))


def convolve(rows: DataFrame, kernel: Sequence[float], by: Sequence[str] = (), position: str = "pos", value: str = "x", chunk: int = LOCAL) -> DataFrame:
    """(by, pos, x): each sequence convolved with a kernel, x[p] = sum over j of kernel[j] * input[p - j].

    Sequences are cut into chunks; a value also goes to the chunks that its
    kernel reaches, so that every chunk finds its part of the result by itself
    (overlap-save, by FFT for long kernels) and only the input is shuffled,
    once. Positions without a row count as 0, in the result those from a
    chunk's first value in reach to its last one have rows. Repeated positions
    are summed; an empty kernel or table gives no rows.
    """
    reach, weights = len(kernel) - 1, np.array(kernel, float)
    size = max(chunk, reach + 1)
    spread = samples(rows, by, position, value)
    if reach < 0:
        return spread.limit(0)
    first = F.floor(F.col("pos") / size)
    last = F.floor((F.col("pos") + reach) / size)
    spread = spread.withColumn("chunk_", F.explode(F.sequence(first, last)))
    keys = [*by, "chunk_"]

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        start = key[-1].as_py() * size
        pos, x = table["pos"].to_numpy(), table["x"].to_numpy()
        a, z = int(pos.min()), int(pos.max()) + reach
        line = np.zeros(int(pos.max()) - a + 1)
        line[pos - a] = x
        if reach < 64:
            out = np.convolve(line, weights)
        else:
            length = 1 << (len(line) + reach - 1).bit_length()
            out = np.fft.irfft(np.fft.rfft(line, length) * np.fft.rfft(weights, length), length)[: len(line) + reach]
        low, high = max(a, start), min(z, start + size - 1)
        names = {c: pa.array([key[i].as_py()] * (high - low + 1), table.schema.field(c).type) for i, c in enumerate(by)}
        return pa.table(names | {"pos": np.arange(low, high + 1), "x": out[low - a : high - a + 1]})

    shape = spread.select(*by, "pos", "x").schema
    return spread.groupBy(*keys).applyInArrow(work, shape)


def correlate(rows: DataFrame, pattern: Sequence[float], by: Sequence[str] = (), position: str = "pos", value: str = "x", chunk: int = LOCAL) -> DataFrame:
    """(by, pos, x): x[p] = sum over j of pattern[j] * input[p + j], for every shift at which they meet; otherwise as ``convolve``."""
    turned = convolve(rows, list(reversed(pattern)), by, position, value, chunk)
    return turned.withColumn("pos", F.col("pos") - (len(pattern) - 1))


def power_at(rows: DataFrame, period: float, by: Sequence[str] = (), position: str = "pos", value: str = "x") -> DataFrame:
    """(by, power): |sum of x * exp(-2 pi i pos / period)|^2 of each sequence, one pass of sums of any length."""
    kept = rows.where(F.col(position).isNotNull() & F.col(value).isNotNull())
    angle = 2 * math.pi * F.pmod(F.col(position).cast("double"), F.lit(float(period))) / period
    parts = kept.groupBy(*by).agg(F.sum(F.col(value) * F.cos(angle)).alias("re"), F.sum(F.col(value) * F.sin(angle)).alias("im"))
    return parts.select(*by, (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def factors(n: int, local: int) -> tuple[int, int]:
    """n as a product, as even as can be; (0, 0) where a factor would exceed ``local``."""
    if n <= local:
        return 1, n
    for a in range(math.isqrt(n), 0, -1):
        if n % a == 0:
            return (a, n // a) if n // a <= local else (0, 0)
    return 0, 0


def spectrum(signal: DataFrame, by: Sequence[str], local: int, inverse: bool = False) -> DataFrame:
    """(by, n, pos, re, im) transformed, for lengths ``n`` that have factors: rows and columns of a rectangle, a shuffle each.

    With n = a * b a value at p stands in column p mod b. Columns are
    transformed over their a values, turned by exp(-2 pi i (p mod b) k / n),
    and dealt anew by k; each of those rows is transformed over its b columns.
    Several columns, or rows, share a task's group. Missing positions are 0.
    """
    sign = 1 if inverse else -1
    pair = F.udf(lambda n: list(factors(n, local)), "array<long>")
    # one length a sequence: the function runs on the distinct lengths
    sizes = cut(signal.select("n").distinct().withColumn("f_", pair("n")).select("n", F.col("f_")[0].alias("a"), F.col("f_")[1].alias("b")))
    signal = signal.join(sizes, "n")
    step = lambda width: F.greatest(F.lit(1), F.floor(F.lit(local) / width))

    def named(key, table: pa.Table, count: int) -> dict[str, pa.Array]:
        return {c: pa.array([key[i].as_py()] * count, table.schema.field(c).type) for i, c in enumerate([*by, "n", "a", "b"])}

    def columns(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n, a, b = (key[len(by) + i].as_py() for i in range(3))
        pos = table["pos"].to_numpy()
        col, row = pos % b, pos // b
        kept, at = np.unique(col, return_inverse=True)
        grid = np.zeros((len(kept), a), complex)
        grid[at, row] = table["re"].to_numpy() + 1j * table["im"].to_numpy()
        done = np.fft.fft(grid, axis=1) if sign < 0 else np.fft.ifft(grid, axis=1) * a
        k = np.arange(a)
        done *= np.exp(sign * 2j * np.pi * ((kept[:, None] * k) % n) / n)
        return pa.table(named(key, table, done.size) | {"col": np.repeat(kept, a), "k": np.tile(k, len(kept)), "re": done.real.ravel(), "im": done.imag.ravel()})

    def rows_(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n, a, b = (key[len(by) + i].as_py() for i in range(3))
        kept, at = np.unique(table["k"].to_numpy(), return_inverse=True)
        grid = np.zeros((len(kept), b), complex)
        grid[at, table["col"].to_numpy()] = table["re"].to_numpy() + 1j * table["im"].to_numpy()
        done = np.fft.fft(grid, axis=1) if sign < 0 else np.fft.ifft(grid, axis=1) * b
        done = done / n if inverse else done
        out = named(key, table, done.size)
        del out["a"], out["b"]
        return pa.table(out | {"pos": (kept[:, None] + a * np.arange(b)).ravel(), "re": done.real.ravel(), "im": done.imag.ravel()})

    keys = [*by, "n", "a", "b"]
    mid = signal.withColumn("part_", F.floor(F.pmod(F.col("pos"), F.col("b")) / step(F.col("a"))))
    shape = signal.select(*keys, F.col("pos").alias("col"), F.col("pos").alias("k"), "re", "im").schema
    turned = mid.groupBy(*keys, "part_").applyInArrow(columns, shape)
    turned = turned.withColumn("part_", F.floor(F.col("k") / step(F.col("b"))))
    return turned.groupBy(*keys, "part_").applyInArrow(rows_, signal.select(*by, "n", "pos", "re", "im").schema)


def chirp(pos: Column, n: Column) -> tuple[Column, Column]:
    """exp(-pi i pos^2 / n), its angle reduced before it is taken."""
    angle = math.pi * F.pmod(pos * pos, 2 * n).cast("double") / n
    return F.cos(angle), -F.sin(angle)


def fourier(rows: DataFrame, by: Sequence[str] = (), position: str = "pos", re: str = "x", im: str | None = None, inverse: bool = False, local: int = LOCAL) -> DataFrame:
    """(by, pos, re, im): the discrete Fourier transform of each sequence, of any length, or its inverse.

    A sequence's length is its last position + 1; missing positions are 0 and
    repeated ones are summed. Lengths with two factors of at most ``local`` go
    by rows and columns; others, such as large primes, by Bluestein's chirps: a
    convolution of a length that is a power of two. So no task holds more than
    ``local`` values, for lengths up to ``local`` squared over four. Rows with a
    null or a negative position are left out.
    """
    imaginary = F.lit(0.0) if im is None else F.coalesce(F.col(im).cast("double"), F.lit(0.0))
    kept = rows.select(*by, F.col(position).cast("long").alias("pos"), F.col(re).cast("double").alias("re"), imaginary.alias("im")).where("pos >= 0 and re is not null")
    kept = kept.groupBy(*by, "pos").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    if inverse:  # the conjugate of the transform of the conjugate
        kept = kept.withColumn("im", -F.col("im"))
    kept = cut(kept)
    sizes = kept.groupBy(*by).agg((F.max("pos") + 1).alias("n"))
    if by:
        sizes = sizes.withColumnsRenamed({c: f"{c}_of_" for c in by})
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}_of_"))
        signal = kept.join(sizes, same).drop(*[f"{c}_of_" for c in by])
    else:
        signal = kept.withColumn("n", F.lit(sizes.first()[0] or 1).cast("long"))
    splits = F.udf(lambda n: factors(n, local)[0] > 0, "boolean")
    lengths = cut(signal.select("n").distinct().withColumn("splits", splits("n")))
    signal = cut(signal.join(lengths, "n").select(*by, "n", "pos", "re", "im", "splits"))
    out = spectrum(signal.where("splits").drop("splits"), by, local)
    rest = signal.where("not splits").drop("splits")
    if rest.limit(1).count():
        out = out.unionByName(bluestein(rest, by, local))
    if inverse:
        out = out.select(*by, "n", "pos", (F.col("re") / F.col("n")).alias("re"), (-F.col("im") / F.col("n")).alias("im"))
    return out.select(*by, "pos", "re", "im")


def bluestein(signal: DataFrame, by: Sequence[str], local: int) -> DataFrame:
    """(by, n, pos, re, im): transforms of any length through one convolution with a chirp."""
    long = F.pow(F.lit(2.0), F.ceil(F.log2(2 * F.col("n") - 1))).cast("long")
    product = lambda a, b, c, d: ((a * c - b * d), (a * d + b * c))
    c, s = chirp(F.col("pos"), F.col("n"))
    re, im = product(F.col("re"), F.col("im"), c, s)
    keys = [*by, "size"]
    turned = signal.select(*by, F.col("n").alias("size"), "pos", re.alias("re"), im.alias("im"), long.alias("n"))
    whole = turned.select(*keys, "n").distinct()
    # the chirp's conjugate at positions -(size - 1) .. size - 1, wrapped around n
    waves = whole.select(*keys, "n", F.explode(F.sequence(1 - F.col("size"), F.col("size") - 1)).alias("at"))
    c, s = chirp(F.abs(F.col("at")), F.col("size"))
    waves = waves.select(*keys, "n", F.pmod("at", F.col("n")).alias("pos"), c.alias("re"), (-s).alias("im"))
    a, b = (spectrum(x, keys, local) for x in (turned, waves))
    b = b.withColumnsRenamed({k: f"{k}_of_" for k in [*keys, "n", "pos", "re", "im"]})
    same = F.lit(True)
    for k in [*keys, "n", "pos"]:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_of_"))
    re, im = product(F.col("re"), F.col("im"), F.col("re_of_"), F.col("im_of_"))
    both = cut(a.join(b, same).select(*keys, "n", "pos", re.alias("re"), im.alias("im")))
    back = spectrum(both, keys, local, inverse=True).where(F.col("pos") < F.col("size"))
    c, s = chirp(F.col("pos"), F.col("size"))
    re, im = product(F.col("re"), F.col("im"), c, s)
    return back.select(*by, F.col("size").alias("n"), "pos", re.alias("re"), im.alias("im"))
