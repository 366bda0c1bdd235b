"""Moments, exact percentiles, covariance and correlation matrices, and tests of samples, by group."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..functions import numeric
from .loops import cut
from .ranks import ranks, value_ranks

#: An equi-depth histogram of this many steps is what a round of selection narrows by.
STEPS = 256
#: Groups up to which what is known of each goes to every task; of more, those with more than one in so many of all rows.
FEW = 10_000


def literal(value, kind: DataType) -> Column:
    """A value of a collected row as a column, arrays and structs included."""
    if value is not None and isinstance(kind, ArrayType):
        return F.array(*[literal(v, kind.elementType) for v in value]).cast(kind)
    if value is not None and isinstance(kind, StructType):
        return F.struct(*[literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind)])
    return F.lit(value).cast(kind)


def same_group(by: Sequence[str]) -> Column:
    """A null group meets itself."""
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of_"))
    return same


def large(sizes: DataFrame, by: Sequence[str]) -> DataFrame | None:
    """The groups (by) of ``sizes`` (by, n) that hold a great share of all rows, FEW at most; None where all groups are few."""
    count, total = sizes.agg(F.count("*"), F.sum("n")).first()
    return None if count <= FEW else sizes.where(F.col("n") > total // FEW).select(*[F.col(c).alias(f"{c}_of_") for c in by])


def beside(rows: DataFrame, right: DataFrame, by: Sequence[str], hot: DataFrame | None = None) -> DataFrame:
    """Rows with the columns of their group's one row in ``right``; the one row of a whole table becomes constants.

    A group may hold any share of the rows, which therefore do not move to its
    row: this goes to all tasks, for all groups or for those in ``hot`` (see
    ``large``). The others are small and meet in a join.
    """
    if not by:
        row = right.first()
        return rows.select("*", *[literal(None if row is None else row[f.name], f.dataType).alias(f.name) for f in right.schema]).where(F.lit(row is not None))
    right = right.withColumnsRenamed({c: f"{c}_of_" for c in by})
    of = [f"{c}_of_" for c in by]
    if hot is None:
        return rows.join(F.broadcast(right), same_group(by)).drop(*of)
    marked = hot.select(*[F.col(c).alias(f"{c}_hot_") for c in of])
    is_hot = F.lit(True)
    for c in of:
        is_hot = is_hot & F.col(c).eqNullSafe(F.col(f"{c}_hot_"))
    great, rest = (right.join(F.broadcast(marked), is_hot, how) for how in ("left_semi", "left_anti"))
    small = rows.join(F.broadcast(hot), same_group(by), "left_anti")
    return rows.join(F.broadcast(great), same_group(by)).unionByName(small.join(rest, same_group(by))).drop(*of)


def finite(rows: DataFrame, value: str) -> DataFrame:
    x = F.col(value).cast("double")
    return rows.withColumn(value, x).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))


# moments


def shape(n: Column, variance: Column, skewness: Column, kurtosis: Column) -> tuple[Column, Column]:
    """Skewness and excess kurtosis with the sample's deviation (n - 1) in place of the population's; 0 without spread."""
    part = (n - 1) / n
    flat = (n < 2) | (variance <= 0)
    return F.when(flat, 0.0).otherwise(skewness * F.pow(part, 1.5)), F.when(flat, 0.0).otherwise((kurtosis + 3) * part * part - 3)


def moments(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, variance, skewness, kurtosis, deviation): sample moments of each group.

    Variance divides by n - 1; skewness and excess kurtosis are means of powers
    of (x - mean) / sqrt(variance); deviation is the mean of |x - mean|. Central
    moments up to the fourth are merged from part to part in one pass; a second
    one takes the deviations. Values that are null, NaN or infinite are left
    out, and groups without others have no row; a single value has zeros.
    """
    good = finite(rows, value)
    x = F.col(value)
    central = good.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("v_"), F.skewness(x).alias("s_"), F.kurtosis(x).alias("k_"))
    variance = F.when(F.col("n") < 2, 0.0).otherwise(F.col("v_"))
    skew, excess = shape(F.col("n"), variance, F.col("s_"), F.col("k_"))
    out = cut(central.where("n > 0").select(*by, "n", "mean", variance.alias("variance"), skew.alias("skewness"), excess.alias("kurtosis")))
    hot = large(out, by) if by else None
    away = beside(good.select(*by, x.alias("x_")), out.select(*by, "mean"), by, hot).groupBy(*by).agg(F.avg(F.abs(F.col("x_") - F.col("mean"))).alias("deviation"))
    if not by:
        return beside(out, away, by)
    return out.join(away.withColumnsRenamed({c: f"{c}_of_" for c in by}), same_group(by)).drop(*[f"{c}_of_" for c in by])


def percentiles(rows: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), most: int = 4096) -> DataFrame:
    """(by, share, x): exact percentiles of each group, linear between the two values around share * (n - 1).

    The order statistics of a group start with the whole line as their interval.
    A round takes an equi-depth histogram of each interval, keeps the steps
    around the wanted ranks as points, and counts exactly how many values lie on
    and between the points, so that the approximate histogram never decides. A
    point that holds the rank is the answer, however often it is repeated; else
    the gap between two points is the next interval, a hundredth or so of the
    last one, and once it holds at most ``most`` values they are sorted, those
    of all rounds in one pass at the end. A value lies in one interval at most,
    and is counted there by the interval's low end; no group is ever gathered.

    Values that are null, NaN or infinite are left out, groups without others
    have no row.
    """
    good = finite(rows, value).select(*by, F.col(value).alias("x_"))
    sizes = cut(good.groupBy(*by).agg(F.count("*").alias("n")).where("n > 0"))
    hot = large(sizes, by) if by else None
    wanted = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.floor(F.lit(float(s)) * (F.col("n") - 1)).alias("k")) for s in shares])
    asked = cut(sizes.select(*by, "n", F.explode(wanted).alias("w")).select(*by, "n", "w.share", "w.k"))
    both = asked.select(*by, "n", F.explode(F.array(F.col("k"), F.least(F.col("k") + 1, F.col("n") - 1))).alias("k")).distinct()
    # ranks `ks` lie strictly between low and high; `start` rows lie at or below low, `between` within
    state = both.groupBy(*by, F.col("n").alias("between")).agg(F.array_sort(F.collect_list("k")).alias("ks"))
    state = cut(state.select(*by, F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"), F.lit(0).cast("long").alias("start"), "between", "ks"))
    keys, found, done = [*by, "k"], None, None
    grid = [i / STEPS for i in range(STEPS + 1)]

    def inside(some: DataFrame, *names: str) -> DataFrame:
        """Each value with the low end of the interval of its group in which it lies, if there is one, and with what ``names`` are there."""
        own = F.struct(*[F.col(c) for c in ("low", "high", *names)])
        packed = some.groupBy(*by).agg(F.collect_list(own).alias("t_"))
        hits = F.filter("t_", lambda t: (F.col("x_") > t["low"]) & (F.col("x_") < t["high"]))
        placed = beside(good, packed, by, hot).select(*by, "x_", F.get(hits, F.lit(0)).alias("t")).where("t is not null")
        return placed.select(*by, "x_", "t.low", *[f"t.{c}" for c in names])

    def joined(counts: DataFrame, some: DataFrame) -> DataFrame:
        """What was found in each interval (by, low), with the interval's other columns."""
        of = {c: f"{c}_of_" for c in (*by, "low")}
        return counts.join(some.withColumnsRenamed(of), same_group(by) & (F.col("low") == F.col("low_of_"))).drop(*of.values())

    while True:
        small = state.where(F.col("between") <= most)
        done = small if done is None else done.unionByName(small)
        state = state.where(F.col("between") > most)
        if state.isEmpty():
            break
        whole = [*by, "low", "high", "start", "between", "ks"]
        steps = joined(inside(state).groupBy(*by, "low").agg(F.percentile_approx("x_", grid, 10 * STEPS).alias("h_")), state)
        at = lambda k: F.floor((k - F.col("start")) * float(STEPS) / F.col("between")).cast("int")
        ends = lambda k: F.array(F.get("h_", F.greatest(at(k) - 1, F.lit(0))), F.get("h_", F.least(at(k) + 2, F.lit(STEPS))))
        steps = cut(steps.select(*whole, F.array_sort(F.array_distinct(F.flatten(F.transform("ks", ends)))).alias("points")))
        place = F.struct(F.size(F.filter("points", lambda p: p < F.col("x_"))).alias("i"), F.array_contains("points", F.col("x_")).alias("on"))
        counted = inside(steps, "points").select(*by, "low", place.alias("p")).groupBy(*by, "low", "p.i", "p.on").agg(F.count("*").alias("n"))
        segments = joined(counted.groupBy(*by, "low").agg(F.array_sort(F.collect_list(F.struct("i", "on", "n"))).alias("s")), steps)
        add = lambda acc, s: F.struct(
            (acc["at"] + s["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s["i"].alias("i"), s["on"].alias("on"), s["n"].alias("n"), acc["at"].alias("before")))).alias("out")
        )
        empty = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<i:int,on:boolean,n:bigint,before:bigint>>").alias("out"))
        parts = segments.select(*by, "low", "high", "ks", "points", F.explode(F.aggregate("s", empty, add, lambda acc: acc["out"])).alias("s"))
        mine = F.filter("ks", lambda k: (k >= F.col("s.before")) & (k < F.col("s.before") + F.col("s.n")))
        parts = cut(parts.select(*by, "low", "high", mine.alias("ks"), "points", "s").where(F.size("ks") > 0))
        point = lambda i: F.get("points", i)
        on = parts.where("s.on").select(*by, F.explode("ks").alias("k"), point(F.col("s.i")).alias("x"))
        found = on if found is None else found.unionByName(on)
        low = F.when(F.col("s.i") == 0, F.col("low")).otherwise(point(F.col("s.i") - 1))
        high = F.when(F.col("s.i") == F.size("points"), F.col("high")).otherwise(point(F.col("s.i")))
        state = parts.where("not s.on").select(*by, low.alias("low"), high.alias("high"), F.col("s.before").alias("start"), F.col("s.n").alias("between"), "ks")
    done = cut(done)
    last = joined(inside(done).groupBy(*by, "low").agg(F.sort_array(F.collect_list("x_")).alias("v")), done)
    last = last.select(*by, F.explode("ks").alias("k"), "start", "v").select(*keys, F.element_at("v", (F.col("k") - F.col("start") + 1).cast("int")).alias("x"))
    found = cut(last if found is None else found.unionByName(last)).withColumnsRenamed({c: f"{c}_of_" for c in keys})
    keyed = asked.withColumn("next", F.least(F.col("k") + 1, F.col("n") - 1))
    for place, name in (("k", "x0"), ("next", "x1")):
        keyed = keyed.join(found, same_group(by) & (F.col(place) == F.col("k_of_"))).withColumnRenamed("x", name).drop(*[f"{c}_of_" for c in keys])
    part = F.col("share") * (F.col("n") - 1) - F.col("k")
    return keyed.select(*by, "share", (F.col("x0") * (1 - part) + F.col("x1") * part).alias("x"))


def median(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return percentiles(rows, value, [0.5], by).select(*by, F.col("x").alias("median"))


# matrices


def merged(n: float, mean: np.ndarray, square: np.ndarray, m: float, other: np.ndarray, more: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Counts, means and centred cross products of two sets of rows together."""
    total = n + m
    if total == 0:
        return n, mean, square
    gap = other - mean
    return total, mean + gap * (m / total), square + more + np.outer(gap, gap) * (n * m / total)


def cross_products(rows: DataFrame, vector: str, fan: int = 64) -> tuple[float, np.ndarray, np.ndarray]:
    """The number of vectors, their mean, and their centred cross products.

    A task merges its rows, a batch at a time, into one block; blocks meet
    ``fan`` at a time until few are left. What moves is a block a task, d * d
    numbers. Null vectors, and those with a null, NaN or infinite component,
    are left out; so are vectors shorter than the longest.
    """
    good = rows.select(F.when(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)), F.col(vector)).cast("array<double>").alias("v")).where("v is not null")
    d = good.agg(F.max(F.size("v"))).first()[0] or 0
    empty = 0.0, np.zeros(d), np.zeros((d, d))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = empty
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, d)
            if len(x):
                mean = x.mean(axis=0)
                block = merged(*block, len(x), mean, (x - mean).T @ (x - mean))
        if block[0]:
            yield pa.RecordBatch.from_pydict({"node": [TaskContext.get().partitionId()], "n": [float(block[0])], "mean": [block[1]], "square": [block[2].ravel()]})

    def folded(parts) -> tuple[float, np.ndarray, np.ndarray]:
        block = empty
        for n, mean, square in parts:
            block = merged(*block, n, np.array(mean), np.array(square).reshape(d, d))
        return block

    def merge(table: pa.Table) -> pa.Table:
        n, mean, square = folded(zip(*(table[c].to_pylist() for c in ("n", "mean", "square"))))
        return pa.table({"node": table["node"].slice(0, 1), "n": [float(n)], "mean": [mean], "square": [square.ravel()]})

    shape_ = "node long, n double, mean array<double>, square array<double>"
    left = cut(good.where(F.size("v") == d).mapInArrow(fold, shape_)) if d else good.limit(0).selectExpr("0L node", "0D n", "v mean", "v square")
    while left.count() > fan:
        left = cut(left.withColumn("node", F.floor(F.col("node") / fan)).groupBy("node").applyInArrow(merge, shape_))
    return folded((r.n, r.mean, r.square) for r in left.orderBy("node").toLocalIterator())


def correlation_matrix(rows: DataFrame, vector: str, first: int | None = None) -> DataFrame:
    """(i, j, covariance, correlation) of all pairs of components, sample covariance (n - 1), Pearson's correlation.

    With ``first``, the pairs of the first components with the others: the
    matrix of two sets of variables. A constant component has correlation 0 with
    all; fewer than two vectors give zeros.
    """
    spark = rows.sparkSession
    n, _, square = cross_products(rows, vector)
    covariance = square / (n - 1) if n > 1 else np.zeros_like(square)
    size = np.sqrt(np.diag(covariance))
    both = np.outer(size, size)
    correlation = np.divide(covariance, both, out=np.zeros_like(covariance), where=both > 0)
    i, j = (x.ravel() for x in np.indices(covariance.shape))
    if first is not None:
        kept = (i < first) & (j >= first)
        i, j = i[kept], j[kept]
    table = {"i": i.astype(np.int32), "j": (j - (first or 0)).astype(np.int32), "covariance": covariance[i, j], "correlation": correlation[i, j]}
    return spark.createDataFrame(pa.table(table))


def rank_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """(v): each component's rank among all rows' components at its place, ties at their mean; vectors that hold no number left out."""
    good = rows.select(F.when(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)), F.col(vector)).alias("v")).where("v is not null")
    keyed = cut(good.withColumn("row_", F.monotonically_increasing_id()))
    long = keyed.select("row_", F.posexplode("v").alias("pos", "x"))
    placed = ranks(long, "x", ["pos"])
    pairs = F.array_sort(F.collect_list(F.struct("pos", "rank")))
    return placed.groupBy("row_").agg(F.transform(pairs, lambda p: p["rank"]).alias("v"))


def rank_correlation_matrix(rows: DataFrame, vector: str, first: int | None = None) -> DataFrame:
    """(i, j, correlation): Spearman's, Pearson's of the ranks; otherwise as ``correlation_matrix``."""
    return correlation_matrix(rank_vectors(rows, vector), "v", first).drop("covariance")


# tests; p-values: `both` of the two-sided test, `left` small where the (first) sample is smaller, `right` where it is greater


def tails(left: Column, right: Column) -> list[Column]:
    both = F.when(left.isNotNull() & right.isNotNull(), F.least(F.lit(1.0), 2 * F.least(left, right)))
    return [both.alias("both"), left.alias("left"), right.alias("right")]


def rank_sum_test(rows: DataFrame, value: str, is_first: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, m, u, z, both, left, right): Mann and Whitney's test of two samples in each group.

    u counts the pairs in which the first sample's value is the greater, ties by
    halves. p-values are normal, corrected for ties and continuity. Rows with a
    null value or sample are left out; without spread z is 0.
    """
    good = finite(rows, value).select(*by, value, is_first.alias("f_")).where("f_ is not null")
    one = F.col("f_").cast("long")
    placed = value_ranks(good, value, by, {"taken_": one})
    t = F.col("n").cast("double")
    sums = placed.groupBy(*by).agg(F.sum("taken_").alias("nx"), F.sum("n").alias("all"), F.sum(F.col("taken_") * (F.col("first") + (t + 1) / 2)).alias("r"), F.sum(t * t * t - t).alias("ties"))
    n, m = F.col("nx").cast("double"), (F.col("all") - F.col("nx")).cast("double")
    variance = n * m / 12 * ((n + m + 1) - F.col("ties") / F.greatest((n + m) * (n + m - 1), F.lit(1.0)))
    out = sums.select(*by, F.col("nx").alias("n"), (F.col("all") - F.col("nx")).alias("m"), (F.col("r") - n * (n + 1) / 2).alias("u"), F.greatest(variance, F.lit(0.0)).alias("v_"))
    return normal_tails(out, "u", F.col("n") * F.col("m") / 2, by, ["n", "m", "u"])


def signed_rank_test(rows: DataFrame, value: str, middle: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, w, z, both, left, right): Wilcoxon's test that a sample's median is ``middle``.

    w sums the ranks of |x - middle| of values beyond it; values equal to it are
    left out. p-values as in ``rank_sum_test``.
    """
    gap = F.col(value) - middle
    good = finite(rows, value).where(gap != 0).select(*by, F.abs(gap).alias("d_"), (gap > 0).cast("long").alias("p_"))
    placed = value_ranks(good, "d_", by, {"taken_": F.col("p_")})
    t = F.col("n").cast("double")
    sums = placed.groupBy(*by).agg(F.sum("n").alias("all"), F.sum(F.col("taken_") * (F.col("first") + (t + 1) / 2)).alias("w"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("all").cast("double")
    out = sums.select(*by, F.col("all").alias("n"), "w", (n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48).alias("v_"))
    return normal_tails(out, "w", n_of("n") * (n_of("n") + 1) / 4, by, ["n", "w"])


def n_of(name: str) -> Column:
    return F.col(name).cast("double")


def normal_tails(df: DataFrame, statistic: str, mean: Column, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    gap, sd = F.col(statistic) - mean, F.sqrt("v_")
    over = lambda x: F.when(sd > 0, x / sd).otherwise(0.0)
    df = df.select(*by, *names, over(gap).alias("z"), over(gap + 0.5).alias("zl"), over(gap - 0.5).alias("zr")).where("n > 0")
    return df.select(*by, *names, "z", *tails(numeric.normal_cdf(F.col("zl")), numeric.normal_cdf(-F.col("zr"))))


def sign_test(rows: DataFrame, value: str, middle: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, above, both, left, right): the sign test, exact, of ``middle`` as the median; values equal to it are left out."""
    good = finite(rows, value).where(F.col(value) != middle)
    out = good.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(F.col(value) > middle, 1)).alias("above")).where("n > 0")
    return out.select(*by, "n", "above", *tails(numeric.half_binomial_cdf(F.col("above"), F.col("n")), numeric.half_binomial_cdf(F.col("n") - F.col("above"), F.col("n"))))


def two_samples(rows: DataFrame, value: str, is_first: Column, by: Sequence[str]) -> DataFrame:
    good = finite(rows, value).withColumn("f_", is_first)
    of = lambda test: F.when(test, F.col(value))
    x, y = of(F.col("f_")), of(~F.col("f_"))
    out = good.groupBy(*by).agg(F.count(x).alias("n"), F.count(y).alias("m"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"))
    return out.where("n > 1 and m > 1").select(*by, *[n_of(c).alias(c) for c in ("n", "m")], "mx", "my", "vx", "vy")


def variance_ratio_test(rows: DataFrame, value: str, is_first: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, f, df1, df2, both, left, right): the F test of two samples' variances; both need two values and the second spread."""
    out = two_samples(rows, value, is_first, by).where("vy > 0").select(*by, (F.col("vx") / F.col("vy")).alias("f"), (F.col("n") - 1).alias("df1"), (F.col("m") - 1).alias("df2"))
    left = numeric.f_cdf(F.col("f"), F.col("df1"), F.col("df2"))
    return out.select(*by, "f", "df1", "df2", *tails(left, 1 - left))


def mean_test(rows: DataFrame, value: str, is_first: Column, by: Sequence[str] = (), equal_variances: bool = False) -> DataFrame:
    """(by, t, df, both, left, right): Student's test of two samples' means, Welch's unless variances are taken as equal."""
    out = two_samples(rows, value, is_first, by).where("vx + vy > 0")
    n, m, vx, vy = (F.col(c) for c in ("n", "m", "vx", "vy"))
    if equal_variances:
        df, spread = n + m - 2, ((n - 1) * vx + (m - 1) * vy) / (n + m - 2) * (1 / n + 1 / m)
    else:
        spread = vx / n + vy / m
        df = spread * spread / (vx * vx / (n * n * (n - 1)) + vy * vy / (m * m * (m - 1)))
    out = out.select(*by, ((F.col("mx") - F.col("my")) / F.sqrt(spread)).alias("t"), df.alias("df"))
    return out.select(*by, "t", "df", *tails(numeric.right_tail(-F.col("t"), F.col("df")), numeric.right_tail(F.col("t"), F.col("df"))))


def variance_test(rows: DataFrame, value: str, variance: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, chi2, df, both, left, right): the chi-square test that a sample's variance is ``variance``; it needs two values."""
    out = finite(rows, value).groupBy(*by).agg(F.count("*").alias("n"), F.var_samp(value).alias("v")).where("n > 1")
    out = out.select(*by, ((F.col("n") - 1) * F.col("v") / variance).alias("chi2"), (n_of("n") - 1).alias("df"))
    left = numeric.chi2_cdf(F.col("chi2"), F.col("df"))
    return out.select(*by, "chi2", "df", *tails(left, 1 - left))


def normality_test(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, jb, p): Jarque and Bera's test, with the chi-square tail that holds for large samples; 0 and 1 without spread."""
    good = finite(rows, value)
    out = good.groupBy(*by).agg(F.count("*").alias("n"), F.var_pop(value).alias("v"), F.skewness(value).alias("s"), F.kurtosis(value).alias("k")).where("n > 0")
    jb = F.when(F.col("v") > 0, F.col("n") / 6 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4)).otherwise(0.0)
    return out.select(*by, "n", jb.alias("jb")).withColumn("p", F.exp(-F.col("jb") / 2))


def correlation_significance(df: DataFrame, correlation: str, n: str) -> DataFrame:
    """Adds t, both, left, right for Pearson's or Spearman's correlations of ``n`` pairs; null below 3 pairs, certain at 1 and -1."""
    r, size = F.col(correlation).cast("double"), n_of(n)
    t = F.when(size >= 3, F.when(F.abs(r) < 1, r * F.sqrt((size - 2) / (1 - r * r))).otherwise(r * 1e300))
    df = df.withColumn("t", t).withColumn("df_", size - 2)
    return df.select("*", *tails(numeric.right_tail(-F.col("t"), F.col("df_")), numeric.right_tail(F.col("t"), F.col("df_")))).drop("df_")
