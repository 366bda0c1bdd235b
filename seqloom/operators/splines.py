"""Natural cubic splines through any number of knots, by ranges of x."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .loops import cut, scratch


def tridiagonal(lower: np.ndarray, middle: np.ndarray, upper: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of a diagonally dominant tridiagonal system for all columns of ``right``, by elimination."""
    n = len(middle)
    m, r = middle.astype(float).copy(), right.astype(float).copy()
    for i in range(1, n):
        f = lower[i] / m[i - 1]
        m[i] -= f * upper[i - 1]
        r[i] -= f * r[i - 1]
    for i in range(n - 1, -1, -1):
        r[i] = (r[i] - (upper[i] * r[i + 1] if i < n - 1 else 0)) / m[i]
    return r


def interior(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots inside a range as a + b * first + c * last, columns a, b, c, given those at its ends."""
    h = np.diff(x)
    slope = np.diff(y) / h
    right = np.zeros((len(x) - 2, 3))
    right[:, 0] = 6 * np.diff(slope)
    if len(right):
        right[0, 1] -= h[0]
        right[-1, 2] -= h[-1]
        return tridiagonal(h[:-1], 2 * (h[:-1] + h[1:]), h[1:], right)
    return right


@dataclass
class Spline:
    """Pieces (cell, x0, x1, y, b, c, d): y + b t + c t^2 + d t^3 with t = x - x0, in the shared folder; cells are ranges of x."""

    pieces: DataFrame
    starts: list[float]

    def at(self, queries: DataFrame, x: str = "x") -> DataFrame:
        """All rows with value, slope and curvature of the spline at their ``x``.

        Beyond the first and the last knot the outer pieces go on. Rows are
        dealt by range of x, in shares of a range where many ask for it; a null
        or NaN x, or a spline of fewer than two knots, has nulls.
        """
        spark, starts = queries.sparkSession, self.starts
        good = F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))
        names = queries.columns
        if not starts:
            return queries.select("*", *[F.lit(None).cast("double").alias(c) for c in ("value", "slope", "curvature")])
        shared = spark.sparkContext.broadcast(np.array(starts))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch["x_"].to_numpy(zero_copy_only=False)
                cell = np.maximum(np.searchsorted(shared.value, at, "right") - 1, 0)
                yield batch.append_column("cell", pa.array(cell, pa.int64()))

        rows = queries.withColumn("x_", F.when(good, F.col(x).cast("double")))
        schema = rows.withColumn("cell", F.lit(0).cast("long")).schema
        asked = cut(rows.mapInArrow(place, schema))
        many = {r[0]: r[1] for r in asked.groupBy("cell").count().collect()}
        plan = F.broadcast(spark.createDataFrame([(c, max(1, -(-n // (1 << 16)))) for c, n in many.items()] or [(0, 1)], "cell long, shares int"))
        left = asked.join(plan, "cell").withColumn("share", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("shares")).cast("int")).drop("shares")
        right = self.pieces.join(plan, "cell").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")

        def evaluate(some: pa.Table, pieces: pa.Table) -> pa.Table:
            pieces = pieces.sort_by("x0")
            x0 = pieces["x0"].to_numpy()
            at = some["x_"].to_numpy()
            i = np.clip(np.searchsorted(x0, at, "right") - 1, 0, max(0, len(x0) - 1))
            y, b, c, d = (pieces[k].to_numpy()[i] for k in ("y", "b", "c", "d")) if len(x0) else [np.full(len(at), math.nan)] * 4
            t = at - x0[i] if len(x0) else at
            out = {"value": y + t * (b + t * (c + t * d)), "slope": b + t * (2 * c + 3 * t * d), "curvature": 2 * c + 6 * t * d}
            return pa.table({n: some[n] for n in names} | {k: pa.array(v, from_pandas=True) for k, v in out.items()})

        shape = queries.select("*", *[F.lit(None).cast("double").alias(c) for c in ("value", "slope", "curvature")]).schema
        return left.groupBy("cell", "share").cogroup(right.groupBy("cell", "share")).applyInArrow(evaluate, shape)

    def integral(self) -> float:
        """Over all pieces."""
        t = F.col("x1") - F.col("x0")
        area = t * (F.col("y") + t * (F.col("b") / 2 + t * (F.col("c") / 3 + t * F.col("d") / 4)))
        return self.pieces.agg(F.sum(area)).first()[0] or 0.0


def natural_spline(knots: DataFrame, x: str = "x", y: str = "y", cell_rows: int = 1 << 16) -> Spline:
    """The natural cubic spline through all knots; those of one x count as their mean.

    Knots are dealt to ranges of x. Each range solves its part of the banded
    system for the second derivatives three times, as a function of those at
    the range's ends; the ends of all ranges, a few thousand numbers, are then a
    small banded system of their own on the driver, whose solution is put into
    every range. Rows with a null, NaN or infinite coordinate are left out;
    two knots give a line, fewer no spline.
    """
    spark = knots.sparkSession
    good = knots.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != math.inf)
    points = cut(good.where(finite("x") & finite("y")).groupBy("x").agg(F.avg("y").alias("y")))
    count = points.count()
    if count < 2:
        empty = "cell long, x0 double, x1 double, y double, b double, c double, d double"
        return Spline(spark.createDataFrame([], empty), [])
    path = scratch(spark, "knots")
    points.repartitionByRange(max(1, -(-count // cell_rows)), "x").withColumn("cell", F.spark_partition_id().cast("long")).write.parquet(path)
    dealt = spark.read.parquet(path)
    # a range ends with the first knot of the next one; the last with its own last
    firsts = sorted((r.x, r.cell, r.y) for r in dealt.groupBy("cell").agg(F.min_by(F.struct("x", "y"), "x").alias("p")).select("cell", "p.x", "p.y").collect())
    if len(firsts) > 1 and count and dealt.where(F.col("cell") == firsts[-1][1]).limit(2).count() == 1:  # a lone knot joins the range before it
        lone = firsts.pop()
        dealt = dealt.withColumn("cell", F.when(F.col("cell") == lone[1], firsts[-1][1]).otherwise(F.col("cell")))
    shared = [(cell, *firsts[i + 1][::2]) for i, (_, cell, _) in enumerate(firsts[:-1])]
    ends = spark.createDataFrame([(c, float(a), float(b)) for c, a, b in shared], "cell long, x double, y double")
    ranges = cut(dealt.select("cell", "x", "y").unionByName(ends))

    def reduce(table: pa.Table) -> pa.Table:
        """What a range's ends have to fulfil: widths, slopes and interior solutions beside them."""
        table = table.sort_by("x")
        px, py = table["x"].to_numpy(), table["y"].to_numpy()
        h, inner = np.diff(px), interior(px, py)
        slope = np.diff(py) / h
        first = inner[0] if len(inner) else np.array([0.0, 0.0, 1.0])
        last = inner[-1] if len(inner) else np.array([0.0, 1.0, 0.0])
        return pa.table({"x": [px[0]], "part": [[h[0], slope[0], *first, h[-1], slope[-1], *last]]})

    parts = sorted((r.x, r.part) for r in ranges.groupBy("cell").applyInArrow(reduce, "x double, part array<double>").collect())
    n = len(parts)
    low, mid, up, right = (np.zeros(n + 1) for _ in range(4))
    mid[0] = mid[n] = 1.0  # no curvature at the outer knots
    for j in range(1, n):
        *_, hl, sl, a, b, c = parts[j - 1][1]
        hr, sr, p, q, r = parts[j][1][:5]
        # hl * M(before) + 2 (hl + hr) M(j) + hr * M(after) = 6 (sr - sl), before and after by their own ranges' ends
        low[j], mid[j], up[j], right[j] = hl * b, 2 * (hl + hr) + hl * c + hr * q, hr * r, 6 * (sr - sl) - hl * a - hr * p
    solved = tridiagonal(low, mid, up, right[:, None])[:, 0]
    starts = [p[0] for p in parts]
    bounds = {s: (float(solved[i]), float(solved[i + 1])) for i, s in enumerate(starts)}
    known = spark.sparkContext.broadcast(bounds)

    def pieces(table: pa.Table) -> pa.Table:
        table = table.sort_by("x")
        px, py = table["x"].to_numpy(), table["y"].to_numpy()
        first, last = known.value[px[0]]
        m = np.concatenate([[first], interior(px, py) @ [1.0, first, last], [last]])
        h, cell = np.diff(px), bisect.bisect_right(sorted(known.value), px[0]) - 1
        b = np.diff(py) / h - h * (2 * m[:-1] + m[1:]) / 6
        return pa.table({"cell": np.full(len(h), cell), "x0": px[:-1], "x1": px[1:], "y": py[:-1], "b": b, "c": m[:-1] / 2, "d": np.diff(m) / (6 * h)})

    shape = "cell long, x0 double, x1 double, y double, b double, c double, d double"
    return Spline(cut(ranges.groupBy("cell").applyInArrow(pieces, shape)), starts)
