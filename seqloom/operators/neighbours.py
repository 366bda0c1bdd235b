"""Exact, approximate and radius search for nearest neighbours by a KD-tree of boxes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .loops import cut, scratch

#: Rows of a box get a salt below this; a part of a box is a range of salts.
SALTS = 1 << 20
#: A box whose bound equals a query's reach by all but rounding is looked at.
SLACK = 1 + 1e-12


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a list column; missing dimensions are 0."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), dims))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row[:dims]
    return out


def distances(gaps: np.ndarray, norm: int) -> np.ndarray:
    """Lengths of the last axis: norm 0 is the greatest component, 1 the sum, 2 Euclid's."""
    gaps = np.abs(gaps)
    if norm == 0:
        return gaps.max(axis=-1, initial=0.0)
    return gaps.sum(axis=-1) if norm == 1 else np.sqrt((gaps * gaps).sum(axis=-1))


def split_planes(sample: np.ndarray, boxes: int) -> list[tuple[int, float, int, int]]:
    """Nodes (dimension, cut, child for <= cut, child beyond); a child below 0 is box -1 - child.

    Each node halves its share of the sample at the median of its widest
    dimension, until ``boxes`` leaves are there or its points are all alike.
    """
    nodes: list = []
    leaves = 0

    def grow(points: np.ndarray, budget: int) -> int:
        nonlocal leaves
        spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(0)
        if budget > 1 and len(spread) and spread.max() > 0:
            dim = int(spread.argmax())
            cut_at = float(np.quantile(points[:, dim], 0.5, method="lower"))
            low = points[:, dim] <= cut_at
            if low.all():  # the upper half is one value
                cut_at = float(points[points[:, dim] < cut_at, dim].max())
                low = points[:, dim] <= cut_at
            node = len(nodes)
            nodes.append(None)
            nodes[node] = (dim, cut_at, grow(points[low], (budget + 1) // 2), grow(points[~low], budget // 2))
            return node
        leaves += 1
        return -leaves

    grow(sample, boxes)
    return nodes


def boxes_of(points: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The box of each point, walking all points down together."""
    at = np.zeros(len(points), int) if nodes else np.full(len(points), -1)
    dim, cut_at, low, high = (np.array(c) for c in zip(*nodes)) if nodes else [np.zeros(0)] * 4
    while (live := np.nonzero(at >= 0)[0]).size:
        node = at[live]
        at[live] = np.where(points[live, dim[node]] <= cut_at[node], low[node], high[node])
    return -1 - at


def nearest_of(query: np.ndarray, points: np.ndarray, ids: np.ndarray, norm: int, k: int | None, reach: np.ndarray, self_match: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k nearest points within each query's reach, of all without ``k``; ties to smaller ids."""
    out: list = [[], [], []]
    step = max(1, (1 << 21) // max(1, points.size))
    for a in range(0, len(query), step):
        d = distances(query[a : a + step, None, :] - points[None, :, :], norm)
        good = d <= reach[a : a + step, None]
        if not self_match:
            good &= d > 0
        if k is not None and len(points) > k:
            kth = np.partition(np.where(good, d, np.inf), k - 1, axis=1)[:, k - 1]
            good &= d <= kth[:, None]
        who, col = np.nonzero(good)
        order = np.lexsort((ids[col], d[who, col], who))
        who, col = who[order], col[order]
        if k is not None:
            place = np.arange(len(who)) - np.searchsorted(who, who)
            who, col = who[place < k], col[place < k]
        for x, y in zip(out, (who + a, ids[col], d[who, col])):
            x.append(y)
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


@dataclass
class KdTree:
    """Points dealt to boxes, in the shared folder, with the boxes' planes, bounds and sizes on the driver (a few thousand at most)."""

    points: DataFrame
    nodes: list[tuple[int, float, int, int]]
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    norm: int
    part_rows: int

    @property
    def dims(self) -> int:
        return self.low.shape[1]

    def _asked(self, queries: DataFrame, key: str, vector: str) -> DataFrame:
        """(row, query_id, q): each query row on its own; those that no distance is defined for are left out."""
        rows = queries.select(F.col(key).alias("query_id"), usable(F.col(vector)).alias("q")).where("q is not null")
        return cut(rows.withColumn("row", F.monotonically_increasing_id()))

    def _visits(self, asked: DataFrame, factor: float) -> DataFrame:
        """A row of ``asked`` (row, q, home, reach) for each box that its reach, divided by ``factor``, touches; its home is left out."""
        dims, norm, shared = self.dims, self.norm, asked.sparkSession.sparkContext.broadcast((self.low, self.high, self.rows > 0))

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high, held = shared.value
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    some = batch.slice(a, 256)
                    q, home, reach = matrix(some["q"], dims), some["home"].to_numpy(), some["reach"].to_numpy()
                    near = np.empty((len(q), len(low)))
                    for z in range(0, len(low), 512):
                        b = slice(z, z + 512)
                        near[:, b] = distances(np.maximum(np.maximum(low[b] - q[:, None], q[:, None] - high[b]), 0), norm)
                    who, box = np.nonzero((near <= (reach * SLACK / factor)[:, None]) & held)
                    other = box != home[who]
                    yield pa.RecordBatch.from_arrays([*some.take(pa.array(who[other])).select(["row", "q", "reach"]).columns, pa.array(box[other])], names=["row", "q", "reach", "box"])

        return asked.select("row", "q", "home", "reach").mapInArrow(expand, "row long, q array<double>, reach double, box long")

    def _meet(self, visits: DataFrame, k: int | None, self_match: bool, query_rows: int = 4096) -> DataFrame:
        """(row, id, distance) of what the visited boxes hold; large boxes and often visited ones meet in several groups."""
        often = {r[0]: r[1] for r in visits.groupBy("box").count().collect()}
        if not often:
            return visits.select("row", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("distance")).limit(0)
        parts = {b: max(1, -(-int(self.rows[b]) // self.part_rows)) for b in often}
        sides = [(b, parts[b], max(1, -(-n // query_rows))) for b, n in often.items()]
        plan = F.broadcast(visits.sparkSession.createDataFrame(sides, "box long, parts int, shares int"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.points.join(plan, "box").select("box", (F.col("salt").cast("long") * F.col("parts") / SALTS).cast("int").alias("part"), every("shares").alias("share"), "id", "v")
        right = visits.join(plan, "box").withColumn("share", F.pmod(F.xxhash64("row"), "shares").cast("int")).select("box", every("parts").alias("part"), "share", "row", "q", "reach")
        dims, norm = self.dims, self.norm

        def meet(points: pa.Table, asked: pa.Table) -> pa.Table:
            if not len(points) or not len(asked):
                who = ids = d = np.zeros(0, np.int64)
            else:
                who, ids, d = nearest_of(matrix(asked["q"], dims), matrix(points["v"], dims), points["id"].to_numpy(), norm, k, asked["reach"].to_numpy(), self_match)
            return pa.table({"row": asked["row"].to_numpy()[who.astype(np.int64)], "id": ids.astype(np.int64), "distance": d.astype(float)})

        keys = ["box", "part", "share"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "row long, id long, distance double")

    def nearest(self, queries: DataFrame, k: int, key: str = "query_id", vector: str = "vector", self_match: bool = True, eps: float = 0.0) -> DataFrame:
        """(query_id, rank, id, distance, boxes): the ``k`` nearest points of each query, ties to smaller ids, and how many boxes it looked at.

        A query first looks at the box that it falls into, then at those whose
        bounds are no farther than the kth distance so far, divided by
        1 + ``eps``: with ``eps`` above 0 the distance at each rank is at most
        1 + eps times the true one. Without ``self_match`` points at distance 0
        don't count. Fewer than ``k`` points give fewer rows. Repeated query
        rows are answered each; a null vector, or one with a null, NaN or
        infinite component, has no answer; missing dimensions count as 0, and
        further ones than the points have are ignored.
        """
        asked = self._asked(queries, key, vector)
        dims, nodes = self.dims, self.nodes

        def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.append_column("home", pa.array(boxes_of(matrix(batch["q"], dims), nodes), pa.int64()))

        placed = cut(asked.select("row", "q").mapInArrow(home, "row long, q array<double>, home long"))
        order = W.partitionBy("row").orderBy("distance", "id")
        best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        first = cut(best(self._meet(placed.select("row", "q", F.lit(math.inf).alias("reach"), F.col("home").alias("box")), k, self_match)))
        reach = first.where(F.col("rank") == k).select("row", F.col("distance").alias("reach"))
        wide = placed.join(reach, "row", "left").withColumn("reach", F.coalesce("reach", F.lit(math.inf)))
        visits = cut(self._visits(wide, 1 + eps))
        second = self._meet(visits, k, self_match)
        looked = visits.groupBy("row").agg((F.count("*") + 1).alias("boxes"))
        found = best(first.select("row", "id", "distance").unionByName(second)).join(asked.select("row", "query_id"), "row").join(looked, "row", "left")
        return found.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "distance", F.coalesce("boxes", F.lit(1)).cast("int").alias("boxes"))

    def within(self, queries: DataFrame, radius: Column | float, key: str = "query_id", vector: str = "vector", self_match: bool = True) -> DataFrame:
        """(query_id, id, distance) of all points within ``radius``, a number or a column of the queries; rows as in ``nearest``."""
        bound = radius if isinstance(radius, Column) else F.lit(float(radius))
        rows = queries.select(F.col(key).alias("query_id"), usable(F.col(vector)).alias("q"), bound.cast("double").alias("reach")).where("q is not null and reach >= 0")
        asked = cut(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("home", F.lit(-1).cast("long")))
        return self._meet(cut(self._visits(asked, 1.0)), None, self_match).join(asked.select("row", "query_id"), "row").select("query_id", "id", "distance")


def usable(vector: Column) -> Column:
    """The vector as doubles, null where a component is null, NaN or infinite."""
    return F.when(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)), vector).cast("array<double>")


def build(points: DataFrame, key: str = "id", vector: str = "vector", norm: int = 2, box_rows: int = 4096, most_boxes: int = 4096, part_rows: int = 4096, sample_rows: int = 1 << 16) -> KdTree:
    """A KD-tree over all points for norm 0 (greatest component), 1 (sum) or 2 (Euclid).

    The planes are medians of a sample of about ``sample_rows`` distinct points;
    every point is then dealt to its box, and boxes get the bounds of what they
    hold, so the sample decides on speed only. There is a box for every
    ``box_rows`` points, at most ``most_boxes``; boxes with more than
    ``part_rows`` rows, as where points coincide, are searched in parts.

    Points without an id, and vectors with a null, NaN or infinite component,
    take no part; missing dimensions count as 0; rows that repeat are points
    each. Without points every query finds nothing.
    """
    if norm not in (0, 1, 2):
        raise ValueError("norm is 0, 1 or 2")
    spark = points.sparkSession
    rows = points.select(F.col(key).cast("long").alias("id"), usable(F.col(vector)).alias("v")).where("id is not null and v is not null")
    count, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    boxes = min(most_boxes, max(1, -(-count // box_rows)))
    draw = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < sample_rows / max(1, count)).select("v").distinct().toArrow()
    nodes = split_planes(matrix(sample["v"], dims), boxes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(boxes_of(matrix(batch["v"], dims), nodes), pa.int64()), *batch.columns], names=["box", "id", "v"])

    path = scratch(spark, "boxes")
    dealt = rows.mapInArrow(deal, "box long, id long, v array<double>").withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    dealt.repartitionByRange("box", "salt").sortWithinPartitions("box").write.parquet(path)
    stored = spark.read.parquet(path)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, box = matrix(batch["v"], dims), batch["box"].to_numpy()
            order = np.argsort(box, kind="stable")
            names, at = np.unique(box[order], return_index=True)
            if len(names):
                low, high = (op.reduceat(v[order], at, axis=0) for op in (np.minimum, np.maximum))
                yield pa.RecordBatch.from_pydict({"box": names, "low": list(low), "high": list(high), "n": np.diff([*at, len(box)])})

    part = stored.select("box", "v").mapInArrow(bounds, "box long, low array<double>, high array<double>, n long")
    each = lambda op, c: F.array(*[op(F.col(c)[i]) for i in range(dims)]) if dims else F.array().cast("array<double>")
    known = part.groupBy("box").agg(each(F.min, "low").alias("low"), each(F.max, "high").alias("high"), F.sum("n").alias("n")).collect()
    leaves = len(nodes) + 1
    low, high, held = np.full((leaves, dims), math.inf), np.full((leaves, dims), -math.inf), np.zeros(leaves, np.int64)
    for r in known:
        low[r.box], high[r.box], held[r.box] = r.low, r.high, r.n
    return KdTree(stored, nodes, low, high, held, norm, part_rows)
