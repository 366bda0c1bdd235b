"""Exact top-k search by inner product with the threshold algorithm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, quoted, read


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow list column, short ones filled up with zeros."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


class Best:
    """The k best (score, id) of each query so far, and a score that k candidates are known to reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least
        self.score = np.full((len(least), k), -np.inf)
        self.id = np.full((len(least), k), np.iinfo(np.int64).max)

    def bound(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows, self.k - 1], self.least[rows])

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates ``ids``, with their scores for the queries ``rows``; -inf is none."""
        place = np.broadcast_to(ids, score.shape)
        score = np.concatenate([self.score[rows], np.where(score < self.least[rows, None], -np.inf, score)], axis=1)
        place = np.concatenate([self.id[rows], place], axis=1)
        if score.shape[1] > 4 * self.k:  # the kth score first, then only what reaches it
            kth = -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            width = int((score >= np.maximum(kth, np.finfo(float).min)).sum(axis=1).max())
            width = min(max(width, self.k), score.shape[1])
            part = np.argpartition(-score, width - 1, axis=1)[:, :width]
            score, place = np.take_along_axis(score, part, 1), np.take_along_axis(place, part, 1)
        place = np.where(score == -np.inf, np.iinfo(np.int64).max, place)
        order = np.lexsort((place, -score), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(place, order, 1)


def search(queries: np.ndarray, q_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, best: Best, step: int = 64, block: int = 512) -> None:
    """Adds the best vectors of a shard for each query to ``best``, by sorted access in steps.

    Each dimension has its vectors in order of the component, sorted once for
    all queries; a query reads the list from the high end where its own
    component is positive, else from the low end. A block of queries goes down
    the lists together; what a step brings up is scored in full. No unseen
    vector can score more than the query's inner product with the components at
    the current depth; a query is done when the score it is sure to reach
    exceeds that bound (a tie goes on, for the smaller id).
    """
    dims = max(queries.shape[1], vectors.shape[1], 1)
    queries, vectors = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (queries, vectors))
    n, columns = len(ids), np.arange(dims)
    low = np.argsort(vectors, axis=0, kind="stable")
    for first in range(0, len(q_ids), block):
        open_ = np.arange(first, min(first + block, len(q_ids)))
        seen = np.zeros(n, bool)
        for depth in range(0, n, step):
            to = min(depth + step, n)
            fresh = np.unique(np.concatenate([low[depth:to].ravel(), low[n - to : n - depth].ravel()]))
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            if len(fresh):
                score = queries[open_] @ vectors[fresh].T
                best.add(open_, np.where(ids[fresh] == q_ids[open_, None], -np.inf, score), ids[fresh])
            own = queries[open_]
            most = np.maximum(own, 0) @ vectors[low[n - to], columns] + np.minimum(own, 0) @ vectors[low[to - 1], columns]
            open_ = open_[best.bound(open_) <= most]
            if not len(open_):
                break


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = 8192,
    block_rows: int = 1 << 16,
    sample_rows: int = 4096,
) -> DataFrame:
    """The ``k`` rows of highest inner product for each query row, over all rows.

    Vectors stay where they are read: each task takes its own in shards of
    ``shard_rows``. Queries are sent to all tasks, ``block_rows`` at a time (a
    table of that size is what is broadcast). A sample of about ``sample_rows``
    vectors gives each query a score that its kth best is sure to reach, so
    that searches can stop early and a task hands on only what reaches it:
    results, merged by query, are all that is shuffled. Results are (query_id,
    rank, vec_id, score); the query's own id is no candidate; ties go to the
    smaller id.

    Vectors that are null or hold a null, NaN or infinite component, and rows
    without an id, take no part. Components of missing dimensions count as 0.
    Rows that repeat an id are candidates each on their own, so an id may come
    twice; a repeated query id is one query, its smallest vector. Empty tables
    give empty results.
    """
    spark = vectors.sparkSession
    good = F.when(
        quoted(key).isNotNull() & ~F.exists(quoted(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
        quoted(vector),
    )
    rows = vectors.select(quoted(key).cast("long").alias("id"), is_query.alias("q"), good.cast("array<double>").alias("v")).where("v is not null")
    asked = rows.where("q").groupBy("id").agg(F.min("v").alias("v"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = sample_rows / max(1, rows.count())
    picked = rows.where(draw < share).select("id", "v").toArrow()
    sample = spark.sparkContext.broadcast((picked["id"].to_numpy(), matrix(picked["v"])))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the kth best score of the sample."""
        ids, known = sample.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            q_ids, own, least = table["id"].to_numpy(), matrix(table["v"]), np.full(len(table), -np.inf)
            dims = max(own.shape[1], known.shape[1])
            own, other = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (own, known))
            for a in range(0, len(q_ids), 1024):
                score = np.where(ids == q_ids[a : a + 1024, None], -np.inf, own[a : a + 1024] @ other.T)
                if score.shape[1] >= k:
                    least[a : a + 1024] = -np.partition(-score, k - 1, axis=1)[:, k - 1]
            yield batch.append_column("least", pa.array(least))

    queries = checkpointed(asked.mapInArrow(bounded, "id long, v array<double>, least double"))
    blocks = max(1, -(-queries.count() // block_rows))
    found = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        shared = spark.sparkContext.broadcast((block["id"].to_numpy(), matrix(block["v"]), block["least"].to_numpy()))

        def meet(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, own, least = shared.value
            best, held = Best(least, k), []

            def settle() -> None:
                table = pa.Table.from_batches(held)
                search(own, q_ids, matrix(table["v"]), table["id"].to_numpy(), best)
                held.clear()

            for batch in batches:
                held.append(batch)
                if sum(x.num_rows for x in held) >= shard_rows:
                    settle()
            if held:
                settle()
            who, col = np.nonzero(best.score > -np.inf)
            for a in range(0, len(who), 1 << 16):
                w, c = who[a : a + (1 << 16)], col[a : a + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"query_id": q_ids[w], "vec_id": best.id[w, c], "score": best.score[w, c]})

        part = rows.select("id", "v").mapInArrow(meet, "query_id long, vec_id long, score double")
        part = checkpointed(part) if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    finite = F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x))
    kept = rows.select("vec_id", F.when(~F.exists(finite, F.isnull), whole).alias("embedding"))
    found = top_k(kept, F.col("vec_id") % 50 == 0)
    return found.withColumn("score", F.col("score").cast("long"))


SQL = r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(generate_series(1, least(len(q.v), len(c.v))), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
