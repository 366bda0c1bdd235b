"""Mixing sources to target weights."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, carried, quoted, read

OUT = ("size", "source_size", "target", "taken")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, epochs: int) -> DataFrame:
    """Add ``target`` to one row for each source (absent, source, source_size).

    Sources by code point, null last, take the weights in turn. A target is
    ``min(epochs * size, level * weight)``; the level that spends the whole
    budget is found from running sums in the order in which sources fill up.
    There is a row for each source only, so one task can order them.
    """
    ranked = sizes.withColumn("i", F.row_number().over(W.orderBy("absent", "source")) - 1)
    each = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("w", F.element_at(each, (F.col("i") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", (F.lit(epochs) * F.col("source_size")).cast("double"))
    order = W.orderBy(F.col("most") / F.col("w"), "i")
    every = W.partitionBy()
    filled = ranked.withColumns(
        {
            "budget": F.lit(float(share)) * F.sum("source_size").over(every),
            "before": F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)),
        }
    ).withColumn("level", (F.col("budget") - F.col("before")) / F.col("open"))
    full = F.col("most") <= F.col("level") * F.col("w")
    level = F.max(F.when(~full, F.col("level"))).over(every)
    return filled.withColumn("target", F.when(full, F.col("most")).otherwise(level * F.col("w"))).select(
        "absent", "source", "source_size", "target"
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    share: float = 1.0,
    epochs: int = 3,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: Iterable[str] | None = None,
) -> DataFrame:
    """How many words of each document a mix by source weights takes.

    Each document draws a hash-random key (md5 of its id). The key's range and
    the source form a cell; cells are summed, prefix sums run over the cells of
    a source, then within each cell, so a source with a third of all rows is
    spread over as many tasks as it has ranges (about the root of the row
    count). Whole passes are repeated, the last one is cut at the exact budget,
    inside a document if need be.

    Returns ``keep`` (all input columns by default) and size, source_size,
    target, taken; those names replace input columns. Null text has size 0, a
    null source is a source of its own, a null id draws its key from the text.
    Repeated rows count as rows; those of one id stand in one cell. An empty table gives an empty result.
    """
    ranges = max(1, math.isqrt(docs.count()))
    own = [c for c in carried(docs, keep, OUT)]
    name = lambda c: f"in_{c}"  # noqa: E731  keeps input names apart from ours
    tag = F.md5(F.coalesce(quoted(key).cast("string"), F.md5(F.coalesce(quoted(text), F.lit("")))))
    rows = docs.select(
        *[quoted(c).alias(name(c)) for c in own],
        F.isnull(quoted(source)).cast("int").alias("absent"),
        F.coalesce(quoted(source).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(quoted(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        tag.alias("tag"),
        quoted(key).alias("key"),
    ).withColumn("cell", F.shiftright(F.conv(F.substring("tag", 1, 8), 16, 10).cast("long") * ranges, 32))
    at = ["absent", "source", "cell"]
    cells = rows.groupBy(*at).agg(F.sum("size").alias("cell_size"))
    targets = source_targets(cells.groupBy("absent", "source").agg(F.sum("cell_size").alias("source_size")), weights, share, epochs)
    before = W.partitionBy("absent", "source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.withColumn("start", F.coalesce(F.sum("cell_size").over(before), F.lit(0))).join(targets, ["absent", "source"])
    starts = starts.select(*[F.col(c).alias(f"s_{c}") for c in at], "start", "source_size", "target")
    same = [F.col(c) == F.col(f"s_{c}") for c in at]
    within = W.partitionBy(*at).orderBy("tag", "key", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(within)).join(starts, same)
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - whole * F.col("source_size")
    last = F.greatest(F.lit(0), F.least("size", left - (F.col("start") + F.col("upto") - F.col("size"))))
    return placed.select(
        *[quoted(name(c)).alias(c) for c in own],
        "size",
        "source_size",
        "target",
        (whole * F.col("size") + last).cast("long").alias("taken"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), keep=["doc_id"])


#: Weights 1, 2, 3; all sizes shared; at most 3 passes.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS tag,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i
  FROM d GROUP BY source),
r AS (SELECT *, CAST(i % 3 + 1 AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS most FROM s),
f AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
      - coalesce(sum(most) OVER (ORDER BY most / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY most / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
t AS (
  SELECT source, source_size, CASE WHEN most <= level * w THEN most ELSE
      (max(CASE WHEN most > level * w THEN level END) OVER ()) * w END AS target
  FROM f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.tag, d.doc_id, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM p)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + greatest(0, least(size, budget - passes * source_size - (upto - size))) AS BIGINT) AS taken
FROM e
"""
