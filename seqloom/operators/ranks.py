"""Ranks with ties over whole tables and groups, by ranges of values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .loops import scratch

#: A value with more rows than this, and than one in so many of all, is hot: there are at most HOT_SHARE such values.
HOT_ROWS, HOT_SHARE = 1000, 10_000


def running_sums(rows: DataFrame, by: Sequence[str], order: str, sums: Mapping[str, Column]) -> DataFrame:
    """All rows with the sums of ``sums`` over the group up to the row, itself included, in the order of a column of distinct values.

    Rows are dealt to ranges of (by, order) and written with the number of their
    range; ranges are summed first, so a group of any size is spread over tasks.
    """
    spark = rows.sparkSession
    path = scratch(spark, "ranges")
    rows.withColumns(dict(sums)).repartitionByRange(*by, order).withColumn("cell_", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    before = W.partitionBy(*by).orderBy("cell_").rowsBetween(W.unboundedPreceding, -1)
    cells = dealt.groupBy(*by, "cell_").agg(*[F.sum(n).alias(f"{n}_of_") for n in sums])
    starts = cells.withColumns({f"{n}_of_": F.coalesce(F.sum(f"{n}_of_").over(before), F.lit(0)) for n in sums})
    starts = starts.withColumnsRenamed({c: f"{c}_of_" for c in (*by, "cell_")})
    same = F.col("cell_") == F.col("cell__of_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of_"))
    within = W.partitionBy(*by, "cell_").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = dealt.withColumns({n: F.sum(n).over(within) for n in sums}).join(starts, same)
    return placed.select(*rows.columns, *[(F.col(n) + F.col(f"{n}_of_")).alias(n) for n in sums])


def value_ranks(rows: DataFrame, value: str, by: Sequence[str] = (), sums: Mapping[str, Column] | None = None) -> DataFrame:
    """(by, value, n, first, ``sums``): how often each distinct value occurs and how many rows of its group lie before it.

    Values are counted before they are shuffled, dealt to ranges of (by, value)
    and written with the number of their range; ranges are summed, and each
    value adds its range's start to the sum within the range. So equal values
    are one row and no range or group is too large for a task, however many
    rows repeat a value. Null values are left out; NaN is greater than all
    others; a null group is a group.
    """
    spark = rows.sparkSession
    extra = {name: F.sum(c).alias(name) for name, c in (sums or {}).items()}
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), *extra.values())
    path = scratch(spark, "ranges")
    counted.repartitionByRange(*by, value).withColumn("cell_", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    cells = dealt.groupBy(*by, "cell_").agg(F.sum("n").alias("rows_"))
    if by:
        over = W.partitionBy(*by).orderBy("cell_").rowsBetween(W.unboundedPreceding, -1)
        starts = cells.withColumn("start_", F.coalesce(F.sum("rows_").over(over), F.lit(0)))
    else:  # a row a range
        total, known = 0, []
        for cell, size in sorted(map(tuple, cells.collect())):
            known.append((cell, total))
            total += size
        starts = spark.createDataFrame(known, "cell_ int, start_ long")
    starts = starts.withColumnsRenamed({c: f"{c}_of_" for c in by} | {"cell_": "cell_of_"})
    same = F.col("cell_") == F.col("cell_of_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of_"))
    over = W.partitionBy(*by, "cell_").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("before_", F.coalesce(F.sum("n").over(over), F.lit(0))).join(starts, same)
    return placed.select(*by, value, "n", (F.col("start_") + F.col("before_")).alias("first"), *extra)


def ranks(rows: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank", centered: bool = False) -> DataFrame:
    """All rows with the rank of ``value`` in the table, or in their group: from 0, ties share the mean of their ranks.

    ``centered`` takes the mean rank of the group from each. Rows with a null
    value have a null rank. Values with a large share of all rows are few and
    are joined by broadcast, the others by their value. ``name`` replaces an
    input column of that name.
    """
    own = [c for c in rows.columns if c.lower() != name.lower()]
    placed = value_ranks(rows, value, by)
    rank = F.col("first") + (F.col("n") - 1) / 2
    if centered:
        sizes = placed.groupBy(*by).agg(F.sum("n").alias("all_")).withColumnsRenamed({c: f"{c}_of_" for c in by})
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}_of_"))
        placed = placed.join(sizes, same) if by else placed.withColumn("all_", F.lit(sizes.first()[0] or 0))
        rank = rank - (F.col("all_") - 1) / 2
    table = placed.select(*[F.col(c).alias(f"{c}_of_") for c in by], F.col(value).alias("value_"), "n", rank.alias("rank_"))
    path = scratch(rows.sparkSession, "ranks")
    table.write.parquet(path)
    table = rows.sparkSession.read.parquet(path)
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(HOT_ROWS, total // HOT_SHARE)
    keys = [F.col(c) for c in own]

    def looked_up(left: DataFrame, right: DataFrame, out: str) -> DataFrame:
        same = F.col(value) == F.col("value_")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}_of_"))
        return left.join(right.select(*[f"{c}_of_" for c in by], "value_", F.col("rank_").alias(out)), same, "left").drop(*[f"{c}_of_" for c in by], "value_")

    known = looked_up(rows.select(*keys), F.broadcast(table.where(hot)), "hot_rank_")
    done = known.where(F.col("hot_rank_").isNotNull() | F.col(value).isNull()).withColumnRenamed("hot_rank_", name)
    rest = known.where(F.col("hot_rank_").isNull() & F.col(value).isNotNull()).drop("hot_rank_")
    return done.unionByName(looked_up(rest, table.where(~hot), name))


def row_ranks(vector: Column, centered: bool = False) -> Column:
    """Ranks of an array's components among themselves, from 0, ties share their mean; a null component has a null rank.

    Compares all pairs of components, so it is meant for vectors of up to some
    hundred. ``centered`` takes the mean rank away. A null array gives null.
    """
    present = F.filter(vector, lambda x: x.isNotNull())
    less = lambda x: F.size(F.filter(present, lambda y: y < x))
    same = lambda x: F.size(F.filter(present, lambda y: y == x))
    middle = (F.size(present) - 1) / 2 if centered else F.lit(0.0)
    return F.transform(vector, lambda x: F.when(x.isNotNull(), less(x) + (same(x) - 1) / 2 - middle))
