"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table of label values is sent to every task.
FEW = 10_000
#: A key with more rows than this, and than one in so many of all, is hot.
HOT_ROWS, HOT_KEYS = 1000, 10_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def carried(df: DataFrame, keep: Iterable[str] | None, reserved: Iterable[str]) -> list[str]:
    """Input columns that a result carries on: all, or those in ``keep``.

    A column whose name, in any case, is among ``reserved`` is left out: the
    operator's own column of that name takes its place.
    """
    taken = {c.lower() for c in reserved}
    names = df.columns if keep is None else list(keep)
    return [c for c in names if c.lower() not in taken]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset,
    as in tests on one machine, a folder of our own is used.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, large_rows: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again.

    Parquet's writer looks at a row group's size after 100 rows at the earliest,
    and Spark's reader decodes a group as a whole: where rows are shards of
    megabytes (``large_rows``), each is a group of its own, so that a task holds
    a shard at a time, however many it writes or reads.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    apart = {"parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false"} if large_rows else {}
    df.write.options(**apart).parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def batches_of(spark: SparkSession, most: int) -> Iterator[None]:
    """Actions inside send Python workers batches of about ``most`` bytes.

    Spark holds several copies of a batch in each task: its vectors, what it
    writes to the worker, and what the worker makes of it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{most}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def frugal() -> None:
    """In a worker: Arrow's memory goes back to the system once it is free.

    Its usual pools keep what was used for later, also while a worker idles or
    works for a stage that needs little, beside the memory of the JVM.
    """
    pa.set_memory_pool(pa.system_memory_pool())


def spread_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, how: str = "inner", ways: int = 64) -> DataFrame:
    """An equi-join that deals the few keys in ``hot`` out in several ways.

    Their rows go by the partition in which they stand on the left, and are
    repeated on the right. Only the hot keys are broadcast; callers take those
    with more than a fixed share of all rows, which bounds their number.
    """
    marked = F.broadcast(hot.select(*on, F.lit(True).alias("hot_")))
    way = F.when(F.col("hot_"), F.pmod(F.spark_partition_id(), F.lit(ways))).otherwise(0)
    every = F.when(F.col("hot_"), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(marked, on, "left").withColumn("way_", way).drop("hot_")
    b = right.join(marked, on, "left").withColumn("way_", F.explode(every)).drop("hot_")
    return a.join(b, [*on, "way_"], how).drop("way_")


def hot_rows(total: int) -> int:
    """Rows beyond which a key is hot: at most HOT_KEYS keys have so many."""
    return max(HOT_ROWS, total // HOT_KEYS)


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """crc32 of the key as text, modulo ``folds``, is ``fold``; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))


def sampled(rows: DataFrame, key: Column, stratum: Column, bound: int, text: Column | None = None) -> DataFrame:
    """About ``bound`` rows of each stratum, or all if there are fewer.

    Rows are taken by a hash of their key, so reruns agree; with few strata
    nothing is shuffled but one count for each. With ``text`` they are taken by
    key and text, and rows that are alike count once, so that the bound holds
    for null and repeated keys, too.
    """
    names = [quoted(c) for c in rows.columns]
    sizes = checkpointed(rows.groupBy(stratum.alias("stratum_")).agg(F.count("*").alias("size_")).where("stratum_ is not null"))
    # label values are few; should they be many, Spark chooses the join
    sizes = F.broadcast(sizes) if sizes.count() <= FEW else sizes
    drawn = F.xxhash64(key.cast("string")) if text is None else F.xxhash64(key.cast("string"), text)
    draw = F.pmod(drawn, F.lit(1 << 30)) / F.lit(float(1 << 30))
    marked = rows.withColumn("stratum_", stratum).join(sizes, "stratum_", "left")
    taken = marked.where(F.coalesce(draw * F.col("size_") < bound, F.lit(True))).select(*names)
    return taken if text is None else taken.dropDuplicates()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string array, and offsets (one more than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int, texts: int = 1 << 16) -> Iterable[tuple[int, int]]:
    """Ranges of at most ``texts`` texts, of at most ``most`` bytes together or of one longer text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n, at + texts)
        yield at, to
        at = to
