"""Score tables and sums of dense vectors as array products, a block at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .loops import cut

#: Bytes up to which the arrays of all classes are sent to every task.
SENT = 64 << 20
#: Numbers of a temporary array in a task.
TEMPORARY = 1 << 22

Work = Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def arrays_of(table: pa.Table, names: Sequence[str]) -> dict[str, np.ndarray]:
    return {n: matrix(table[n]) if pa.types.is_list(table[n].type) else table[n].to_numpy(zero_copy_only=False) for n in names}


def packed(cells: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, values): what each key has at all words, as arrays in the order of the words."""
    rows = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("word", *values))).alias("a_"))
    part = lambda v: F.transform("a_", lambda s: s[v]).alias(v)
    return rows.select(*keys, *map(part, values))


def score_table(reads: DataFrame, key: str, classes: DataFrame, names: Sequence[str], values: Sequence[str], work: Work, sent: int = SENT, block: int = 4096) -> DataFrame:
    """(key, ``names``, score) of every read (key, cells) with every class (``names``, ``values``).

    ``work`` takes the cells of some reads and the values of some classes and
    returns their matrix of scores. Classes that measure at most ``sent`` bytes
    go to all tasks and reads stay where they are; more classes are dealt, like
    the reads, into blocks of about ``block`` rows, and each block meets each
    once. Reads with null cells are left out.
    """
    spark = reads.sparkSession
    reads = reads.select(key, "cells").where("cells is not null")
    classes = cut(classes.select(*names, *values))
    width = F.lit(8) * sum((F.size(c) if classes.schema[c].dataType.typeName() == "array" else F.lit(1)) for c in values)
    count, size = classes.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    schema = reads.select(key).schema
    for field in classes.select(*names).schema:
        schema = schema.add(field)
    schema = schema.add("score", "double")

    def scored(ids: pa.Array, cells: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        held = arrays_of(table, values)
        m = len(table)
        for a in range(0, len(ids), max(1, (1 << 18) // max(1, m))):
            part = cells[a : a + max(1, (1 << 18) // max(1, m))]
            n = len(part)
            out = work(part, held)
            of_read, of_class = pa.array(np.repeat(np.arange(a, a + n), m)), pa.array(np.tile(np.arange(m), n))
            columns = [ids.take(of_read), *[table[c].combine_chunks().take(of_class) for c in names], pa.array(out.ravel(), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *names, "score"])

    if size <= sent:
        shared = spark.sparkContext.broadcast(classes.toArrow())

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(shared.value):
                    yield from scored(batch.column(0), matrix(batch.column(1)), shared.value)

        return reads.mapInArrow(beside, schema)
    reads = cut(reads)
    across, down = max(1, -(-reads.count() // block)), max(1, -(-size // sent))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = reads.select(F.pmod(F.xxhash64(key), F.lit(across)).cast("int").alias("a_"), every(down).alias("b_"), key, "cells")
    right = classes.select(every(across).alias("a_"), F.pmod(F.xxhash64(*names), F.lit(down)).cast("int").alias("b_"), *names, *values)

    def meet(some: pa.Table, table: pa.Table) -> pa.Table:
        parts = list(scored(some[key].combine_chunks(), matrix(some["cells"]), table)) if len(some) and len(table) else []
        empty = [some[key].slice(0, 0).combine_chunks(), *[table[c].slice(0, 0).combine_chunks() for c in names], pa.array([], pa.float64())]
        return pa.Table.from_batches(parts) if parts else pa.Table.from_arrays(empty, names=[key, *names, "score"])

    return left.groupBy("a_", "b_").cogroup(right.groupBy("a_", "b_")).applyInArrow(meet, schema)


def array_sums(rows: DataFrame, keys: Sequence[str], value: str, fan: int = 64) -> DataFrame:
    """(keys, value): sums of arrays of one length by key; many of one key are summed in two steps."""
    schema = rows.select(*keys, value).schema

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = matrix(table[value]).sum(axis=0)
        return pa.table({**{k: table[k].slice(0, 1) for k in keys}, value: pa.array([total], pa.list_(pa.float64()))})

    spread = rows.select(*keys, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(fan)).alias("p_"), value)
    return spread.groupBy(*keys, "p_").applyInArrow(add, schema).groupBy(*keys).applyInArrow(add, schema)


# what a block of reads and some classes give


def weighted_gaps(cells: np.ndarray, held: dict[str, np.ndarray]) -> np.ndarray:
    """constant - sum of (x - mean)^2 * scale: log densities of diagonal Gaussians."""
    out = np.empty((len(cells), len(held["constant"])))
    for c, (mean, scale, constant) in enumerate(zip(held["mean"], held["scale"], held["constant"])):
        gap = cells - mean
        out[:, c] = constant - (gap * gap * scale).sum(axis=1)
    return out


def inner_products(cells: np.ndarray, held: dict[str, np.ndarray]) -> np.ndarray:
    return cells @ held["x"].T


def nothing(cells: np.ndarray, held: dict[str, np.ndarray]) -> np.ndarray:
    return np.zeros((len(cells), len(held["one"])))


def pair_differences(cells: np.ndarray) -> np.ndarray:
    """(y - x)^2 * sign(y - x) of all pairs of cells x < y, in the order of x, then y."""
    x, y = np.triu_indices(cells.shape[1], 1)
    gap = cells[:, y] - cells[:, x]
    return gap * np.abs(gap)


def difference_gaps(cells: np.ndarray, held: dict[str, np.ndarray]) -> np.ndarray:
    """Twice the sum over pairs of cells of the absolute gap between a read's and a class's difference."""
    pairs = max(1, cells.shape[1] * (cells.shape[1] - 1) // 2)
    out, step = np.empty((len(cells), len(held["values"]))), max(1, TEMPORARY // pairs)
    for a in range(0, len(cells), step):
        own = pair_differences(cells[a : a + step])
        for c, values in enumerate(held["values"]):
            out[a : a + step, c] = 2 * np.abs(own - values).sum(axis=1)
    return out


def weighted_differences(rows: DataFrame, key: str, cells: str, weight: str) -> DataFrame:
    """(key, s): sums over rows of weight times the signed squared differences, as arrays of all pairs.

    A task adds its rows up by key and hands an array a key on, or earlier when
    it holds many, so rows become pairs only inside tasks.
    """
    schema = rows.select(key, F.lit(None).cast("array<double>").alias("s")).schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array(list(held.values()), pa.list_(pa.float64()))], names=[key, "s"])
            held.clear()
            return out

        for batch in batches:
            kind = batch.column(0).type
            ids, x, w = batch.column(0).dictionary_encode(null_encoding="encode"), matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            names, of = ids.dictionary.to_pylist(), ids.indices.to_numpy()
            step = max(1, TEMPORARY // max(1, x.shape[1] * (x.shape[1] - 1) // 2))
            for n, name in enumerate(names):
                mine = np.flatnonzero(of == n)
                for a in range(0, len(mine), step):
                    some = mine[a : a + step]
                    held[name] = held.get(name, 0) + w[some] @ pair_differences(x[some])
                if sum(len(v) for v in held.values()) > TEMPORARY:
                    yield handed()
        if held:
            yield handed()

    return array_sums(rows.select(key, cells, weight).mapInArrow(fold, schema), [key], "s")
