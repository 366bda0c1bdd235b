"""Ranked lexical search over document shards of compressed sparse rows with integer impacts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches_of, checkpointed, quoted, read, slices, stored, utf8

#: Terms of the contract: runs of ASCII letters and digits and of anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INSIDE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: A null doc_id while ids are compared: after all others.
NO_ID = np.iinfo(np.int64).max
#: A shard is a row of plain numbers: its terms are their letters, one after the other, and where each begins.
KINDS = {"ids": np.int64, "letters": np.uint8, "begins": np.int32, "at": np.int64, "docs": np.int32, "impacts": np.int32}
SHARD = ", ".join(f"{name} binary" for name in KINDS)


def term_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to terms, and which begin one; no term crosses from a text to the next."""
    inside = INSIDE[data]
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    first = offsets[:-1]
    before[first[first < len(data)]] = False
    return inside, inside & ~before


def per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of marks in each text."""
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def postings(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of some texts, where each one's postings begin, their texts (ascending), how often each holds the term, and the texts' sizes."""
    inside, starts = term_starts(data, offsets)
    sizes = per_text(starts, offsets)
    letters = LOWERED[data[inside]]
    begins = (np.cumsum(inside, dtype=np.int64) - 1)[starts]
    ends = np.concatenate([begins, [len(letters)]]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(letters.tobytes())])
    coded = words.cast(pa.binary()).dictionary_encode()
    texts = len(offsets) - 1
    pairs = coded.indices.to_numpy().astype(np.int64) * texts + np.repeat(np.arange(texts), sizes)
    pairs, times = np.unique(pairs, return_counts=True)
    at = np.searchsorted(pairs, np.arange(len(coded.dictionary) + 1, dtype=np.int64) * texts)
    return coded.dictionary, at, pairs % max(texts, 1), times, sizes


Batches = Iterator[pa.RecordBatch]


@dataclass
class Index:
    """Shards, the number of documents with a term, and the number of all terms with repeats.

    ``rows`` are shards in the shared folder, or texts that ``cut`` makes shards
    of, one after the other, in the task that reads them. ``shard_bytes`` of
    texts are a shard, and reach a task at once.
    """

    rows: DataFrame
    documents: int
    terms: int
    shard_bytes: int
    cut: Callable[[Batches], Batches] | None = None

    def each(self, run: Callable[[Batches], Batches], schema: str) -> DataFrame:
        """What ``run`` makes of a task's shards."""
        cut = self.cut
        return self.rows.mapInArrow(run if cut is None else lambda batches: run(cut(batches)), schema)

    def kept(self) -> Index:
        """Its shards in the shared folder: for many small searches; tasks then take more memory."""
        if self.cut is None:
            return self
        with batches_of(self.rows.sparkSession, self.shard_bytes):
            return Index(stored(self.rows.mapInArrow(self.cut, SHARD), large_rows=True), self.documents, self.terms, self.shard_bytes)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = 4 << 20) -> Index:
    """An index of whole texts; documents stay in the task that reads them.

    A pass counts documents and terms. When the index is read or kept, each
    task's texts are cut into shards of about ``shard_bytes`` (one longer text
    is its own), which hold the distinct terms and, term by term, the documents
    and their impacts ``(10**9 * tf) div (1000 * tf + 20 * m)``, 32-bit
    integers. A task holds one shard at a time. Nothing is shuffled. Null texts
    have no terms; repeated rows are documents each.
    """
    rows = docs.select(quoted(key).cast("long").alias("id"), quoted(text).alias("t"))
    most = shard_bytes + shard_bytes // 8  # a batch exceeds its size by a text

    def measure(batches: Batches) -> Batches:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in slices(offsets, most):
                own = offsets[a : b + 1] - offsets[a]
                sizes = per_text(term_starts(data[offsets[a] : offsets[b]], own)[1], own)
                yield pa.RecordBatch.from_pydict({"n": [int((sizes > 0).sum())], "l": [int(sizes.sum())]})

    with batches_of(docs.sparkSession, shard_bytes):
        total = rows.select("t").mapInArrow(measure, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    count, length = total[0] or 0, total[1] or 0

    def shards(batches: Batches) -> Batches:
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, most):
                terms, at, texts, tf, sizes = postings(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if len(terms):
                    m = 50 + 50 * sizes * count // length
                    impacts = 10**9 * tf // (1000 * tf + 20 * m[texts])
                    begins = np.frombuffer(terms.buffers()[1], np.int32, len(terms) + 1)
                    letters = np.frombuffer(terms.buffers()[2], np.uint8, begins[-1])
                    columns = (ids[a:b], letters, begins, at, texts, impacts)
                    yield pa.RecordBatch.from_pydict({name: pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary()) for (name, kind), x in zip(KINDS.items(), columns)})

    return Index(rows, count, length, shard_bytes, shards)


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term), each once; an item is all rows of its id."""
    words = F.regexp_extract_all(F.translate(quoted(text), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return queries.select(quoted(key).alias("item_id"), F.explode(words).alias("term")).distinct()


def numbers(batch: pa.RecordBatch, row: int, name: str) -> np.ndarray:
    """A column of a shard."""
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_buffer(), KINDS[name])


def found_terms(batch: pa.RecordBatch, row: int, vocabulary: pa.Array) -> np.ndarray:
    """Each term's place in a shard, -1 where it has none."""
    begins = numbers(batch, row, "begins").copy()  # a value's bytes may stand at any address
    shard = pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(numbers(batch, row, "letters"))])
    return pc.index_in(vocabulary, value_set=shard).fill_null(-1).to_numpy(zero_copy_only=False)


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores above 0 and their ids, ties to smaller ids: all that reach the kth score are sorted."""
    floor = 1 if len(score) <= k else max(1, int(np.partition(score, len(score) - k)[len(score) - k]))
    at = np.nonzero(score >= floor)[0]
    order = np.lexsort((ids[at], -score[at]))[:k]
    return score[at][order], ids[at][order]


def search(index: Index, queries: DataFrame, key: str = "item_id", text: str = "text", k: int = 50, block_terms: int = 1 << 20) -> DataFrame:
    """The ``k`` best documents above 0 for each item: (item_id, rank, doc_id, score).

    Items go to all tasks in blocks of about ``block_terms`` distinct (item,
    term) pairs; one pass over the shards sums the terms' document frequencies
    and gives them their weights, another adds, term at a time, weight times
    impact to a dense accumulator a shard, keeps the k best of a task, and the
    tasks' bests meet by item. Repeated item ids are one item, the union of
    its rows; items without terms, or whose terms no document holds, have no
    rows; a null doc_id comes after the others of its score. An empty table of
    documents or items gives an empty result.
    """
    spark = queries.sparkSession
    pairs = checkpointed(query_terms(queries, key, text))
    blocks = max(1, -(-pairs.count() // block_terms))
    found = None
    for b in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        words = own["term"].combine_chunks().cast(pa.binary()).dictionary_encode()
        items = own["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        vocabulary, names = words.dictionary, items.dictionary
        order = np.argsort(items.indices.to_numpy(), kind="stable")
        terms = words.indices.to_numpy()[order]
        bounds = np.searchsorted(items.indices.to_numpy()[order], np.arange(len(names) + 1))
        shared = spark.sparkContext.broadcast(vocabulary)

        def frequencies(batches: Batches, shared=shared) -> Batches:
            total = np.zeros(len(shared.value), np.int64)
            for batch in batches:
                for row in range(batch.num_rows):
                    place = found_terms(batch, row, shared.value)
                    at = numbers(batch, row, "at")
                    total += np.where(place >= 0, at[place + 1] - at[place], 0)
            held = np.nonzero(total)[0]
            yield pa.RecordBatch.from_pydict({"term": held, "df": total[held]})

        with batches_of(spark, index.shard_bytes):
            counted = index.each(frequencies, "term long, df long").groupBy("term").agg(F.sum("df")).collect()
        weight = np.zeros(len(vocabulary), np.int64)
        for term, df in counted:
            weight[term] = math.floor(1000 * math.log((2 * index.documents + 2) / (2 * df + 1)))
        task = spark.sparkContext.broadcast((vocabulary, weight, terms, bounds))

        def score(batches: Batches, task=task) -> Batches:
            vocabulary, weight, terms, bounds = task.value
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * (len(bounds) - 1)
            for batch in batches:
                for row in range(batch.num_rows):
                    place = found_terms(batch, row, vocabulary)
                    ids, at, docs, impacts = (numbers(batch, row, name) for name in ("ids", "at", "docs", "impacts"))
                    total = np.zeros(len(ids), np.int64)
                    for i in range(len(bounds) - 1):
                        held = terms[bounds[i] : bounds[i + 1]]
                        held = held[(place[held] >= 0) & (weight[held] > 0)]
                        if not len(held):
                            continue
                        total[:] = 0
                        for t in held:
                            a, z = at[place[t]], at[place[t] + 1]
                            total[docs[a:z]] += weight[t] * impacts[a:z]
                        s, d = best_of(total, ids, k)
                        if len(best[i][0]) >= k:
                            s, d = s[s >= best[i][0][-1]], d[s >= best[i][0][-1]]
                        if len(s):
                            best[i] = best_of(np.concatenate([best[i][0], s]), np.concatenate([best[i][1], d]), k)
            for i, (s, d) in enumerate(best):
                if len(s):
                    yield pa.RecordBatch.from_pydict({"item": np.full(len(s), i), "doc": d, "score": s})

        part = index.each(score, "item long, doc long, score long")
        top = W.partitionBy("item").orderBy(F.desc("score"), "doc")
        part = part.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        ids = spark.createDataFrame(pa.table({"item": np.arange(len(names)), "item_id": names})) if len(names) else None
        if ids is None:
            part = part.limit(0).withColumn("item_id", F.lit(None).cast(pairs.schema["item_id"].dataType))
        else:
            part = part.join(F.broadcast(ids), "item")
        part = part.select(F.col("item_id").cast(pairs.schema["item_id"].dataType), F.col("rank").cast("int"), F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "score")
        with batches_of(spark, index.shard_bytes):
            part = checkpointed(part)
        found = part if found is None else found.unionByName(part)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents WHERE text IS NOT NULL),
f AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(terms) AS term FROM d) GROUP BY r, doc_id, term),
n AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY r),
g AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY term, big_n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark WHERE text IS NOT NULL),
s AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN n USING (r), g GROUP BY item_id, r, doc_id),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM t WHERE rank <= 50
"""
