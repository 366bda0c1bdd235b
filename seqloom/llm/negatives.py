"""Hard negatives by bit-sliced integer products with intervals that tighten plane by plane."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, quoted, read, stored

SHARD = "ids binary, labels binary, planes array<binary>, dims int"
#: Integers that floating-point sums represent exactly.
EXACT = float(1 << 53)
NONE = -np.iinfo(np.int64).max


def integers(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of whole numbers, short ones filled up with zeros."""
    values = column.to_pylist()
    out = np.zeros((len(values), max(map(len, values), default=0)))
    for i, row in enumerate(values):
        out[i, : len(row)] = row
    return out


def sliced(rows: np.ndarray) -> list[bytes]:
    """Bit-planes of whole numbers in two's complement, the sign first: plane j is bit j of all components, packed."""
    width = 1
    while (rows >= 2.0 ** (width - 1)).any() or (rows < -(2.0 ** (width - 1))).any():
        width += 1
    # floor division keeps components beyond 64 bits whole
    return [np.packbits(np.mod(np.floor(rows / 2.0**j), 2).astype(bool)).tobytes() for j in range(width - 1, -1, -1)]


class Planes:
    """The bit-planes of a shard, unpacked when first asked for."""

    def __init__(self, packed: list[bytes], rows: int, dims: int):
        self.packed, self.rows, self.dims, self.held = packed, rows, dims, {}

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, i: int) -> np.ndarray:
        if i not in self.held:
            self.held[i] = np.unpackbits(np.frombuffer(self.packed[i], np.uint8), count=self.rows * self.dims).reshape(self.rows, self.dims).astype(float)
        return self.held[i]


def products(queries: np.ndarray, planes: Planes, columns: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, column, score), by query, of all pairs that may be among a query's ``k`` best of ``low`` <= score <= ``high``.

    The sign plane comes first, then the planes by weight. What the planes
    below one can add lies between the sums of the query's negative and of its
    positive components, times their weight: the interval of a pair. A pair is
    dropped when its interval misses [low, high], or lies below the lower ends
    of ``k`` others whose intervals lie within. While many pairs are left a
    plane is one product of matrices; after that only what is left is
    multiplied. ``allowed`` are the pairs that count; without ``k`` all in
    [low, high] are returned.
    """
    queries = np.pad(queries, ((0, 0), (0, max(0, planes.dims - queries.shape[1]))))[:, : planes.dims]
    if np.abs(queries).sum(axis=1).max(initial=0.0) * 2.0 ** len(planes) >= EXACT:
        queries = np.vectorize(int, otypes=[object])(queries)  # whole numbers of any size, slower
    least, most = np.minimum(queries, 0).sum(axis=1), np.maximum(queries, 0).sum(axis=1)
    bound, pairs = low.astype(queries.dtype), None
    dense, left = np.zeros(allowed.shape, queries.dtype), allowed
    for i in range(len(planes)):
        weight = 1 << (len(planes) - 1 - i)
        rest, bits = weight - 1, planes[i]
        if pairs is None and 4 * np.count_nonzero(left) <= left.size:
            who, col = np.nonzero(left)
            pairs = who, col, dense[who, col]
        if pairs is None:
            dense += (weight if i else -weight) * (queries @ bits[columns].T.astype(queries.dtype))
            lower, upper = dense + (rest * least)[:, None], dense + (rest * most)[:, None]
            left = left & (upper >= bound[:, None]) & (lower <= high[:, None])
            if k is not None and k <= left.shape[1]:
                sure = np.where(left & (upper <= high[:, None]), lower, -np.inf)
                bound = np.maximum(bound, np.partition(sure, left.shape[1] - k, axis=1)[:, left.shape[1] - k])
                left &= upper >= bound[:, None]
            continue
        who, col, score = pairs
        for a in range(0, len(who), 1 << 15):
            z = slice(a, a + (1 << 15))
            score[z] += (weight if i else -weight) * (queries[who[z]] * bits[columns[col[z]]]).sum(axis=1)
        lower, upper = score + rest * least[who], score + rest * most[who]
        if k is not None:
            sure = np.nonzero(upper <= high[who])[0]
            sure = sure[np.lexsort((-lower[sure].astype(float), who[sure]))]
            kth = np.searchsorted(who[sure], np.arange(len(queries))) + k - 1
            full = np.nonzero(kth < len(sure))[0]
            full = full[who[sure[kth[full]]] == full]
            bound[full] = np.maximum(bound[full], lower[sure[kth[full]]])
        kept = (upper >= bound[who]) & (lower <= high[who])
        pairs = who[kept], col[kept], score[kept]
    if pairs is None:
        who, col = np.nonzero(left)
        pairs = who, col, dense[who, col]
    return pairs


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, size: int, k: int):
        self.k, self.score, self.id = k, np.full((size, k), NONE), np.full((size, k), np.iinfo(np.int64).max)

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of queries ``who``, ascending."""
        for w in np.unique(who):
            a, z = np.searchsorted(who, [w, w + 1])
            s, d = np.concatenate([self.score[w], score[a:z]]), np.concatenate([self.id[w], ids[a:z]])
            order = np.lexsort((d, -s))[: self.k]
            self.score[w], self.id[w] = s[order], d[order]

    def floor(self) -> np.ndarray:
        return self.score[:, -1]


def shards_of(rows: DataFrame, shard_rows: int) -> DataFrame:
    """Bit-sliced shards of (id, label, v), sorted by label, in the shared folder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            held.clear()
            table = table.take(pa.array(np.argsort(table["label"].to_numpy(), kind="stable")))
            vectors = integers(table["v"])
            columns = [table["id"].to_numpy().tobytes(), table["label"].to_numpy().tobytes(), sliced(vectors), vectors.shape[1]]
            return pa.RecordBatch.from_pydict({"ids": pa.array(columns[:1], pa.binary()), "labels": pa.array(columns[1:2], pa.binary()), "planes": pa.array(columns[2:3], pa.list_(pa.binary())), "dims": pa.array(columns[3:], pa.int32())})

        for batch in batches:
            for a in range(0, batch.num_rows, shard_rows):
                held.append(batch.slice(a, shard_rows))
                if sum(x.num_rows for x in held) >= shard_rows:
                    yield settle()
        if held:
            yield settle()

    return stored(rows.mapInArrow(cut, SHARD), large_rows=True)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Planes]]:
    for batch in batches:
        for row in range(batch.num_rows):
            ids, labels = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int64) for c in (0, 1))
            yield ids, labels, Planes(batch.column(2)[row].as_py(), len(ids), batch.column(3)[row].as_py())


def mine_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    positives: int = 5,
    negatives: int = 5,
    least_percent: int = 80,
    most_percent: int = 100,
    shard_rows: int = 4096,
    block_rows: int = 1 << 14,
    tile: int = 256,
) -> DataFrame:
    """Hard negatives for each anchor and each of its positives, by integer inner product.

    ``vector`` holds whole numbers (as doubles), ``label`` is a column or its
    name. An anchor's positives are its ``positives`` best other rows of the
    same label, its negatives for one of them the ``negatives`` best rows of
    another label with ``least_percent`` * positive <= 100 * negative <=
    ``most_percent`` * positive; ties go to the smaller id. Returns anchor_id,
    positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows stay in the task that reads them, as bit-sliced shards of
    ``shard_rows`` in the shared folder, which are read once for the positives
    and once for the negatives of each block of ``block_rows`` anchors; a block
    is what is sent to all tasks. A task keeps its best for each anchor, or
    anchor and positive, so only those are shuffled.

    Rows without an id, a label or a vector, and vectors with a null, NaN or
    infinite component, take no part. Missing dimensions count as 0; scores
    have to fit 64 bits. A repeated anchor id is one anchor, the row of its
    smallest label and vector, and rows of the anchor's own id are no
    candidates; other repeated ids are candidates each on their own, so a
    positive may come twice, each with its negatives. Empty tables and anchors
    without positives give no rows.
    """
    spark = vectors.sparkSession
    named = quoted(label) if isinstance(label, str) else label
    whole = ~F.exists(quoted(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(quoted(key).cast("long").alias("id"), named.cast("long").alias("label"), F.when(whole, quoted(vector)).cast("array<double>").alias("v"), is_anchor.alias("anchor"))
    rows = rows.where("id is not null and label is not null and v is not null")
    shards = shards_of(rows.select("id", "label", "v"), shard_rows)
    anchors = rows.where("anchor").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    anchors = checkpointed(anchors)
    blocks, found = max(1, -(-anchors.count() // block_rows)), None
    for b in range(blocks):
        block = anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("label", "id").toArrow()
        asked = spark.sparkContext.broadcast((block["id"].to_numpy(), block["label"].to_numpy(), integers(block["v"])))

        def same_label(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            q_ids, q_labels, own = asked.value
            best = Best(len(q_ids), positives)
            for ids, labels, planes in opened(batches):
                for one in np.unique(q_labels):
                    a, z = np.searchsorted(q_labels, [one, one + 1])
                    columns = np.arange(*np.searchsorted(labels, [one, one + 1]))
                    for q in range(a, z, tile) if len(columns) else ():
                        to = min(q + tile, z)
                        allowed = ids[columns] != q_ids[q:to, None]
                        high = np.full(to - q, np.iinfo(np.int64).max)
                        who, col, score = products(own[q:to], planes, columns, best.floor()[q:to], high, allowed, positives)
                        best.add(who + q, score.astype(np.int64), ids[columns[col]])
            yield from listed(best, {"anchor_id": q_ids})

        shape = "anchor_id long, other_id long, score long"
        top = W.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
        near = shards.mapInArrow(same_label, shape).withColumn("place", F.row_number().over(top)).where(F.col("place") <= positives)
        near = checkpointed(near)
        pairs = near.orderBy("anchor_id", "place").toArrow()
        at = {int(i): n for n, i in enumerate(block["id"].to_numpy())}
        line = np.array([at[i] for i in pairs["anchor_id"].to_pylist()], np.int64)
        order = np.argsort(line, kind="stable")
        known = spark.sparkContext.broadcast((line[order], pairs["place"].to_numpy()[order], pairs["score"].to_numpy()[order]))

        def other_label(batches: Iterator[pa.RecordBatch], asked=asked, known=known) -> Iterator[pa.RecordBatch]:
            q_ids, q_labels, own = asked.value
            line, place, positive = known.value
            # the scores that a negative may have, in whole numbers: the first rounds up, the second down
            low, high = -(-least_percent * positive // 100), most_percent * positive // 100
            best, used = Best(len(line), negatives), np.unique(line)
            for ids, labels, planes in opened(batches):
                columns = np.arange(len(ids))
                for first in range(0, len(used), tile):
                    some = used[first : first + tile]
                    a, z = np.searchsorted(line, some), np.searchsorted(line, some, "right")
                    floors = np.maximum(low, best.floor())
                    floor = np.array([floors[x:y].min() for x, y in zip(a, z)])
                    ceiling = np.array([high[x:y].max() for x, y in zip(a, z)])
                    allowed = labels != q_labels[some, None]
                    # the best of each positive lie under different ceilings, so the windows alone drop pairs
                    who, col, score = products(own[some], planes, columns, floor, ceiling, allowed, None)
                    score = score.astype(np.int64)
                    for n in range(positives):
                        has = a + n < z
                        pair = np.where(has, np.minimum(a + n, len(line) - 1), 0)[who]
                        fits = has[who] & (score >= floors[pair]) & (score <= high[pair])
                        best.add(pair[fits], score[fits], ids[columns[col[fits]]])
            yield from listed(best, {"anchor_id": q_ids[line], "place": place})

        shape = "anchor_id long, place int, other_id long, score long"
        top = W.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "other_id")
        far = shards.mapInArrow(other_label, shape).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= negatives)
        far = far.withColumnsRenamed({"other_id": "negative_id", "score": "negative_score"})
        part = far.join(near.withColumnsRenamed({"other_id": "positive_id", "score": "positive_score"}), ["anchor_id", "place"])
        part = part.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
        part = checkpointed(part) if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    return found


def listed(best: Best, names: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    who, col = np.nonzero(best.score > NONE)
    for a in range(0, len(who), 1 << 16):
        w, c = who[a : a + (1 << 16)], col[a : a + (1 << 16)]
        columns = {k: pa.array(v[w], pa.int32() if k == "place" else pa.int64()) for k, v in names.items()}
        yield pa.RecordBatch.from_pydict(columns | {"other_id": best.id[w, c], "score": best.score[w, c]})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    finite = F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x))
    own = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", own.alias("label"), F.when(~F.exists(finite, F.isnull), whole).alias("embedding"))
    return mine_negatives(rows, F.col("vec_id") % 100 == 0)


SQL = r"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS other_id, c.r AS r,
    CAST(list_sum(list_transform(generate_series(1, least(len(a.v), len(c.v))), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM s WHERE same),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, place ORDER BY score DESC, other_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score WHERE place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
