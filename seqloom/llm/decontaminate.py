"""Benchmark decontamination with an FM-index for each training shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, quoted, read, slices, stored, utf8

OUT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
#: Bytes that make up words, after A-Z are lower-cased: 0-9, a-z and all of non-ASCII.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (bytes), text number and 64-bit hash of every word of the texts."""
    data = FOLD[data]
    inside = letters[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    # sum of byte * BASE^position over the word, moved to position 0
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=total[1:])
    mark = (total[end] - total[start]) * powers(UNBASE, len(data) + 1)[start]
    mark ^= mark >> np.uint64(32)
    return start, end, np.searchsorted(offsets, start, "right") - 1, mark


class Phrases:
    """Distinct windows of the test items over a vocabulary of their words (symbols from 1)."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        texts = pa.array([t for _, t in items], pa.large_string())
        data, offsets = utf8(texts)
        start, end, item, mark = words(data, offsets)
        folded = FOLD[data].tobytes()
        self.marks, first, symbol = np.unique(mark, return_index=True, return_inverse=True)
        self.spelled = [folded[start[i] : end[i]] for i in first]
        symbol = symbol.astype(np.int64) + 1
        self.names = [n for n, _ in items]
        found: dict[bytes, list[int]] = {}
        sizes: dict[bytes, int] = {}
        cut = np.searchsorted(item, np.arange(len(items) + 1))
        for i in range(len(items)):
            own = symbol[cut[i] : cut[i + 1]]
            size = min(width, len(own))
            for at in range(len(own) - size + 1 if size else 0):
                window = own[at : at + size].tobytes()
                sizes[window] = size
                holders = found.setdefault(window, [])
                if not holders or holders[-1] != i:
                    holders.append(i)
        self.sizes = np.array(list(sizes.values()), np.int64)
        self.windows = np.zeros((len(sizes), width), np.int64)  # filled from the right, zeros before
        for row, window in enumerate(sizes):
            self.windows[row, width - sizes[window] :] = np.frombuffer(window, np.int64)
        self.holders = list(found.values())


class Index:
    """FM-index of a symbol sequence: wavelet matrix over the BWT and sampled suffix positions.

    The sequence must end in 0, which stands nowhere else: so no two rotations
    are equal, and every step back leads to a sampled position.
    """

    def __init__(self, text: np.ndarray, every: int = 8):
        n = len(text)
        order = suffixes(text)
        bwt = text[order - 1]
        self.n, self.levels = n, []
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text))])
        for bit in reversed(range(max(1, int(text.max()).bit_length()))):
            ones = (bwt >> bit) & 1
            before = np.concatenate([[0], np.cumsum(ones)])
            self.levels.append((bit, before, n - int(before[-1])))
            bwt = np.concatenate([bwt[ones == 0], bwt[ones == 1]])
        sampled = order % every == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.sample = order[sampled]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the BWT before each place."""
        low = np.zeros(len(at), np.int64)
        for bit, before, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            a, b = before[at], before[low]
            at, low = np.where(one, zeros + a, at - a), np.where(one, zeros + b, low - b)
        return at - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for bit, before, zeros in self.levels:
            one = before[at + 1] > before[at]
            out |= one.astype(np.int64) << bit
            at = np.where(one, zeros + before[at], at - before[at])
        return out

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and position in the text of each occurrence of the windows (zeros on the left are no part)."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        for j in range(windows.shape[1] - 1, -1, -1):
            s = windows[:, j]
            on = (s > 0) & (low < high)
            known = on & (s < len(self.starts) - 1)
            high[on & ~known] = low[on & ~known]
            s, at = s[known], self.starts[s[known]]
            low[known], high[known] = at + self.rank(s, low[known]), at + self.rank(s, high[known])
        size = high - low
        row = np.repeat(np.arange(len(windows)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        return row, self.locate(at)

    def locate(self, at: np.ndarray) -> np.ndarray:
        out, steps, open_ = np.zeros(len(at), np.int64), 0, np.arange(len(at))
        while len(open_):
            hit = self.sample_rank[at + 1] > self.sample_rank[at]
            out[open_[hit]] = self.sample[self.sample_rank[at[hit]]] + steps
            at, open_ = at[~hit], open_[~hit]
            s = self.symbol(at)
            at = self.starts[s] + self.rank(s, at)
            steps += 1
        return out


def suffixes(text: np.ndarray) -> np.ndarray:
    """Suffix order of a sequence with a last symbol of its own, by sorting ever longer prefixes (times three a round)."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    width, length = max(1, n).bit_length(), 1
    parts = 3 if 3 * width <= 63 else 2
    open_ = np.arange(n)
    while len(open_):
        key = rank[open_].astype(np.int64)
        for j in range(1, parts):
            key = (key << width) | rank[(open_ + j * length) % n]
        by = np.argsort(key, kind="stable")
        key, open_ = key[by], open_[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        # the rank of a suffix is the number of smaller ones: that of its group so far, and those before it there
        group = rank[open_]
        first = np.concatenate([[True], group[1:] != group[:-1]])
        base = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        if length == 1:
            rank = np.empty(n, np.int64)
            rank[open_] = head
        else:
            rank[open_] = group + head - base
        tied = ~new
        tied[:-1] |= ~new[1:]
        open_ = open_[tied]
        if length >= n:
            break
        length *= parts
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def scan(phrases: Phrases, column: pa.Array, shard_bytes: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """(words, numbers of hit words, items that occur) of each text, texts in order."""
    data, offsets = utf8(column)
    shortest = int(phrases.sizes.min()) if len(phrases.sizes) else 0
    for low, high in slices(offsets, shard_bytes):
        part = data[offsets[low] : offsets[high]]
        start, end, doc, mark = words(part, offsets[low : high + 1] - offsets[low])
        n_words = np.bincount(doc, minlength=high - low)
        hit = np.zeros(len(start) + 1, np.int64)
        items: dict[int, set[int]] = {}
        place = np.minimum(np.searchsorted(phrases.marks, mark), max(0, len(phrases.marks) - 1)) if shortest else None
        if place is not None:
            symbol = np.where(phrases.marks[place] == mark, place + 1, 0)
            # the shard: words outside the vocabulary, and edges of texts, become single separators
            edge = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
            run = np.cumsum((symbol == 0) | edge)
            length = np.bincount(run[symbol > 0], minlength=int(run[-1]) + 1 if len(run) else 1)
            kept = np.flatnonzero((symbol > 0) & (length[run] >= shortest))
        if place is not None and len(kept):
            new = np.flatnonzero(np.diff(run[kept], prepend=-1))
            text = np.insert(symbol[kept], new, len(phrases.marks) + 1)
            origin = np.insert(kept, new, -1)
            text, origin = np.append(text[1:], 0), np.append(origin[1:], -1)
            row, at = Index(text).search(phrases.windows)
            first = origin[at]
            folded = FOLD[part].tobytes()
            for r, w in zip(row, first):
                size = int(phrases.sizes[r])
                spelled = (folded[start[w + j] : end[w + j]] == phrases.spelled[symbol[w + j] - 1] for j in range(size))
                if all(spelled):
                    hit[w] += 1
                    hit[w + size] -= 1
                    items.setdefault(int(doc[w]), set()).update(phrases.holders[r])
        covered = np.cumsum(hit)[:-1] > 0
        edges = np.searchsorted(doc, np.arange(high - low + 1))
        for i in range(high - low):
            yield int(n_words[i]), np.flatnonzero(covered[edges[i] : edges[i + 1]]), sorted(items.get(i, ()))


def removal(text: str, hits: list[int]) -> str:
    """The text without the words of these numbers, in order, and what stands between two neighbours of them."""
    raw = text.encode()
    start, end, _, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    places = np.array(hits)
    first = np.flatnonzero(np.diff(places, prepend=-2) > 1)
    last = np.append(first[1:], len(places)) - 1
    edges = [0, *(int(e) for i, j in zip(first, last) for e in (start[places[i]], end[places[j]])), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    width: int = 13,
    share: float = 0.05,
    keep: Iterable[str] | None = None,
    cleaned: bool = False,
    shard_bytes: int = 2 << 20,
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """Which words of each document lie in a window of a benchmark item.

    Each task cuts its documents into shards and builds an FM-index of each
    shard's words (over the benchmark's vocabulary; other words, which no
    window holds, stand as separators): test windows go by backward search
    through the ranks of a wavelet matrix, occurrences are located by sampled
    suffix positions, checked letter by letter, and their spans are merged. No
    document leaves its task; only the benchmark is sent around, in blocks of
    at most about ``block_bytes`` of text. With several blocks each is a job
    whose result is written to the shared folder before the next is sent.

    Returns ``keep`` (all input columns by default), n_words, n_hit, n_items,
    items_sha256, contaminated, which replace input columns of these names, and
    with ``cleaned`` the text without its merged hit spans as clean_text. Null
    and empty texts have no words; items that are null or have no words match
    nothing; items that repeat an id count as one; a null item id counts as "".
    Rows that repeat are each judged. Empty tables give empty results.
    """
    spark = docs.sparkSession
    own = carried(docs, keep, (*OUT, "clean_text", "hit_items"))
    spec = benchmark.select(F.coalesce(quoted(item).cast("string"), F.lit("")).alias("item"), F.coalesce(quoted("text"), F.lit("")).alias("t"))
    total = spec.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    base = docs.select(*[quoted(c).alias(f"in_{c}") for c in own], quoted(text).alias("scanned"))
    # with more blocks than one, hit words of the blocks are united by their places
    base = base.withColumn("hits", F.array().cast("array<int>")).withColumn("held", F.array().cast("array<string>")).withColumn("n_words", F.lit(0).cast("long"))
    for b in range(blocks):
        rows = spec.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        phrases = spark.sparkContext.broadcast(Phrases([(r[0], r[1]) for r in rows], width))

        def run(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(batch.schema.get_field_index("scanned"))
                hits, held = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hits", "held"))
                n = []
                for i, (n_words, hit, items) in enumerate(scan(phrases.value, column, shard_bytes)):
                    n.append(n_words)
                    if len(hit):
                        hits[i] = sorted({*hits[i], *hit.tolist()})
                        held[i] = sorted({*held[i], *(phrases.value.names[x] for x in items)})
                new = {"hits": pa.array(hits, pa.list_(pa.int32())), "held": pa.array(held, pa.list_(pa.string())), "n_words": pa.array(n, pa.int64())}
                arrays = [new.get(f.name, batch.column(j)) for j, f in enumerate(batch.schema)]
                yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

        base = base.mapInArrow(run, base.schema)
        if blocks > 1:  # one block's phrases at a time
            base = stored(base)
            phrases.destroy()
    if cleaned:

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, hits = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("scanned", "hits"))
                clean = [removal(t, h) if h else t for t, h in zip(texts, hits)]
                yield batch.append_column("clean_text", pa.array(clean, pa.string()))

        base = base.mapInArrow(cut, base.withColumn("clean_text", F.lit(None).cast("string")).schema)
    n_hit = F.size("hits").cast("long")
    return base.select(
        *[quoted(f"in_{c}").alias(c) for c in own],
        "n_words",
        n_hit.alias("n_hit"),
        F.size("held").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("held"), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit + 1e-9 >= share * F.col("n_words"))).alias("contaminated"),
        *[F.col("clean_text")] * cleaned,
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


SQL = r"""
WITH d AS (
  SELECT rowid_ AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i
        FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT dw.r, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN t ON d.r = t.r
"""
