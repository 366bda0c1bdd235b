"""Removal of repeated byte strings by suffix arrays of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import owned
from .common import HOT_ROWS, carried, checkpointed, hot_rows, quoted, read, slices, spread_join, utf8
from .induced import permuted_prefixes, suffix_array

SEPARATOR = 1
ROWS = "h binary, firsts array<int>, size int, anchor long, kind long"


def emit(batch: pa.RecordBatch, width: int, half: int) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """Text numbers and anchors of the texts of a batch (column ``t``), a slice of about 1 MB at a time."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index("t")))
    for low, high in slices(offsets, 1 << 20):
        found = owned(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], width, half)
        yield found["doc"] + low, found


def shard(regions: list[bytes], width: int) -> list[np.ndarray]:
    """For each region which of its windows also stand elsewhere in the shard.

    The regions are joined with separators and sorted by induction; windows are
    equal where neighbours in the suffix order share ``width`` bytes.
    """
    size = np.array([len(r) for r in regions])
    start = np.concatenate([[0], np.cumsum(size + 1)])
    s = np.full(start[-1] + 1, SEPARATOR, np.uint16)
    joined = np.frombuffer(b"".join(regions), np.uint8).astype(np.uint16) + 2
    s[np.arange(len(joined)) + np.repeat(np.arange(len(regions)), size)] = joined
    s[-1] = 0
    before, common = permuted_prefixes(s, suffix_array(s), SEPARATOR)
    equal = np.flatnonzero(common >= width)
    found = np.zeros(len(s), bool)
    found[equal] = found[before[equal]] = True
    return [found[a : a + n - width + 1] for a, n in zip(start, size)]


def spans_of(flags: np.ndarray) -> list[int]:
    """Starts and ends (exclusive), in turn, of the runs of set flags."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).tolist()


def repeated_windows(docs: DataFrame, width: int, half: int, shard_bytes: int, most: int) -> DataFrame:
    """(h, found): for texts by hash, the places of anchors and which of their windows stand elsewhere in the corpus.

    Every window of a text is owned by an anchor, a substring in it that its
    content alone determines, so equal windows meet at equal anchors. Regions
    (all windows of one anchor) are counted first: copies collapse into one
    row, whose windows are all repeated, and an anchor that stands alone needs
    no more. Different regions of one anchor are brought together in shards of
    about ``shard_bytes``, where a suffix array finds the windows they share.
    An anchor with more than ``most`` regions is dealt over several shards;
    windows that such a shard has not settled meet those of the others by hash.
    """
    texts = docs.select(F.unhex(F.md5("t")).alias("h"), "t").where(F.octet_length("t") >= width)

    def anchors(batches: Iterator[pa.RecordBatch], once: bool = False) -> Iterator[pa.RecordBatch]:
        """``once``: of the copies of a text in a partition only the first."""
        seen: set[bytes] = set()
        for batch in batches:
            h = batch.column(batch.schema.get_field_index("h"))
            if once:
                new = [x not in seen and not seen.add(x) for x in h.to_pylist()]
                batch = batch.filter(pa.array(new, pa.bool_()))
                h = batch.column(batch.schema.get_field_index("h"))
            for doc, found in emit(batch, width, half):
                # a text that repeats itself has the same region many times: one row, with all places
                by = np.lexsort((found["first"], found["kind"], found["anchor"], doc))
                doc, anchor, kind, first = doc[by], found["anchor"][by], found["kind"][by], found["first"][by].astype(np.int32)
                new = np.ones(len(by), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (kind[1:] != kind[:-1])
                head = np.flatnonzero(new)
                firsts = pa.ListArray.from_arrays(pa.array(np.append(head, len(by)), pa.int32()), pa.array(first))
                size = (found["last"] - found["first"] + 1).astype(np.int32)[by][head]
                yield pa.RecordBatch.from_pydict({"h": h.take(pa.array(doc[head])), "firsts": firsts, "size": size, "anchor": anchor[head], "kind": kind[head]})

    rows = texts.mapInArrow(anchors, ROWS)
    regions = rows.groupBy("anchor", "kind").agg(F.sum(F.size("firsts")).alias("n"), F.min(F.struct("h", F.col("firsts")[0].alias("first"), "size")).alias("at"))
    # an anchor of very many regions is summed before it is dealt, and split by the join
    shared = regions.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where(F.col("all") > 1)
    regions = checkpointed(regions.join(shared.select("anchor", "kinds"), "anchor").select("anchor", "kind", "n", "kinds", "at.*"))

    several = regions.where("kinds > 1")
    shards = max(1, -(-(several.agg(F.sum(F.col("size") + width)).first()[0] or 0) // shard_bytes))
    parts = F.ceil(F.col("kinds") / most).cast("int")
    split = F.when(parts > 1, F.pmod("kind", parts)).otherwise(0)
    wanted = several.withColumn("shard", F.pmod(F.xxhash64("anchor", split), F.lit(shards)).cast("int"))
    wanted = wanted.select("h", F.struct("anchor", "kind", "first", "size", "shard", (parts > 1).alias("parted")).alias("x"))
    lists = wanted.groupBy("h").agg(F.collect_list("x").alias("wanted"))
    one = texts.groupBy("h").agg(F.first("t").alias("t")).join(lists, "h")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, each in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode()
                found = each.as_py()
                region = [raw[x["first"] : x["first"] + x["size"] + width - 1] for x in found]
                yield pa.RecordBatch.from_pydict(
                    {
                        **{k: pa.array([x[k] for x in found], pa.int64()) for k in ("anchor", "kind")},
                        "shard": pa.array([x["shard"] for x in found], pa.int32()),
                        "parted": pa.array([x["parted"] for x in found], pa.bool_()),
                        "region": pa.array(region, pa.binary()),
                    }
                )

    def settle(table: pa.Table) -> pa.Table:
        regions = table["region"].to_pylist()
        runs, open_, marks = [], [], []
        for region, flags, parted in zip(regions, shard(regions, width), table["parted"].to_pylist()):
            runs.append(spans_of(flags))
            if parted:  # one of each window, settled or not, is told to the other shards
                open_.append(list(range(len(flags))))
                marks.append([hashlib.blake2b(region[i : i + width], digest_size=16).digest() for i in range(len(flags))])
            else:
                open_.append([])
                marks.append([])
        return pa.table(
            {
                "anchor": table["anchor"],
                "kind": table["kind"],
                "runs": pa.array(runs, pa.list_(pa.int32())),
                "open": pa.array(open_, pa.list_(pa.int32())),
                "marks": pa.array(marks, pa.list_(pa.binary())),
            }
        )

    bytes_of = one.select("t", "wanted").mapInArrow(cut, "anchor long, kind long, shard int, parted boolean, region binary")
    found = checkpointed(bytes_of.groupBy("shard").applyInArrow(settle, "anchor long, kind long, runs array<int>, open array<int>, marks array<binary>"))
    windows = found.select("anchor", "kind", F.explode(F.arrays_zip("open", "marks")).alias("x")).select("anchor", "kind", "x.open", "x.marks")
    known = windows.groupBy("marks").agg(F.count("*").alias("m")).where("m > 1").select(F.col("marks").alias("mark"))
    across = windows.join(known, F.col("marks") == F.col("mark")).groupBy("anchor", "kind").agg(F.collect_set("open").alias("open"))
    more = across.select("anchor", "kind", F.flatten(F.transform(F.array_sort("open"), lambda i: F.array(i, i + 1))).alias("runs"))
    whole = regions.where("n > 1").select("anchor", "kind", F.array(F.lit(0), F.col("size")).alias("runs"))
    single = regions.where("n = 1").select("anchor", "kind")
    partly = found.select("anchor", "kind", "runs").unionByName(more).where(F.size("runs") > 0).join(single, ["anchor", "kind"], "left_semi")
    results = whole.unionByName(partly).groupBy("anchor", "kind").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    places = texts.mapInArrow(lambda batches: anchors(batches, once=True), ROWS).select("h", "firsts", "anchor", "kind")
    total = regions.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = checkpointed(regions.where(F.col("n") > hot_rows(total)).select("anchor", "kind"))
    return spread_join(places, results, ["anchor", "kind"], hot).groupBy("h").agg(F.collect_set(F.struct("firsts", "runs")).alias("found"))


def remove_repeats(
    docs: DataFrame,
    text: str = "text",
    width: int = 400,
    half: int = 128,
    keep: Iterable[str] | None = None,
    cleaned: bool = False,
    shard_bytes: int = 1 << 20,
    most: int = 1000,
) -> DataFrame:
    """Remove every byte that is covered by a string of ``width`` bytes that also starts elsewhere.

    Texts are taken as UTF-8; matches lie within one document, may overlap, and
    are judged on the input. Copies of a document count as elsewhere.

    Returns ``keep`` (all input columns by default), n_bytes, n_removed,
    n_spans (maximal removed runs), kept_sha256, and with ``cleaned`` the bytes
    that remain as kept; they replace input columns of these names. A null text
    counts as empty: nothing is removed. Repeated rows have the same result;
    an empty table gives an empty result.
    """
    new = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    own = carried(docs, keep, new)
    named = docs.select(*[quoted(c).alias(f"in_{c}") for c in own], F.coalesce(quoted(text), F.lit("")).alias("t"))
    by_text = repeated_windows(named.select("t"), width, half, shard_bytes, most)
    hashed = named.withColumn("h", F.unhex(F.md5("t")))
    copies = checkpointed(hashed.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS))
    hot = copies.where(F.col("n") > hot_rows(docs.count())).select("h")
    rows = spread_join(hashed, by_text, ["h"], hot, "left").drop("h")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = (batch.column(batch.schema.get_field_index(c)) for c in ("t", "found"))
            out: dict[str, list] = {k: [] for k in new}
            for text, each in zip(texts, lists):
                raw = text.as_py().encode()
                at, kept, removed, spans = 0, [], 0, 0
                if each.is_valid:
                    runs = sorted((f + a, f + b - 1 + width) for x in each.as_py() for f in x["firsts"] for a, b in zip(x["runs"][::2], x["runs"][1::2]))
                    merged: list[list[int]] = []
                    for a, b in runs:
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    for a, b in merged:
                        kept.append(raw[at:a])
                        at, removed, spans = b, removed + b - a, spans + 1
                rest = b"".join([*kept, raw[at:]])
                for k, v in zip(new, (len(raw), removed, spans, hashlib.sha256(rest).hexdigest(), rest)):
                    out[k].append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [batch.column(batch.schema.get_field_index(f"in_{c}")) for c in own]
            arrays += [pa.array(out[k], t) for k, t in list(zip(new, types))[: None if cleaned else -1]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*[f"in_{c}" for c in own], *new[: None if cleaned else -1]])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in named.schema if f.name != "t")
    schema = f"{kept}n_bytes long, n_removed long, n_spans long, kept_sha256 string{', kept binary' if cleaned else ''}"
    out = rows.mapInArrow(remove, schema)
    return out.select(*[quoted(f"in_{c}").alias(c) for c in own], *new[: None if cleaned else -1])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), keep=["doc_id"])


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(b[i:i + 399]) AS s FROM (
  SELECT r, b, unnest(generate_series(1, octet_length(b) - 399)) AS i FROM d WHERE octet_length(b) >= 400)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM w) WHERE n > 1),
g AS (SELECT r, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS run
  FROM (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400, true) AS fresh FROM m)),
spans AS (SELECT r, min(i) AS a, max(i) + 399 AS z FROM g GROUP BY r, run),
pieces AS (
  SELECT r, a AS place, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS low, a - 1 AS high FROM spans
  UNION ALL SELECT r, max(z) + 1, max(z) + 1, 9223372036854775807 FROM spans GROUP BY r),
kept AS (SELECT r, sha256(unhex(string_agg(hex(b[low:least(high, octet_length(b))]), '' ORDER BY place))) AS digest
  FROM pieces JOIN d USING (r) GROUP BY r),
counts AS (SELECT r, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, coalesce(digest, sha256(b)) AS kept_sha256
FROM d LEFT JOIN counts USING (r) LEFT JOIN kept USING (r)
"""
