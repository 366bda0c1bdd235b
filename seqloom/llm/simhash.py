"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import carried, checkpointed, hot_rows, quoted, read

BITS, SEED = 64, 42
#: Bit ranges, each of which a variant hides in turn.
BLOCKS = ((0, 22), (22, 43), (43, 64))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bits that are set in over half the XXH64 values of the text's word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    if len(words) > shingle:
        start, end = start[: 1 - shingle], end[shingle - 1 :]
    else:
        start, end = start[:1], end[-1:]
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start.tolist(), end.tolist())), "<u8", len(start))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", shingle: int = 3) -> DataFrame:
    """``docs`` with a signed 64-bit fingerprint of each text; no words: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("hashed"))
            prints = pa.array([fingerprint(t.as_py(), shingle) for t in column], pa.int64())
            yield batch.append_column(name, prints)

    packed = docs.select(*[quoted(c).alias(f"in_{c}") for c in docs.columns], quoted(text).alias("hashed"))
    out = packed.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in packed.schema)}, {name} long")
    return out.select(*[F.col(f"`in_{c}`").alias(c) for c in docs.columns if c.lower() != name], name)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mask(low: int, high: int) -> int:
    return signed(sum(1 << i for i in range(low, high)))


def thirds(low: int, high: int) -> list[tuple[int, int]]:
    """A bit range in three parts (two, if it has only two bits)."""
    cuts = sorted({low, high - 2 * (high - low) // 3, high - (high - low) // 3, high})
    return list(zip(cuts, cuts[1:]))


def choice(place: int, hidden: tuple[int, int], flip: int | None, either: bool = True) -> Column:
    bit = 0 if flip is None else mask(flip, flip + 1)
    return F.struct(F.lit(place).alias("place"), F.lit(mask(*hidden)).cast("long").alias("hidden"), F.lit(bit).cast("long").alias("flip"), F.lit(either).alias("either"))


def dealt(rows: DataFrame) -> DataFrame:
    """Members (fp, root, value) with a choice x: where they meet, by the value with its flip and without the hidden bits."""
    value = F.col("value").bitwiseXOR(F.col("x.flip"))
    out = rows.select("fp", "root", F.col("x.place").alias("place"), value.alias("value"), "x.hidden")
    return out.select("fp", "root", "place", "value", F.col("value").bitwiseAND(F.bitwise_not("hidden")).alias("variant"))


def links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all fingerprints that differ in 3 bits or fewer; every edge is such a pair."""
    return linked(prints)[0]


def linked(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of ``links``, and (node, root): the components of all fingerprints with an edge, by their least node.

    Half the radius is one and a half: each fingerprint emits, for each of 3
    blocks of 22, 21 and 21 bits, its other bits with none or one of them flipped.
    Of two that differ in up to 3 bits, either one block holds two of them or
    more and hides them, or each block holds one at most; then the first block
    hides one and the rest, one in each other block, meet halfway. Pairs have two
    meeting points that mirror each other; one is left out by flipping bits only
    from 1 to 0, but for those of the second block where the first is hidden (77
    variants on average instead of 131). What meets is verified against the
    least fingerprint there, which gives one edge a member.

    Members that are farther from the least than 3 may still be linked to each
    other. Where the edges so far leave their group in more than one component,
    it is parted again in the same way: each third of the hidden bits stays
    hidden in turn, and a member that has flipped no bit may flip one of the
    others. After three more levels one bit is hidden, and all that remain
    together differ in 3 at most. A group adds one edge for each member, never
    all pairs. A group is what lies within one flip of the same 42 or 43 bits,
    counted once for each fingerprint, however many documents have it.
    """
    first = []
    for b, hidden in enumerate(BLOCKS):
        for flip in [None, *(i for i in range(BITS) if not hidden[0] <= i < hidden[1])]:
            either = flip is None or (b == 0 and BLOCKS[1][0] <= flip < BLOCKS[1][1])
            first.append(choice(b, hidden, flip, either))
    rows = prints.select("fp", F.col("fp").alias("root"), F.col("fp").alias("value"), F.explode(F.array(*first)).alias("x"))
    rows = dealt(rows.where(F.col("x.either") | (F.col("fp").bitwiseAND(F.col("x.flip")) != 0)))
    meet, ranges, edges, roots = W.partitionBy("place", "variant"), list(BLOCKS), None, None
    while True:
        rows = rows.withColumn("least", F.min(F.struct("fp", "root")).over(meet))
        rows = rows.withColumn("apart", F.bit_count(F.col("fp").bitwiseXOR(F.col("least.fp"))))
        rows = checkpointed(rows.withColumn("far", F.max("apart").over(meet) > 3).where("root <> least.root or far"))
        found = rows.where("apart <= 3 and root <> least.root")
        found = checkpointed(found.select(F.col("fp").alias("u"), F.col("least.fp").alias("v"), "root", F.col("least.root").alias("to")).distinct())
        edges = found.select("u", "v") if edges is None else edges.unionByName(found.select("u", "v"))
        rooted = wide = rows.where("far").select("fp", "root", "place", "value", "variant")
        if roots is None or not found.isEmpty():
            moved = components(found.select(F.col("root").alias("u"), F.col("to").alias("v")))
            if roots is None:
                roots = moved
            else:
                now = moved.select(F.col("node").alias("root"), F.col("root").alias("now"))
                kept = roots.join(now, "root", "left").select("node", F.coalesce("now", "root").alias("root"))
                roots = checkpointed(kept.unionByName(moved.join(roots, "node", "left_anti")))
            rooted = wide.join(moved.withColumnRenamed("root", "now"), F.col("root") == F.col("node"), "left")
            rooted = rooted.select("fp", F.coalesce("now", "root").alias("root"), "place", "value", "variant")
        if len(ranges) == BITS or wide.isEmpty():
            return edges.distinct(), roots
        # only what the edges so far leave in several components is parted again
        sides = rooted.groupBy("place", "variant").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.max(F.col("value") == F.col("fp")).alias("plain")).where("a <> z")
        # at first, two members that have both flipped a bit need each other only where the first block is hidden
        sides = sides.where("plain or place = 0") if len(ranges) == len(BLOCKS) else sides
        left = rooted.join(sides.select("place", "variant"), ["place", "variant"], "left_semi")
        steps, below = [], []
        for low, high in ranges:
            own = []
            for part in thirds(low, high):
                own += [choice(len(below), part, flip) for flip in [None, *(i for i in range(low, high) if not part[0] <= i < part[1])]]
                below.append(part)
            steps.append(F.array(*own))
        ranges = below
        every = F.element_at(F.array(*steps), F.col("place") + 1)
        may = F.when(F.col("value") == F.col("fp"), every).otherwise(F.filter(every, lambda x: x["flip"] == 0))
        rows = dealt(left.select("fp", "root", "value", F.explode(may).alias("x")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v), u <> v; a root is its component's least node.

    Large-star and small-star rounds: each node's neighbours, then its smaller
    neighbours, are hung on the least of them. Sums are made before rows are
    dealt out and the least neighbour is joined on, so a node with very many
    edges is split like any skewed join key. Each round is checkpointed.
    """
    now = checkpointed(edges.select("u", "v").distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(small.unionByName(below.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, keep: Iterable[str] | None = None
) -> DataFrame:
    """Fingerprint and component of every document; fingerprints link at 3 or fewer differing bits.

    Equal fingerprints are collapsed to one row first, so a group of copies,
    however large, is one member of the ball hashing; texts are never shuffled.

    Returns ``keep`` (all input columns by default), fp (signed long),
    component_id, the least id that is reachable, and component_root, the
    component's least fingerprint; they replace input columns of those names. Null texts and texts without words have fingerprint 0 and link
    like others. A null id is passed over when the least is taken, and a
    component without any id has a null component_id. Repeated rows have the
    same result. An empty table gives an empty result.
    """
    own = carried(docs, keep, ("fp", "component_id", "component_root"))
    named = docs.select(*[quoted(c).alias(f"in_{c}") for c in own], quoted(key).alias("id"), quoted(text).alias("text"))
    rows = checkpointed(fingerprints(named, "text", shingle=shingle).drop("text"))
    prints = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least_id"), F.count("*").alias("n")))
    _, roots = linked(prints.select("fp"))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp")
    by_root = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    rooted = rooted.join(by_root, "root").select("fp", "component_id", "root")
    alone = F.col("root").isNull()
    of = prints.join(rooted, "fp", "left").select(
        F.col("fp").alias("p"),
        F.when(alone, F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("root", "fp").alias("component_root"),
        "n",
    )
    # a fingerprint with a great share of the rows would fill one task of the join: the few such go to every task
    total = prints.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = checkpointed(of.where(F.col("n") > hot_rows(total)).drop("n"))
    often = rows.join(F.broadcast(hot), F.col("fp") == F.col("p"), "left")
    rare = often.where(F.col("p").isNull()).drop(*hot.columns).join(of.drop("n"), F.col("fp") == F.col("p"), "left")
    found = often.where(F.col("p").isNotNull()).unionByName(rare)
    return found.select(*[quoted(f"in_{c}").alias(c) for c in own], "fp", "component_id", "component_root")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One document of each component, all columns unchanged: that of the least id, nulls last, then of the least text hash.

    Texts are moved to meet the chosen (id, text hash) pairs. Of rows that repeat
    both, one stays; they are thinned out before they are dealt by their pair, so
    a row that is repeated very often does not fill a task.
    """
    digest = lambda: F.coalesce(F.md5(quoted(text)), F.lit(""))
    named = docs.select(quoted(key).alias("id"), quoted(text).alias("text"), digest().alias("digest"))
    found = near_duplicates(named, "id", "text", shingle, keep=["id", "digest"])
    best = F.min(F.struct(F.isnull("id").alias("none"), "id", "digest")).alias("best")
    chosen = found.groupBy("component_root").agg(best).select(F.col("best.id").alias("chosen_id"), F.col("best.digest").alias("chosen"))
    row = F.struct(*[quoted(c) for c in docs.columns]).alias("row")
    rows = docs.select(row, quoted(key).alias("own_id"), digest().alias("own"))
    kept = rows.join(chosen, F.col("own_id").eqNullSafe(F.col("chosen_id")) & (F.col("own") == F.col("chosen")), "left_semi")
    return kept.dropDuplicates(["own_id", "own"]).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
