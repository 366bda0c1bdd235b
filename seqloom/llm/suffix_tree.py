"""Language-model scores by a probabilistic suffix tree over bytes, beside a word unigram baseline."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, carried, frugal, in_fold, quoted, read, slices, stored

#: Contexts have up to DEPTH symbols: with the symbol that follows they fill two 64-bit keys.
DEPTH = 15
#: Contexts shorter than MEET are counted for the whole corpus together; longer ones in the part of their last MEET symbols.
MEET = 4
#: Symbols are the bytes of words, and three white-space bytes that words never hold: before a word, after the last word, after a word.
START, END, GAP = 0x09, 0x0A, 0x20
#: The end of a text among the words, which are never empty.
END_WORD = b""
#: The first HEAD symbols of a word see the last TAIL bytes of the word before it, the others their own word alone.
HEAD, TAIL = 3, 3
#: Units are words, and joints: the end of a word, a gap and the first symbols of the next; each symbol of a text belongs to one.
WORD_UNIT, JOINT_UNIT = b"w", b"j"
#: Bytes of texts or units that a task is sent at once.
BATCH = 1 << 22
OUT = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def tokens(text: bytes | None, most: int = 1 << 24) -> Iterator[list[bytes]]:
    """Words of a text, A-Z lower-cased, a piece of about ``most`` bytes at a time, and at last the end."""
    text, at = text or b"", 0
    while at < len(text):
        cut = BLANK.search(text, at + most)
        to = cut.start() if cut else len(text)
        yield text[at:to].lower().split()
        at = to
    yield [END_WORD]


class Ends(dict):
    """What a word gives to the joints beside it, remembered for the words seen last."""

    def __init__(self, of: Callable[[bytes], bytes], most: int = 1 << 16):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = self.of(word)
        return out


TAILS = Ends(lambda word: word[-TAIL:] + b" ")
HEADS = Ends(lambda word: (word + b" ")[:HEAD] if word else b"\n")


def joints(words: list[bytes], before: bytes) -> list[bytes]:
    """The joint before each word; ``before`` is the word that precedes the first of them."""
    return list(map(add, map(TAILS.__getitem__, [before, *words[:-1]]), map(HEADS.__getitem__, words)))


#: An end of a word is three bytes and, above them, their number; a joint's number is those of the two ends beside its gap.
END_BITS = 26


def raw_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a binary array without nulls, and where each value begins and its length."""
    offsets = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset)
    data = values.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)


def packed(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of strings of at most 3 bytes."""
    out = size << 24
    for k in range(3):
        there = np.flatnonzero(size > k)
        out[there] |= raw[first[there] + k].astype(np.int64) << (8 * k)
    return out


def ends_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the last TAIL bytes of words, and of their first HEAD symbols."""
    raw, first, size = raw_of(words)
    n = np.minimum(size, TAIL)
    tails = packed(raw, first + size - n, n)
    n = np.minimum(size, HEAD)
    heads = packed(raw, first, n)
    gap = np.flatnonzero(n < HEAD)
    heads[gap] += (1 << 24) + (np.where(n[gap] > 0, GAP, END) << (8 * n[gap]))
    return tails, heads


def numbers_of(joints: pa.Array) -> np.ndarray:
    """Numbers of joints that are spelled out."""
    raw, first, size = raw_of(joints)
    gap = pc.find_substring(joints, b" ").to_numpy().astype(np.int64)
    return packed(raw, first, gap) << END_BITS | packed(raw, first + gap + 1, size - gap - 1)


def spelled(joints: np.ndarray, mark: bytes = b"") -> pa.Array:
    """The bytes of joints by number, after a mark."""
    rows = np.empty((len(joints), len(mark) + 7), np.uint8)
    there = np.ones(rows.shape, bool)
    rows[:, : len(mark)], rows[:, len(mark) + 3] = np.frombuffer(mark, np.uint8), GAP
    for end, at in ((joints >> END_BITS, len(mark)), (joints & ((1 << END_BITS) - 1), len(mark) + 4)):
        for k in range(3):
            rows[:, at + k] = (end >> (8 * k)) & 255
            there[:, at + k] = end >> 24 > k
    offsets = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(joints), [None, pa.py_buffer(offsets), pa.py_buffer(rows[there])])


def marked(words: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(WORD_UNIT), words, pa.scalar(b""))


def unmarked(units: pa.Array) -> pa.Array:
    return pc.binary_replace_slice(units, 0, 1, b"")


@dataclass
class Part:
    """Some texts of a batch, or a piece of one, as places of their distinct words and joints (by number), in order; a text's end is a word."""

    low: int
    high: int
    text: np.ndarray
    word_units: pa.Array
    word: np.ndarray
    joint_units: np.ndarray
    joint: np.ndarray

    @cached_property
    def words(self) -> list[bytes]:
        return self.word_units.to_pylist()

    @cached_property
    def joints(self) -> list[bytes]:
        return spelled(self.joint_units).to_pylist()

    @classmethod
    def of(cls, low: int, high: int, flat: pa.Array, offsets: np.ndarray, before: bytes, ended: bool, joined: bool) -> Part:
        """Of the words of all texts and the offsets of these; ``before`` is the word that precedes the first text's words."""
        found = flat.dictionary_encode()
        words = pa.concat_arrays([found.dictionary.cast(pa.binary()), pa.array([END_WORD], pa.binary())])
        count, end = np.diff(offsets), len(words) - 1
        text = np.repeat(np.arange(high - low, dtype=np.int32), count + ended)
        word = np.full(len(text), end, np.int32)
        word[np.arange(len(flat)) + ended * np.repeat(np.arange(high - low), count)] = found.indices.to_numpy()
        if not joined:
            return cls(low, high, text, words, word, np.zeros(0, np.int64), word[:0])
        tails, heads = ends_of(pa.concat_arrays([words, pa.array([before], pa.binary())]))
        last = np.empty_like(word)
        last[1:], last[np.flatnonzero(np.diff(text, prepend=-1))] = word[:-1], end + 1
        pairs = pa.array(tails[last] << END_BITS | heads[word]).dictionary_encode()
        return cls(low, high, text, words, word, pairs.dictionary.to_numpy(), pairs.indices.to_numpy())


def parts(texts: pa.Array, joined: bool = True, most: int = 1 << 22) -> Iterator[Part]:
    """All texts of a string array, about ``most`` bytes at a time; a longer text is several parts in a row."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for low, high in slices(np.concatenate([[0], np.cumsum(size)]), most):
        if size[low] > most:
            before = b""
            for words in tokens(texts[low].as_py().encode(), most):
                yield Part.of(low, high, pa.array(words, pa.binary()), np.array([0, len(words)]), before, False, joined)
                before = words[-1] if words else before
            continue
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(low, high - low), "")))
        flat, offsets = lists.flatten(), lists.offsets.to_numpy()
        some = pc.greater(pc.binary_length(flat), 0)
        kept = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
        yield Part.of(low, high, flat.filter(some), kept[offsets - offsets[0]], b"", True, joined)


def keys_of(units: list[bytes] | pa.Array, reach: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every symbol that the units score: the unit's number, the length of its context, and the key.

    A key is the context, latest byte first, and then the symbol, in two numbers
    of 8 bytes; numbers in order are contexts in order. Before a unit stands
    START, and before that nothing (zeros). Words score what their joint does
    not: symbols from HEAD on. Keys hold the last ``reach`` symbols of contexts.
    """
    units = pa.array(units, pa.binary()) if isinstance(units, list) else units.cast(pa.binary())
    is_word = pc.equal(pc.binary_slice(units, 0, 1), pa.scalar(WORD_UNIT))
    bodies = pc.binary_join_element_wise(unmarked(units), pc.if_else(is_word, pa.scalar(b" "), pa.scalar(b"")), pa.scalar(b""))
    raw, first, size = raw_of(bodies)
    scored_from = np.where(is_word.to_numpy(zero_copy_only=False), HEAD, pc.find_substring(bodies, b" ").to_numpy() + 1)
    raw = raw[first[0] : first[-1] + size[-1]] if len(size) else raw[:0]
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(len(units)), size)
    place = np.arange(len(raw)) - first[of]
    at = np.flatnonzero(place >= scored_from[of])
    of, place = of[at], place[at]
    high, low = np.zeros(len(at), np.uint64), raw[at].astype(np.uint64)
    for back in range(1, reach + 1):
        byte = np.zeros(len(at), np.uint64)
        byte[place == back - 1] = START
        there = np.flatnonzero(place >= back)
        byte[there] = raw[at[there] - back]
        if back <= 8:
            high |= byte << np.uint64(64 - 8 * back)
        else:
            low |= byte << np.uint64(128 - 8 * back)
    return of, place + 1, high, low


def short_keys(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The last MEET - 1 symbols of contexts, and the symbol."""
    return (high >> np.uint64(64 - 8 * (MEET - 1)) << np.uint64(8)) | (low & np.uint64(255))


def runs(values: np.ndarray) -> np.ndarray:
    """First places of equal neighbours."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted keys among sorted keys, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the sums of their numbers."""
    order = np.argsort(keys)
    keys = keys[order]
    first = runs(keys)
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit values of one length, the first as differences, compressed by byte planes."""
    first, *rest = (np.ascontiguousarray(c).view(np.uint64) for c in columns)
    table = np.stack([np.diff(first, prepend=np.uint64(0)), *rest])
    planes = np.ascontiguousarray(table.view(np.uint8).reshape(*table.shape, 8).transpose(0, 2, 1))
    return np.array(table.shape, np.int64).tobytes() + (pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True) if table.size else b"")


def expanded(data: bytes) -> list[np.ndarray]:
    count, n = np.frombuffer(data, np.int64, 2)
    if not n:
        return [np.zeros(0, np.uint64)] * count
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[16:], int(8 * count * n), asbytes=True), np.uint8)
    first, *rest = np.ascontiguousarray(planes.reshape(count, 8, n).transpose(0, 2, 1)).view(np.uint64).reshape(count, n)
    return [np.cumsum(first, dtype=np.uint64), *rest]


def diverging(entry_n: np.ndarray, group: np.ndarray, total: np.ndarray, share: np.ndarray, nats: float) -> np.ndarray:
    """Whether each group's counts (``entry_n``, of each symbol) diverge from the shares that the parent gives the symbols."""
    some = entry_n > 0
    n, of = entry_n[some].astype(float), group[some]
    gain = np.bincount(of, n * np.log(n / total[of] / share[some]), len(total))
    return (gain >= nats) & (total > 1)


@dataclass
class Tree:
    """States shorter than MEET, and all counts of strings of MEET symbols.

    A state is a context whose counts diverge from those of its parent, the
    context without its oldest symbol. Its distribution mixes its counts with
    that of its longest suffix that is a state, by the number of different
    symbols that followed it.
    """

    strings: np.ndarray
    n: np.ndarray
    contexts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    context_n: np.ndarray = field(default_factory=lambda: np.zeros(0))
    root: np.ndarray = field(default_factory=lambda: np.zeros(256))
    levels: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    @classmethod
    def grow(cls, strings: np.ndarray, n: np.ndarray, nats: float) -> Tree:
        out = cls(*summed(strings, n))
        out.contexts, out.context_n = summed(out.strings >> np.uint64(8), out.n.astype(float))
        symbol = out.strings & np.uint64(255)
        out.root = np.bincount(symbol.astype(np.int64), out.n, 256)
        upper, upper_n = np.arange(256, dtype=np.uint64), out.root
        above, above_n = np.zeros(1, np.uint64), np.array([out.root.sum()])
        for depth in range(1, MEET):
            own = out.strings >> np.uint64(8 * (MEET - depth)) << np.uint64(8) | symbol
            entry, entry_n = summed(own, out.n)
            states, total = summed(entry >> np.uint64(8), entry_n.astype(float))
            first = runs(entry >> np.uint64(8))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(entry))))
            parent = entry >> np.uint64(16)
            share = upper_n[np.searchsorted(upper, parent << np.uint64(8) | (entry & np.uint64(255)))] / above_n[np.searchsorted(above, parent)]
            kept = diverging(entry_n, group, total, share, nats)
            spread = np.bincount(group, minlength=len(total)).astype(float)
            edge = kept[group]
            out.levels.append((states[kept], total[kept] + spread[kept], spread[kept], entry[edge], entry_n[edge].astype(float)))
            upper, upper_n, above, above_n = entry, entry_n, states, total
        return out

    def probability(self, keys: np.ndarray) -> np.ndarray:
        """Of the last symbol of each string of MEET symbols, in its longest state of up to MEET - 1."""
        symbol = keys & np.uint64(255)
        p = (self.root[symbol.astype(np.int64)] + 0.5) / (self.root.sum() + 128)
        for depth, (states, whole, spread, edge, n) in enumerate(self.levels, 1):
            context = keys >> np.uint64(8 * (MEET - depth))
            i, known = lookup(states, context)
            at, i = np.flatnonzero(known), i[known]
            j, seen = lookup(edge, context[at] << np.uint64(8) | symbol[at])
            follows = np.where(seen, n[j] if len(n) else 0.0, 0.0)
            p[at] = (follows + spread[i] * p[at]) / whole[i]
        return p


def branch(tree: Tree, high: np.ndarray, low: np.ndarray, n: np.ndarray, nats: float) -> np.ndarray:
    """Of distinct strings in order, all of one part, the last symbol's probability in its longest state.

    Contexts in order are a suffix tree of what stands before the symbols: those
    that agree in their last d symbols are neighbours. A context that only one
    string has left can't diverge further, so strings leave as depth grows.
    """
    symbol = low & np.uint64(255)
    keys = short_keys(high, low)
    p = tree.probability(keys)
    i, known = lookup(tree.strings, keys)
    j, there = lookup(tree.contexts, keys >> np.uint64(8))
    share = np.where(known & there, (tree.n[i] if len(tree.n) else 0.0) / np.maximum(tree.context_n[j], 1) if len(tree.contexts) else 0.0, 0.0)
    at = np.arange(len(high))
    for depth in range(MEET, DEPTH + 1):
        if not len(at):
            break
        a, b = high[at], low[at] >> np.uint64(8)
        a = a >> np.uint64(64 - 8 * min(depth, 8))
        b = b >> np.uint64(8 * (DEPTH - depth)) if depth > 8 else np.zeros(len(at), np.uint64)
        new = np.ones(len(at), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group = np.cumsum(new) - 1
        pair = group << 8 | symbol[at].astype(np.int64)
        order = np.argsort(pair, kind="stable")
        first = runs(pair[order])
        entry = np.empty(len(at), np.int64)
        entry[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
        entry_n = np.add.reduceat(n[at][order], first)
        entry_group = group[order[first]]
        total = np.bincount(entry_group, entry_n)
        spread = np.bincount(entry_group, entry_n > 0)
        kept = diverging(entry_n, entry_group, total, share[at][order[first]], nats)
        use = kept[group]
        own, g = at[use], group[use]
        p[own] = (entry_n[entry[use]] + spread[g] * p[own]) / (total[g] + spread[g])
        share[at] = entry_n[entry] / np.maximum(total[group], 1)
        at = at[np.bincount(group)[group] > 1]
    return p


def gained(table: DataFrame, symbols: int, nats: float) -> DataFrame:
    """(unit, n, seen, gain): log10 probability of each unit (unit, n, seen, id) of ``symbols`` bytes in all, by the suffix tree of all."""
    spark = table.sparkSession
    # parts grow with the words, so what one part holds does not
    many = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), symbols >> 20)

    def chunks(batches: Iterator[pa.RecordBatch], most: int = 1 << 17) -> Iterator[pa.Table]:
        frugal()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                yield pa.Table.from_batches(held)
                held = []
        if held:
            yield pa.Table.from_batches(held)

    def shortest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            of, _, high, low = keys_of(chunk["unit"].combine_chunks(), MEET - 1)
            k, n = summed(short_keys(high, low), chunk["n"].to_numpy()[of])
            yield pa.RecordBatch.from_pydict({"k": k.view(np.int64), "n": n})

    counts = table.where("n > 0").select("unit", "n").mapInArrow(shortest, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    short = spark.sparkContext.broadcast(Tree.grow(counts["k"].to_numpy().view(np.uint64), counts["n"].to_numpy(), nats))

    def first_gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each unit, from its symbols whose contexts are shorter than MEET."""
        for chunk in chunks(batches):
            of, depth, high, low = keys_of(chunk["unit"].combine_chunks(), MEET - 1)
            near = depth < MEET
            gain = np.log10(short.value.probability(short_keys(high[near], low[near])))
            yield pa.RecordBatch.from_pydict({"id": chunk["id"].combine_chunks(), "gain": np.bincount(of[near], gain, len(chunk))})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Symbols with longer contexts, to the parts of these."""
        for chunk in chunks(batches):
            of, depth, high, low = keys_of(chunk["unit"].combine_chunks())
            n, ids = chunk["n"].to_numpy(), chunk["id"].to_numpy()
            far = depth >= MEET
            high, low, of = high[far], low[far], of[far]
            part = (((high >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(many)).astype(np.int32)
            order = np.lexsort((low, high, part))
            first = runs(part[order])
            for a, b in zip(first, np.append(first[1:], len(order))):
                at = order[a:b]
                data = squeezed(high[at], low[at], ids[of[at]].astype(np.int64), n[of[at]].astype(np.int64))
                yield pa.RecordBatch.from_pydict({"part": pa.array([part[at[0]]], pa.int32()), "data": pa.array([data], pa.binary())})

    def settle(group: pa.Table) -> pa.Table:
        frugal()
        high, low, ids, n = (np.concatenate(c) for c in zip(*(expanded(x) for x in group["data"].to_pylist())))
        order = np.lexsort((low, high))
        high, low, ids, n = high[order], low[order], ids[order], n[order].astype(np.int64)
        new = np.ones(len(high), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        first = np.flatnonzero(new)
        p = branch(short.value, high[first], low[first], np.add.reduceat(n, first), nats)
        ids, gain = summed(ids, np.log10(p)[np.cumsum(new) - 1])
        return pa.table({"id": ids.view(np.int64), "gain": gain})

    numbered = table.select("unit", "n", "id")
    near = numbered.mapInArrow(first_gains, "id long, gain double")
    deep = numbered.mapInArrow(dealt, "part int, data binary").groupBy("part").applyInArrow(settle, "id long, gain double")
    gains = near.unionByName(deep).groupBy("id").agg(F.sum("gain").alias("gain"))
    return stored(table.join(gains, "id").select("unit", "n", "seen", "gain"))


def score_texts(
    docs: DataFrame,
    learn: Column | None = None,
    key: str = "doc_id",
    text: str = "text",
    keep: Iterable[str] | None = None,
    divergence: float = 8.0,
    head_words: int = 1 << 18,
    tree: bool = True,
) -> DataFrame:
    """log10 probability of every whole text, by a suffix tree over bytes and by word frequencies.

    All texts where ``learn`` (a condition; default: all) holds are counted. A
    text is its words and one end; a word is its bytes and a gap. The first HEAD
    symbols of a word, and the end, have contexts that reach TAIL bytes into the
    word before; the contexts of the others run back to the start of their word
    (DEPTH bytes at most, the start included). So what a text adds up to are its
    words and the joints between them, and each distinct one of these is scored
    once, however often it occurs. All strings are counted, however rare; a
    context is a state where it occurs twice or more and its counts diverge from
    those of the context without its oldest byte by ``divergence`` nats or more.

    Words are told apart by their letters. The table of words and joints, the
    counts and the states grow with the corpus and stay distributed: strings are
    dealt to parts by the last MEET bytes of their contexts, where states are
    tested and used. Only counts of strings of MEET bytes, which the alphabet
    bounds, and the ``head_words`` words and as many joints that occur most go
    to every task; others meet their scores in a join. What is learned and what
    is scored is one table, so words that training lacks are scored the same way.

    Returns ``keep`` (all input columns by default), n_tokens, n_known,
    train_tokens, base_score, score, which replace input columns of these
    names; without ``tree`` no joint is counted and score is null. A null text
    counts as empty: its only token is the end. Nothing to learn from: no token is known and the tree is a flat root. Repeated rows
    count each time; an empty table gives an empty result.
    """
    with batches_of(docs.sparkSession, BATCH):
        return scored_texts(docs, learn, text, carried(docs, keep, OUT), divergence, head_words, tree)


def scored_texts(docs: DataFrame, learn: Column | None, text: str, own: list[str], divergence: float, head_words: int, tree: bool) -> DataFrame:
    """:func:`score_texts`, in batches of the session's size."""
    spark = docs.sparkSession
    learned = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    marks = (WORD_UNIT, JOINT_UNIT) if tree else (WORD_UNIT,)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words and joints with their occurrences in training texts and in all."""
        frugal()
        held: dict[bytes, list[pa.Table]] = {mark: [] for mark in marks}

        def load() -> int:
            """Rows held, or their bytes where words are long."""
            return max(sum(map(len, itertools.chain(*held.values()))), sum(t.nbytes for t in itertools.chain(*held.values())) >> 6)

        def told(most: int) -> Iterator[pa.RecordBatch]:
            """Sums of what is held, once that is more than ``most``; they leave if they are more than half as many."""
            if load() <= most:
                return
            for mark, tables in held.items():
                if len(tables) > 1:
                    sums = pa.concat_tables(tables).group_by("unit", use_threads=False).aggregate([("n", "sum"), ("seen", "sum")])
                    tables[:] = [sums.select(["unit", "n_sum", "seen_sum"]).rename_columns(["unit", "n", "seen"])]
            if load() > most // 2:
                for mark, tables in held.items():
                    for batch in itertools.chain(*(t.to_batches(1 << 16) for t in tables)):
                        unit = marked(batch["unit"]) if mark == WORD_UNIT else spelled(batch["unit"].to_numpy(), mark)
                        yield pa.RecordBatch.from_pydict({"unit": unit, "n": batch["n"], "seen": batch["seen"]})
                    tables.clear()

        for batch in batches:
            known = batch.column(1).to_numpy(zero_copy_only=False)
            for part in parts(batch.column(0), tree):
                trains = known[part.low + part.text]
                for mark, units, at in zip(marks, (part.word_units, part.joint_units), (part.word, part.joint)):
                    seen, n = np.bincount(at, minlength=len(units)), np.bincount(at[trains], minlength=len(units))
                    here = pa.table({"unit": units, "n": n, "seen": seen})
                    held[mark].append(here if seen.all() else here.filter(pa.array(seen > 0)))
                yield from told(1 << 21)
        yield from told(0)

    found = docs.select(quoted(text).cast("string").alias("t"), learned.alias("l")).mapInArrow(tally, "unit binary, n long, seen long")
    found = found.groupBy("unit").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    table = stored(found.withColumn("id", F.monotonically_increasing_id()))
    is_word = F.substring("unit", 1, 1) == F.lit(WORD_UNIT)
    sums = [F.sum(F.when(is_word, F.col("n"))), F.sum(F.when(is_word, F.signum("n"))), F.sum(F.length("unit"))]
    total, distinct, symbols = (int(x) for x in table.agg(*[F.coalesce(c, F.lit(0)) for c in sums]).first())
    merged = gained(table, symbols, divergence) if tree else table.withColumn("gain", F.lit(0.0))

    norm = float(np.log10(total + 0.1 * (distinct + 1)))
    heads, whole = [], True
    for mark in marks:
        own_kind = merged.where(F.substring("unit", 1, 1) == F.lit(mark))
        least = frequent(own_kind, head_words)
        whole = whole and least is None
        top = (own_kind if least is None else own_kind.where(F.col("seen") >= least)).select("unit", "n", "gain").toArrow()
        units, n = unmarked(top["unit"].combine_chunks().cast(pa.binary())), top["n"].to_numpy()
        heads.append((units if mark == WORD_UNIT else pa.array(numbers_of(units)), n, np.log10(n + 0.1) - norm, top["gain"].to_numpy()))
    head = spark.sparkContext.broadcast(heads)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch in batches:
            scored_at = batch.schema.get_field_index("scored")
            kept = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if i != scored_at]
            sums: list[tuple[int, np.ndarray]] = []
            rare: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
            for part in parts(batch.column(scored_at), tree):
                size = part.high - part.low
                own = np.zeros((4, size))
                own[0] = np.bincount(part.text, minlength=size)
                for mark, units, each, (heads, n_of, base_of, gain_of) in zip(marks, (part.word_units, pa.array(part.joint_units)), (part.word, part.joint), head.value):
                    place = pc.fill_null(pc.index_in(units, heads), -1).to_numpy()
                    at = place[each]
                    known = at >= 0
                    text, at = part.text[known], at[known]
                    own[3] += np.bincount(text, gain_of[at], size)
                    if mark == WORD_UNIT:
                        own[1] = np.bincount(text, n_of[at] > 0, size)
                        own[2] = np.bincount(text, base_of[at], size)
                    pair, times = np.unique(part.text[~known].astype(np.int64) * len(units) + each[~known], return_counts=True)
                    other, which = np.unique(pair % len(units), return_inverse=True) if len(pair) else (pair, pair)
                    others = units.take(pa.array(other))
                    others = marked(others) if mark == WORD_UNIT else spelled(others.to_numpy(), mark)
                    rare.append((part.low + pair // max(1, len(units)), others.take(pa.array(which)), times))
                if sums and sums[-1][0] == part.low:  # one more piece of a long text
                    sums[-1][1][...] += own
                else:
                    sums.append((part.low, own))
            n_tokens, n_known, base, score = np.concatenate([own for _, own in sums], axis=1) if sums else np.zeros((4, 0))
            text = np.concatenate([t for t, _, _ in rare]) if rare else np.zeros(0, np.int64)
            order = np.argsort(text, kind="stable")
            unit = pa.concat_arrays([u for _, u, _ in rare]).take(pa.array(order)) if rare else pa.array([], pa.binary())
            times = np.concatenate([k for _, _, k in rare])[order] if rare else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=batch.num_rows))]).astype(np.int32)
            rows = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([unit, pa.array(times, pa.int64())], names=["unit", "times"]))
            new = [("n_tokens", pa.array(n_tokens.astype(np.int64))), ("n_known", pa.array(n_known.astype(np.int64))), ("base", pa.array(base)), ("score", pa.array(score)), ("rare", rows)]
            yield pa.RecordBatch.from_pydict(dict(kept + new))

    base = docs.select(*[quoted(c).alias(f"in_{c}") for c in own], quoted(text).cast("string").alias("scored"), F.monotonically_increasing_id().alias("row_"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "scored")
    scored = base.mapInArrow(measure, f"{kept}, n_tokens long, n_known long, base double, score double, rare array<struct<unit: binary, times: long>>")
    names = [quoted(f"in_{c}").alias(c) for c in own]
    train = F.lit(total).cast("long").alias("train_tokens")
    told = lambda score: (score if tree else F.lit(None).cast("double")).alias("score")
    if whole:
        return scored.select(*names, "n_tokens", "n_known", train, F.col("base").alias("base_score"), told(F.col("score")))
    scored = stored(scored)
    asked = scored.select("row_", F.explode("rare").alias("x")).select("row_", "x.unit", "x.times")
    met = asked.join(merged.select("unit", "n", "gain"), "unit")
    each = F.when(is_word, F.log10(F.col("n") + 0.1) - norm).otherwise(0.0)
    more = met.groupBy("row_").agg(
        F.sum(F.when(is_word & (F.col("n") > 0), F.col("times")).otherwise(0)).alias("met"), F.sum(F.col("times") * each).alias("more"), F.sum(F.col("times") * F.col("gain")).alias("gained")
    )
    return scored.join(more, "row_", "left").select(
        *names,
        "n_tokens",
        (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        train,
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        told(F.col("score") + F.coalesce("gained", F.lit(0.0))),
    )


def frequent(units: DataFrame, most: int) -> int | None:
    """A number of occurrences that at most ``most`` units reach, from a histogram with eight classes to each doubling; None: all may be taken."""
    edge = F.floor(F.log2("seen") * 8)
    at, reach = 1 << 62, 0
    for r in sorted(units.groupBy(edge.alias("e")).agg(F.count("*").alias("c"), F.min("seen").alias("n")).collect(), key=lambda r: -r["e"]):
        reach += r["c"]
        if reach > most:
            return at
        at = r["n"]
    return None


def query(spark: SparkSession, sf_dir: str, tree: bool = True) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", in_fold(F.col("doc_id"), 10, 0))
    return score_texts(docs, ~F.col("held_out"), keep=["doc_id", "held_out"], tree=tree)


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unigram baseline alone, without the tree, for the comparison with SQL."""
    found = query(spark, sf_dir, tree=False).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    return found.withColumn("base_score", F.round("base_score", 6))


BASE_SQL = r"""
WITH RECURSIVE steps(n, j, c) AS (
  SELECT CAST(n AS UBIGINT), 0, CAST(n AS UBIGINT) FROM range(256) s(n)
  UNION ALL SELECT n, j + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END FROM steps WHERE j < 8),
remainders AS (SELECT n, c AS v FROM steps WHERE j = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, CAST(doc_id AS VARCHAR) AS name, coalesce(text, '') AS t FROM documents),
crc(r, name, i, c) AS (
  SELECT r, name, 1, CAST(4294967295 AS UBIGINT) FROM d
  UNION ALL SELECT r, name, i + 1, xor(c >> 8, v) FROM crc JOIN remainders ON n = xor(c, CAST(ascii(substr(name, i, 1)) AS UBIGINT)) & 255 WHERE i <= length(name)),
fold AS (SELECT r, xor(c, CAST(4294967295 AS UBIGINT)) % 10 = 0 AS held_out FROM crc WHERE i = length(name) + 1),
w AS (SELECT r, unnest(list_append(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '')) AS token FROM d),
c AS (SELECT token, count(*) AS c FROM w JOIN fold USING (r) WHERE NOT held_out GROUP BY 1),
a AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(c.c) AS BIGINT) AS n_known, CAST(max(a.n) AS BIGINT) AS train_tokens,
  round(sum(log10((coalesce(c.c, 0) + 0.1) / (a.n + 0.1 * (a.v + 1)))), 6) AS base_score
FROM d JOIN fold USING (r) JOIN w USING (r) LEFT JOIN c USING (token), a GROUP BY r, doc_id, held_out
"""
