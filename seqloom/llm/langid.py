"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, carried, in_fold, quoted, read, sampled, slices, utf8

ORDER, SYMBOL_BITS, DOC_BITS = 4, 12, 16
SPACE = 32
GRAM = np.uint64((1 << (ORDER * SYMBOL_BITS)) - 1)


@lru_cache(1)
def folding() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its symbol (lower case, hashed to 12 bits; no letter: space), and whether it is a letter."""
    symbol, letter = np.full(0x110000, SPACE, np.uint64), np.zeros(0x110000, bool)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            letter[code] = True
            symbol[code] = ord(char.lower()[0]) & ((1 << SYMBOL_BITS) - 1)
    return symbol, letter


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number (low bits) and 4-gram (high bits) of every character, letters and characters in each text.

    Before a text stand spaces; runs of characters that are no letters count as they are.
    """
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    n = np.diff(heads)
    doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    symbols, letters = folding()
    symbol, letter = symbols[code], np.concatenate([[0], np.cumsum(letters[code])])
    at = np.arange(len(code)) - np.repeat(heads[:-1], n)
    gram = symbol.copy()
    for back in range(1, ORDER):
        before = np.full(len(code), SPACE, np.uint64)
        before[back:] = np.where(at[back:] >= back, symbol[:-back], SPACE)
        gram |= before << np.uint64(back * SYMBOL_BITS)
    return (gram << np.uint64(DOC_BITS)) | doc, np.diff(letter[heads]), n


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


@dataclass
class Model:
    """Sorted arrays of hashed n-grams for each order, with a column for each language.

    ``seen[k]``: discounted share of a k-gram given its first k-1 symbols;
    ``back[k]``: weight of the next lower order, by those k-1 symbols.
    """

    langs: list[str]
    seen: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    back: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    limit: np.ndarray | None = None
    spread: np.ndarray | None = None

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        """counts: sorted 4-grams and their counts, by language."""
        out = cls(sorted(counts))
        if not counts:
            return out
        parts: list[list] = [[] for _ in range(ORDER)]
        for lang in out.langs:
            grams, n = counts[lang]
            n = n.astype(float)
            for order in range(ORDER, 0, -1):
                ones, twos = (n == 1).sum(), (n == 2).sum()
                discount = ones / (ones + 2 * twos) if ones else 0.5
                head, group = np.unique(grams >> np.uint64(SYMBOL_BITS), return_inverse=True)
                total, types = np.bincount(group, n), np.bincount(group)
                parts[order - 1].append((grams, np.maximum(n - discount, 0) / total[group], head, discount * types / total))
                tails = grams & np.uint64((1 << ((order - 1) * SYMBOL_BITS)) - 1)
                grams, n = np.unique(tails, return_counts=True)  # lower orders count the types that they end
                n = n.astype(float)
        for each in parts:
            for columns, into, blank in (((0, 1), out.seen, 0.0), ((2, 3), out.back, 1.0)):
                keys = np.unique(np.concatenate([p[columns[0]] for p in each]))
                table = np.full((len(keys), len(out.langs)), blank)
                for j, p in enumerate(each):
                    table[np.searchsorted(keys, p[columns[0]]), j] = p[columns[1]]
                into.append((keys, table))
        return out

    def probability(self, grams: np.ndarray) -> np.ndarray:
        """Of the last symbol of each 4-gram given those before it, for each language."""
        p = np.full((len(grams), len(self.langs)), 1.0 / (1 << SYMBOL_BITS))
        for order in range(1, ORDER + 1):
            tail = grams & np.uint64((1 << (order * SYMBOL_BITS)) - 1)
            for (keys, table), key, add in ((self.back[order - 1], tail >> np.uint64(SYMBOL_BITS), False), (self.seen[order - 1], tail, True)):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                if add:
                    p[hit] += table[at[hit]]
                else:
                    p[hit] *= table[at[hit]]
        return p

    def entropy(self, texts: pa.Array, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character of each text in each language, and its number of letters."""
        data, offsets = utf8(texts)
        out, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for low, high in slices(offsets, most):
            keys, letters[low:high], n = grams(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            keys, count = counted(keys)
            gram = keys >> np.uint64(DOC_BITS)
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
            cost = -np.log(self.probability(gram[first])) if len(first) else np.zeros((0, len(self.langs)))
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(gram))))
            doc = (keys & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64)
            for j in range(len(self.langs)):
                out[low:high, j] = np.bincount(doc, count * cost[of, j], high - low) / np.maximum(n, 1)
        return out, letters


def train(rows: DataFrame, bound: int) -> Model:
    """Fit on four fifths of about ``bound`` rows (id, text, lang) of each language; calibrate on the last fifth.

    Counts are summed by Spark; their number is bounded by that of the sampled
    characters. The limit of a language is its mean cross-entropy over its own
    held-back texts plus four standard deviations; a language without such texts
    has no limit.
    """
    every = checkpointed(sampled(rows.where("lang is not null"), F.col("id"), F.col("lang"), bound, F.col("text")))
    fold = F.pmod(F.xxhash64(F.lit("calibration"), F.col("id").cast("string")), F.lit(5))
    sample, held = every.where(fold != 0), every.where(fold == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for lang in table["lang"].unique().to_pylist():
                data, offsets = utf8(table.filter(pa.compute.equal(table["lang"], lang))["text"])
                for low, high in slices(offsets, 1 << 20):
                    keys, _, _ = grams(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                    found, n = counted(keys >> np.uint64(DOC_BITS))
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(found), "gram": found.astype(np.int64), "n": n.astype(np.int64)})

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counts.toPandas().sort_values(["lang", "gram"])
    model = Model.fit({lang: (part["gram"].to_numpy(np.uint64), part["n"].to_numpy()) for lang, part in table.groupby("lang")})
    model.limit, model.spread = np.full(len(model.langs), np.inf), np.ones(len(model.langs))
    if not model.langs:
        return model
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost, letters = shared.value.entropy(batch.column(1))
            lang = np.array([shared.value.langs.index(x) if x in shared.value.langs else -1 for x in batch.column(0).to_pylist()])
            use = np.flatnonzero((letters > 0) & (lang >= 0))
            own = cost[use, lang[use]]
            yield pa.RecordBatch.from_pydict({"j": pa.array(lang[use], pa.int64()), "a": own, "b": own**2})

    sums = held.select("lang", "text").mapInArrow(calibrate, "j long, a double, b double").groupBy("j")
    for j, n, a, b in sums.agg(F.count("*"), F.sum("a"), F.sum("b")).collect():
        model.spread[j] = max(1e-3, (max(0.0, b / n - (a / n) ** 2)) ** 0.5)
        model.limit[j] = a / n + 4 * model.spread[j]
    return model


def identify(
    docs: DataFrame,
    learn: Column | None = None,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    keep: Iterable[str] | None = None,
    train_rows: int = 1500,
    temperature: float = 0.05,
) -> DataFrame:
    """The language of every whole text, by the least length-normalised cross-entropy.

    Learns from rows where ``learn`` (a condition; default: all) holds and the
    language is not null: about ``train_rows`` of each language. A prediction
    uses the text alone.

    Returns ``keep`` (all input columns by default), lang_pred, score, rejected,
    which replace input columns of these names. score is the share of the
    chosen language among exp(-entropy / temperature), lowered as the entropy
    nears the language's limit; rejected texts are beyond it. A text that is
    null or has no letter is ``und`` with score 0, rejected; so is every text
    if no language was learned. Ties go to the first language by name. Repeated
    rows have the same result; an empty table gives an empty result.
    """
    own = carried(docs, keep, ("lang_pred", "score", "rejected"))
    rows = docs if learn is None else docs.where(learn)
    named = rows.select(quoted(key).alias("id"), quoted(text).alias("text"), quoted(lang).cast("string").alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(train(named, train_rows))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model, n = shared.value, len(texts)
        if not model.langs or not n:
            return pd.DataFrame({"lang_pred": ["und"] * n, "score": np.zeros(n), "rejected": [True] * n})
        cost, letters = model.entropy(pa.array(texts, pa.large_string(), from_pandas=True))
        best = cost.argmin(axis=1)
        least = cost[np.arange(n), best]
        share = 1 / np.exp((least[:, None] - cost) / temperature).sum(axis=1)
        beyond = np.clip((least - model.limit[best]) / model.spread[best], -50, 50)
        named = letters > 0
        pred = np.where(named, np.array(model.langs, object)[best], "und")
        score = np.where(named, share / (1 + np.exp(beyond)), 0.0)
        return pd.DataFrame({"lang_pred": pred, "score": score, "rejected": ~named | (beyond > 0)})

    return docs.select(*[quoted(c) for c in own], predict(quoted(text)).alias("found_")).select(*[quoted(c) for c in own], "found_.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = in_fold(F.col("doc_id"), 4, 2)
    docs = read(spark, sf_dir, "documents").withColumn("held_out", held)
    return identify(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])
