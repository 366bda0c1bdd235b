"""Secret scans: fixed rules, and Markov models of random strings and of identifiers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, quoted, read, sampled

# The rules of the contract, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

#: What the models judge: unbroken strings of at least so many characters.
LEAST = 16
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
IDENTIFIER = re.compile(r"[A-Za-z0-9_-]{6,}")
#: Identifiers from this length on calibrate the threshold, which is never below so many nats.
LONG_NAME, LEAST_NATS = 12, 10.0
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
CODE = np.full(128, len(SYMBOLS), np.int64)
CODE[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))
STATES = len(SYMBOLS) + 1

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Spans (start, end, kind) by the fixed rules; matches that fail a length are dropped, without a retry."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def transitions(strings: Iterable[str]) -> np.ndarray:
    """Counts of character pairs; the last state stands for the edges and all other characters."""
    counts = np.zeros(STATES * STATES, np.int64)
    joined = "\n".join(["", *strings, ""])
    if len(joined) > 2:
        code = CODE[np.minimum(np.frombuffer(joined.encode("utf-32-le"), "<u4"), 127)]
        counts += np.bincount(code[:-1] * STATES + code[1:], minlength=STATES * STATES)
    return counts


@dataclass
class Model:
    """Log-likelihood ratio of random strings to ordinary identifiers, for each pair of characters."""

    ratio: np.ndarray
    threshold: float

    @classmethod
    def fit(cls, random: np.ndarray, ordinary: np.ndarray, threshold: float, own: float = 5.0, floor: float = 0.01, most: float = 4.0) -> Model:
        """From counts of pairs.

        A character's distribution after another is drawn, with the weight of
        ``own`` observations, to its overall one, which is mixed with ``floor``
        parts of an even one: so what neither sample holds speaks for neither.
        No single pair decides: its ratio stays within ``most`` nats.
        """

        def logs(counts: np.ndarray) -> np.ndarray:
            table = counts.reshape(STATES, STATES).astype(float)
            overall = (1 - floor) * table.sum(axis=0) / max(1.0, table.sum()) + floor / STATES
            return np.log((table + own * overall) / (table.sum(axis=1, keepdims=True) + own))

        return cls(np.clip(logs(random) - logs(ordinary), -most, most), threshold)

    def score(self, token: str) -> float:
        """Summed ratio over the pairs of a token of ASCII characters."""
        code = CODE[np.frombuffer(token.encode(), np.uint8)]
        return float(self.ratio[code[:-1], code[1:]].sum())

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Strings that look random, of what the rules' spans leave."""
        return [(a, b, "random") for a, b in left_over(text, base) if self.score(text[a:b]) > self.threshold]


def left_over(text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """Long strings, or the parts of them that lie outside the rules' spans and are still long."""
    covered = sorted((a, b) for a, b, _ in base)
    i = 0
    for m in TOKEN.finditer(text):
        at, end = m.span()
        while i < len(covered) and covered[i][1] <= at:
            i += 1
        for a, b in covered[i:]:
            if a >= end:
                break
            if a - at >= LEAST:
                yield at, a
            at = max(at, b)
        if end - at >= LEAST:
            yield at, end


def mixed(token: str) -> bool:
    """Letters and digits, or both cases after the first character."""
    rest = token[1:]
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token) or rest != rest.lower() and rest != rest.upper()


def labelled(text: str) -> tuple[list[str], list[str]]:
    """Random strings and ordinary identifiers: what the rules find, and all else but long strings of letters and digits or of both cases, which have no label."""
    spans = base_spans(text)
    random = [re.split(r"[\"' :=]", text[a:b])[-1] for a, b, _ in spans]
    gone = list(text)
    for a, b in [*((a, b) for a, b, _ in spans), *(m.span() for m in TOKEN.finditer(text) if mixed(m[0]))]:
        gone[a:b] = " " * (b - a)
    return random, IDENTIFIER.findall("".join(gone))


def train(docs: DataFrame, key: str, text: str, rows: int, alarms: float) -> Model:
    """Fit both models on four fifths of about ``rows`` documents, chosen by a hash of their id; the last fifth sets the threshold.

    Labels come from the rules (``labelled``). So that the random model knows
    letters of either case before it has seen a key, it starts from one even
    count of all pairs of letters and digits. At the threshold a share of
    ``alarms`` of the ordinary identifiers of 12 characters or more would pass.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random, ordinary = np.zeros((2, STATES * STATES), np.int64)
        for batch in batches:
            for value in batch.column(0):
                keys, names = labelled(value.as_py() or "")
                random += transitions(keys)
                ordinary += transitions(names)
        yield pa.RecordBatch.from_pydict({"pair": np.arange(STATES * STATES), "random": random, "ordinary": ordinary})

    sample = sampled(docs.select(quoted(key).alias("id"), quoted(text).alias("t")), F.col("id"), F.lit("all"), rows, F.col("t"))
    fold = F.pmod(F.xxhash64(F.lit("calibration"), F.col("id").cast("string")), F.lit(5))
    counts = sample.where(fold != 0).select("t").mapInArrow(count, "pair long, random long, ordinary long").groupBy("pair").agg(F.sum("random"), F.sum("ordinary")).collect()
    random, ordinary = np.zeros((2, STATES * STATES), np.int64)
    for pair, a, b in counts:
        random[pair], ordinary[pair] = a, b
    even = np.zeros((STATES, STATES), np.int64)
    even[:62, :62] = 1
    model = Model.fit(random + even.ravel(), ordinary, LEAST_NATS)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                names = [n for n in labelled(value.as_py() or "")[1] if len(n) >= LONG_NAME]
                yield pa.RecordBatch.from_pydict({"nats": pa.array([shared.value.score(n) for n in names], pa.float64())})

    reached = sample.where(fold == 0).select("t").mapInArrow(judge, "nats double").agg(F.percentile_approx("nats", 1 - alarms, 100_000)).first()[0]
    model.threshold = max(LEAST_NATS, reached or 0.0)
    return model


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: Iterable[str] | None = None,
    train_rows: int = 5000,
    alarms: float = 1e-3,
) -> DataFrame:
    """Secrets in every whole text: spans of the fixed rules, and strings that look random.

    An unbroken string of 16 characters or more, or what rule spans leave of it,
    is added as kind ``random`` if its summed log-likelihood ratio is above a
    threshold, which is set so that a share of ``alarms`` of held-back ordinary
    identifiers would pass it. Both Markov models are fitted on a sample of about
    ``train_rows`` documents; every text is scanned.

    Returns ``keep`` (all input columns by default), n_assign, n_access, n_hex,
    n_random, base_sha256, spans and found (an array of start, end, kind;
    offsets in code points, end exclusive); they replace input columns of these
    names. A null text counts as empty: no spans. Repeated rows have the same
    result; an empty table gives an empty result.
    """
    names = [f"n_{k}" for k in KINDS]
    own = carried(docs, keep, (*names, "base_sha256", "spans", "found"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, key, text, train_rows, alarms))
    result = ", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string, found array<struct<start: int, end: int, kind: string>>"
    kinds = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32(), "kind": pa.string()}))]

    @F.arrow_udf(result)
    def scan(texts: pa.Array) -> pa.Array:
        columns: list[list] = [[] for _ in kinds]
        for value in texts:  # one text at a time becomes a string
            whole = value.as_py() or ""
            base = base_spans(whole)
            every = sorted(base + model.value.spans(whole, base), key=lambda s: (s[0], KINDS.index(s[2])))
            counts = [sum(s[2] == k for s in every) for k in KINDS]
            found = [{"start": s, "end": e, "kind": k} for s, e, k in every]
            for column, x in zip(columns, (*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), found)):
                column.append(x)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*names, "base_sha256", "spans", "found"])

    return docs.select(*[quoted(c) for c in own], scan(quoted(text)).alias("found_")).select(*[quoted(c) for c in own], "found_.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"), keep=["doc_id"]).drop("found")


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone find, for the comparison with SQL."""
    return query(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


BASE_SQL = r"""
WITH p AS (SELECT '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])'
  || '["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS pattern),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT r, 0 AS k, 'assign' AS kind, 6 AS least, string_split_regex(t, pattern) AS gaps, regexp_extract_all(t, pattern, 0) AS ms, regexp_extract_all(t, pattern, 2) AS gs FROM d, p
  UNION ALL SELECT r, 1, 'access', 20, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT r, 2, 'hex', 24, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') FROM d),
e AS (SELECT r, k, kind, least, i, gaps[i] AS gap, ms[i] AS m, gs[i] AS g FROM (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM f)),
s AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY r, k ORDER BY i) AS z FROM e),
x AS (SELECT r, k, kind, CAST(z - length(m) AS BIGINT) AS a, CAST(z AS BIGINT) AS z FROM s WHERE length(g) >= least),
n AS (SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) AS listed FROM x GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(listed, '')) AS base_sha256
FROM d LEFT JOIN n USING (r)
"""
