"""Toxicity: a weighted finite-state grammar over clauses, calibrated on labels."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, checkpointed, in_fold, quoted, read, sampled

# Starting words of the grammar's classes, in English, German, French and Spanish.
INSULTS = "idiot moron stupid pathetic worthless disgusting scum trash loser clown dumm abschaum widerlich imbécile minable estúpido basura".split()
THREATS = "kill murder hurt destroy strangle töten umbringen verletzen tuer détruire matar destruir".split()
TARGETS = "you your yours he she they them him du dich euch ihr sie tu te vous toi ils tú usted ellos".split()
NEGATIONS = "not never no isn't aren't don't without nicht kein keine nie ne pas jamais sans nunca ni sin".split()
REPORTS = "said says wrote writes called reported quoted claims sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:,\n]")
STEMS = range(4, 9)

#: Transducers: the next state by class of word ("" is any other word), and what a state says.
#: The first two say that the word just read matches, the others what holds for it; a target holds for its whole clause.
INSULT = ({0: {"insult": 1, "": 0}, 1: {"insult": 1, "": 0}}, {1})
THREAT = ({0: {"threat": 1, "": 0}, 1: {"threat": 1, "": 0}}, {1})
NEGATED = ({0: {"negation": 3, "": 0}, 1: {"negation": 3, "": 0}, 2: {"negation": 3, "": 1}, 3: {"negation": 3, "": 2}}, {1, 2, 3})
REPORTED = ({0: {"report": 1, "": 0}, 1: {"": 1}}, {1})
AIMED = ({0: {"target": 1, "": 0}, 1: {"": 1}}, {1})
KINDS = ("insult", "threat", "target", "negation", "report", "")
#: Events are numbered insult 0 or threat 4, plus negated 2, plus reported 1; in an aimed clause 8 more.
EVENTS = 16


def composed() -> tuple[list[dict[str, int]], list[int | None], list[bool]]:
    """The product of the five transducers: moves, the event that a state emits on entry, and whether its clause is aimed."""
    machines = (INSULT, THREAT, NEGATED, REPORTED, AIMED)
    states, numbers, moves = [(0,) * len(machines)], {(0,) * len(machines): 0}, []
    for state in states:  # grows as states are reached
        out = {}
        for kind in KINDS:
            to = tuple(steps[s].get(kind, steps[s][""]) for (steps, _), s in zip(machines, state))
            if to not in numbers:
                numbers[to] = len(states)
                states.append(to)
            out[kind] = numbers[to]
        moves.append(out)
    says = [[s in said for (_, said), s in zip(machines, state)] for state in states]
    events = [4 * threat + 2 * negated + reported if insult or threat else None for insult, threat, negated, reported, _ in says]
    return moves, events, [aimed for *_, aimed in says]


def first_arcs() -> np.ndarray:
    """Weights of the events before anything is learned: a threat counts only in an aimed clause, negation and report halve."""
    out = np.zeros(EVENTS)
    for event in range(EVENTS):
        threat, aimed = event >> 2 & 1, event >> 3
        damp = 0.5 ** (event >> 1 & 1) * 0.5 ** (event & 1)
        out[event] = damp * ((3.0 if aimed else 0.0) if threat else (1.5 if aimed else 1.0))
    return out


def entries(word: str) -> list[str]:
    """A word, and its stems (with ``*``) of 4 to 8 letters."""
    return [word, *(word[:k] + "*" for k in STEMS if k < len(word))]


@dataclass
class Grammar:
    """Classes of words with the weights of insults, the weights of the composed automaton's events, and how clauses become a score."""

    insults: dict[str, float]
    arcs: np.ndarray = field(default_factory=first_arcs)
    mean: np.ndarray | None = None
    coefficients: np.ndarray | None = None

    def __post_init__(self):
        self.classes = {w: c for c, ws in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("threat", THREATS)) for w in ws}
        self.moves, self.events, self.aimed = composed()

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for entry in sorted({*self.insults, *THREATS}):  # a stem comes after the same letters as a word, and includes it
            out.add_word(entry.rstrip("*"), (len(entry.rstrip("*")), entry.endswith("*")))
        out.make_automaton()
        return out

    def weight(self, word: str) -> float:
        """Of the longest entry that the word matches."""
        if word in self.insults:
            return self.insults[word]
        return next((self.insults[e] for e in reversed(entries(word)) if e in self.insults), 0.0)

    def emitted(self, words: Iterable[str]) -> dict[int, float]:
        """The composed automaton over one clause: the sums of its events' weights of words, by event."""
        state, found = 0, {}
        for word in words:
            kind = self.classes.get(word, "")
            weight = 1.0 if kind == "threat" else 0.0 if kind else self.weight(word)
            state = self.moves[state]["insult" if weight and not kind else kind]
            event = self.events[state]
            if event is not None:
                found[event] = found.get(event, 0.0) + weight
        return {event + 8 * self.aimed[state]: x for event, x in found.items()}

    def clause(self, words: Iterable[str]) -> float:
        return sum(x * self.arcs[event] for event, x in self.emitted(words).items())

    def clauses(self, text: str, automaton: ahocorasick.Automaton) -> Iterator[dict[int, float]]:
        """Events of each clause with a match, whatever its length; ``text`` is in lower case."""
        done, marks, next_mark = -1, None, 0
        for end, (length, stem) in automaton.iter(text) if len(automaton) else ():
            start = end + 1 - length
            if start < done or start and text[start - 1].isalpha() or not stem and end + 1 < len(text) and text[end + 1].isalpha():
                continue
            if marks is None:
                marks = [m.start() for m in CLAUSE.finditer(text)]
            next_mark = bisect.bisect_left(marks, end + 1, next_mark)
            low = bisect.bisect_left(marks, start)
            low = marks[low - 1] + 1 if low else 0
            done = marks[next_mark] if next_mark < len(marks) else len(text)
            yield self.emitted(m[0] for m in WORD.finditer(text, low, done))

    def event_sums(self, text: str, automaton: ahocorasick.Automaton) -> np.ndarray:
        out = np.zeros(EVENTS)
        for found in self.clauses(text.lower(), automaton):
            for event, x in found.items():
                out[event] += x
        return out

    def features(self, text: str, automaton: ahocorasick.Automaton) -> tuple[float, float, float, float]:
        """Sum and maximum of the matched clauses' scores, their number, and the sum by length."""
        text = text.lower()
        scores = [sum(x * self.arcs[event] for event, x in found.items()) for found in self.clauses(text, automaton)]
        scores = [x for x in scores if x > 0]
        total = sum(scores)
        return np.log1p(total), np.log1p(max(scores, default=0.0)), np.log1p(len(scores)), np.log1p(1000 * total / (len(text) + 200))

    def score(self, features: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.ones(len(features)), features - self.mean])
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Means of the features and ridge logistic coefficients, by Newton steps."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    z = np.column_stack([np.ones(len(x)), x - mean])
    w = np.zeros(z.shape[1])
    penalty = ridge * np.diag([0.01] + [1.0] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -2, 2)
    return mean, w


def learned_arcs(sums: np.ndarray, y: np.ndarray, first: np.ndarray, ridge: float = 20.0) -> np.ndarray:
    """Weights of the events from texts' event sums and labels.

    A slope for the first weights as a whole is fitted, then each event's
    deviation from it, with a ridge that holds what labels do not tell; no
    weight is below 0 or over 6.
    """
    x = np.log1p(sums)
    mean, (_, slope) = logistic((x @ first)[:, None], y)
    if slope <= 0:
        return first
    base = slope * (x @ first - mean[0])
    z = np.column_stack([np.ones(len(x)), x - x.mean(axis=0)])
    w = np.zeros(z.shape[1])
    penalty = ridge * np.diag([0.001] + [1.0] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(base + z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -2, 2)
    return np.clip(first + w[1:] / slope, 0.0, 6.0)


def contexts(batches: Iterator[pa.RecordBatch], among: frozenset | None) -> Iterator[pa.RecordBatch]:
    """Entries of the words of texts with a hash of the neighbouring words; copies of a text add nothing."""
    for batch in batches:
        found = set()
        for value in batch.column(0):
            words = ["", *WORD.findall((value.as_py() or "").lower()), ""]
            for before, word, after in zip(words, words[1:], words[2:]):
                own = entries(word) if among is None else [e for e in entries(word) if e in among]
                if own:
                    place = hash_of(before + " " + after)
                    found.update((e, place) for e in own)
        yield pa.RecordBatch.from_pydict({"entry": pa.array([e for e, _ in found], pa.string()), "place": pa.array([p for _, p in found], pa.int64())})


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) >> 1


def train(rows: DataFrame, known: DataFrame, toxic_rows: int, clean_rows: int, least: int = 4, ratio: float = 4.0) -> Grammar:
    """Learn insults and the calibration from rows (id, text) and labels (id, label).

    About ``toxic_rows`` and ``clean_rows`` labelled ids are chosen by a hash;
    that bounds what is broadcast to pick out their texts, and the sample that
    is kept for the passes over it. An entry is an insult if it stands between at least
    ``least`` (and 0.5% of the toxic rows) different pairs of neighbours in
    toxic texts and ``ratio`` times as often there, by texts, as in clean ones.
    """
    labelled = known.join(rows.select("id").distinct(), "id", "left_semi")
    chosen = sampled(labelled.where("label = 1"), F.col("id"), F.lit("toxic"), toxic_rows).unionByName(
        sampled(labelled.where("label = 0"), F.col("id"), F.lit("clean"), clean_rows)
    )
    # an id that repeats brings all its rows: once more by text
    drawn = sampled(rows.join(F.broadcast(chosen), "id").select("id", "text", "label"), F.col("id"), F.col("label"), 2 * max(toxic_rows, clean_rows), F.col("text"))
    sample = checkpointed(drawn.select("text", "label"))
    toxic, clean = sample.where("label = 1"), sample.where("label = 0")
    n_toxic, n_clean = toxic.count(), clean.count()

    def count(texts: DataFrame, among: frozenset | None) -> DataFrame:
        found = texts.select("text").mapInArrow(lambda batches: contexts(batches, among), "entry string, place long")
        return found.groupBy("entry").agg(F.countDistinct("place").alias("n"))

    need = max(least, n_toxic * 0.005)
    inside = dict(map(tuple, count(toxic, None).where(F.col("n") >= need).collect()))
    outside = dict(map(tuple, count(clean, frozenset(inside)).collect())) if inside else {}
    insults = {w: 1.5 for w in INSULTS}
    for entry, n in inside.items():
        gain = (n / (n_toxic + 1)) / ((outside.get(entry, 0) + 0.5) / (n_clean + 1))
        if gain >= ratio:
            insults[entry] = float(np.log(gain))
    most: dict[str, int] = {}  # of one word, by its stems: what one word makes up is no stem
    for entry, n in inside.items():
        for stem in [] if entry.endswith("*") else entries(entry)[1:]:
            most[stem] = max(n, most.get(stem, 0))
    insults = {e: w for e, w in insults.items() if not e.endswith("*") or inside[e] >= 1.5 * most.get(e, 0)}
    grammar = Grammar(insults)

    def measured(of: str, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of every text of the sample by a method of the grammar, and the labels."""
        shared = rows.sparkSession.sparkContext.broadcast(grammar)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = shared.value.automaton()
            for batch in batches:
                values = [getattr(shared.value, of)(t.as_py() or "", machine) for t in batch.column(0)]
                out = np.array(values, float).reshape(len(values), width)
                yield pa.RecordBatch.from_pydict({**{f"f{i}": out[:, i] for i in range(width)}, "label": batch.column(1).cast(pa.float64())})

        table = sample.mapInArrow(run, ", ".join([*(f"f{i} double" for i in range(width)), "label double"])).toPandas()
        return table[[f"f{i}" for i in range(width)]].to_numpy(), table["label"].to_numpy()

    if n_toxic and n_clean:
        grammar.arcs = learned_arcs(*measured("event_sums", EVENTS), grammar.arcs)
        grammar.mean, grammar.coefficients = logistic(*measured("features", 4))
    else:
        grammar.mean, grammar.coefficients = np.zeros(4), np.array([-3.0, 1.0, 1.0, 0.0, 0.0])
    return grammar


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    keep: Iterable[str] | None = None,
    threshold: float = 0.7,
    toxic_rows: int = 1500,
    clean_rows: int = 6000,
) -> DataFrame:
    """A toxicity score of every whole text, from the clauses that a finite-state grammar matches.

    Insult, threat, negation, reported-speech and target transducers are
    composed into one automaton, which runs over every clause with a match,
    whatever its length. The weights of its events are learned from the labels.

    Learns from labelled rows where ``learn`` (a condition on the documents;
    default: all) holds, at most about ``toxic_rows`` and ``clean_rows`` of
    them; a score uses the text alone.

    Returns ``keep`` (all input columns by default), score (0 to 1) and
    predicted (1 from ``threshold`` on), which replace input columns of these
    names. Null and empty texts match no clause and get the base score. Without
    labels of both kinds the grammar keeps its starting words and fixed
    coefficients. Rows without an id are scored, not learned from; repeated
    rows have the same result; an empty table gives an empty result.
    """
    own = carried(docs, keep, ("score", "predicted"))
    known = labels.select(quoted(key).alias("id"), quoted(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    rows = docs if learn is None else docs.where(learn)
    rows = rows.select(quoted(key).alias("id"), quoted(text).alias("text"))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    shared = docs.sparkSession.sparkContext.broadcast(train(rows, known, toxic_rows, clean_rows))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = shared.value
        machine = grammar.automaton()
        for part in texts:
            values = [grammar.features(t or "", machine) for t in part]
            yield pd.Series(grammar.score(np.array(values, float).reshape(len(values), 4)))

    scored = docs.select(*[quoted(c) for c in own], score(quoted(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", in_fold(F.col("doc_id"), 3, 1))
    return score_toxicity(docs, read(spark, sf_dir, "labels"), ~F.col("held_out"), keep=["doc_id", "held_out"])
