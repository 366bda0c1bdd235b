"""Learning of method weights from labelled reads, and accuracy reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import softmax
from .loops import cut


def truth(reads: DataFrame, classes: DataFrame, lineage: DataFrame | None = None, rank: str | None = "genus") -> DataFrame:
    """(read_id, class_id) that count as right: classes of the read's key, and those that share its ``rank``."""
    own = reads.select("read_id", "key").join(classes.select("key", "class_id"), "key").select("read_id", "class_id")
    if lineage is None or rank is None:
        return own.distinct()
    shared = own.join(lineage.select("class_id", F.col(rank).alias("taxon")), "class_id").select("read_id", "taxon").distinct()
    return shared.join(lineage.select("class_id", F.col(rank).alias("taxon")), "taxon").select("read_id", "class_id").unionByName(own).distinct()


def uniform_weights(scores: DataFrame, value: float = 0.5) -> DataFrame:
    return scores.select("method", "class_id").distinct().withColumn("weight", F.lit(value))


def forward(scores: DataFrame, weights: DataFrame, right: DataFrame) -> DataFrame:
    """(read_id, class_id, vote, p, y): weighted votes, their softmax over classes, and the truth."""
    votes = scores.join(weights, ["method", "class_id"]).groupBy("read_id", "class_id").agg(F.sum(F.col("score") * F.col("weight")).alias("vote"))
    votes = votes.withColumn("p", softmax(F.col("vote"), W.partitionBy("read_id")))
    marked = votes.join(right.select("read_id", "class_id").distinct().withColumn("y", F.lit(1.0)), ["read_id", "class_id"], "left")
    return marked.withColumn("y", F.coalesce("y", F.lit(0.0)))


def error(scores: DataFrame, state: DataFrame) -> DataFrame:
    """(method, class_id, error): mean over reads of (truth - p) * score."""
    reads = state.select("read_id").distinct().count()
    rows = scores.join(state.select("read_id", "class_id", (F.col("y") - F.col("p")).alias("gap")), ["read_id", "class_id"])
    sums = rows.groupBy("method", "class_id").agg(F.sum(F.col("gap") * F.col("score")).alias("s"))
    return sums.select("method", "class_id", (F.col("s") / F.lit(reads)).alias("error"))


def stepped(weights: DataFrame, errors: DataFrame, rate: float) -> DataFrame:
    """Weights moved by ``rate`` times the error, clipped to [0.0001, 0.9999], and divided by their sum."""
    moved = weights.join(errors, ["method", "class_id"], "left")
    raw = F.col("weight") + F.coalesce("error", F.lit(0.0)) * rate
    clipped = moved.withColumn("w", F.least(F.greatest(raw, F.lit(0.0001)), F.lit(0.9999)))
    return clipped.select("method", "class_id", (F.col("w") / F.sum("w").over(W.partitionBy())).alias("weight"))


def rmse(state: DataFrame) -> DataFrame:
    """Root mean squared difference of truth and softmax over all cells."""
    return state.agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("p"), 2))).alias("rmse"))


def hits(state: DataFrame, right: DataFrame) -> DataFrame:
    """(reads, hits): how many reads' first best class is right."""
    best = state.groupBy("read_id").agg(F.max_by("class_id", F.struct(F.col("vote"), -F.col("class_id"))).alias("class_id"))
    marked = best.join(right.select("read_id", "class_id").distinct().withColumn("ok", F.lit(1)), ["read_id", "class_id"], "left")
    return marked.agg(F.count("*").alias("reads"), F.coalesce(F.sum("ok"), F.lit(0)).alias("hits"))


def train(scores: DataFrame, right: DataFrame, rounds: int = 1000, rate: float = 0.02, patience: int = 2) -> DataFrame:
    """Weights (method, class_id, weight) of the round with most hits.

    A round that does not lower the error halves and turns the rate; more than
    ``patience`` such rounds on balance end the training. Weights number methods
    times classes; scores are read from a checkpoint each round.
    """
    scores, weights = cut(scores), uniform_weights(scores)
    last, best, kept, failures = float("inf"), -1, weights, 0
    for _ in range(rounds):
        state = cut(forward(scores, weights, right))
        now, n = rmse(state).first()[0], hits(state, right).first()[1]
        if n > best:
            best, kept = n, weights
        if now is None:
            break
        if now >= last:
            rate, failures = -rate / 2, failures + 1
            if failures > patience:
                break
        else:
            failures = max(0, failures - 1)
        last = now
        weights = cut(stepped(weights, error(scores, state), rate))
    return kept


def method_accuracy(scores: DataFrame, right: DataFrame) -> DataFrame:
    """(method, reads, hits): each method on its own; of equal scores the first class counts."""
    best = scores.groupBy("method", "read_id").agg(F.max_by("class_id", F.struct(F.col("score"), -F.col("class_id"))).alias("class_id"))
    marked = best.join(right.select("read_id", "class_id").distinct().withColumn("ok", F.lit(1)), ["read_id", "class_id"], "left")
    return marked.groupBy("method").agg(F.count("*").alias("reads"), F.coalesce(F.sum("ok"), F.lit(0)).alias("hits"))


def performance(shortlisted: DataFrame, right: DataFrame, reads: DataFrame, strict: bool = False) -> DataFrame:
    """(reads, hits): reads for which any shortlisted class (``strict``: the first) is right."""
    rows = shortlisted.where("place = 1") if strict else shortlisted
    ok = rows.join(right.select("read_id", "class_id").distinct(), ["read_id", "class_id"], "left_semi").select("read_id").distinct()
    marked = reads.select("read_id").distinct().join(ok.withColumn("ok", F.lit(1)), "read_id", "left")
    return marked.agg(F.count("*").alias("reads"), F.coalesce(F.sum("ok"), F.lit(0)).alias("hits"))
