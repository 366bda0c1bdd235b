"""From score tables to votes, shortlists and hits.

Scores are (method, read_id, class_id, score); votes are (read_id, class_id, vote).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import softmax

#: The methods, the alphabet of each, and whether it reads the reverse complement.
METHODS = [
    ("nt.bayes", "nt", False), ("aa.bayes", "aa", False), ("nt_rc.bayes", "nt", True),
    ("nt.1nn", "nt", False), ("aa.1nn", "aa", False), ("nt_rc.1nn", "nt", True),
    ("nt.codelta", "nt", False), ("aa.codelta", "aa", False), ("nt_rc.codelta", "nt", True),
    ("nt.gmm", "nt", False), ("aa.gmm", "aa", False), ("nt_rc.gmm", "nt", True),
    ("nt.sparse", "nt", False), ("aa.sparse", "aa", False), ("nt_rc.sparse", "nt", True),
    ("bwa", "alignment", False), ("16s", "prior", False), ("prior", "prior", False), ("bias", "prior", False),
]


def methods(spark) -> DataFrame:
    """(method, alphabet, reverse, forward): the method dimension; ``forward`` is a reverse method's partner."""
    rows = [(name, kind, rc, name.replace("_rc", "") if rc else None) for name, kind, rc in METHODS]
    return spark.createDataFrame(rows, "method string, alphabet string, reverse boolean, forward string")


def enabled(weights: dict[str, float], prefixes: dict[str, int], passes: list[dict[str, float]]) -> list[str]:
    """Methods to compute: some weight in some pass, and a word length where one is needed; reverse methods follow theirs."""
    out = []
    for name, kind, _ in METHODS:
        own = name.replace("_rc", "")
        used = weights.get(own, 0) != 0 and any(p.get(own, 0) != 0 for p in passes)
        if used and (kind in ("alignment", "prior") or prefixes.get(own, 0) > 0):
            out.append(name)
    return out


def prefix_lengths(names: list[str], prefixes: dict[str, int]) -> dict[str, list[int]]:
    """Word tables to build, by alphabet: each length once, however many methods use it."""
    kinds = {name: kind for name, kind, _ in METHODS}
    out: dict[str, set[int]] = {"nt": set(), "aa": set()}
    for name in names:
        if kinds[name] in out:
            out[kinds[name]].add(prefixes[name.replace("_rc", "")])
    return {k: sorted(v) for k, v in out.items()}


def orientation(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(read_id, use_reverse): whether weighted nucleotide scores are higher, by more than rounding, for the reverse complement.

    ``scores`` has the columns forward_method and reverse; ``weights`` (method, weight).
    """
    weighted = scores.join(weights.withColumnRenamed("method", "forward_method"), "forward_method")
    side = lambda rc: F.sum(F.when(F.col("reverse") == rc, F.col("score") * F.col("weight")).otherwise(0.0))
    sums = weighted.groupBy("read_id").agg(side(False).alias("forward"), side(True).alias("backward"))
    return sums.select("read_id", "forward", "backward", (F.round(F.col("backward") - F.col("forward"), 6) > 0).alias("use_reverse"))


def weighted_votes(scores: DataFrame, weights: DataFrame, class_weights: DataFrame | None = None, proteins: DataFrame | None = None) -> DataFrame:
    """Sums of score times weight; scores that are null or NaN add 0.

    ``weights`` (method, weight): console and pass weights multiplied.
    ``class_weights`` (method, class_id, class_weight): learned; 1 if absent.
    ``proteins`` (read_id): reads that have one; others take no part in methods on proteins.
    """
    rows = scores.join(weights, "method")
    if class_weights is not None:
        rows = rows.join(class_weights, ["method", "class_id"], "left")
    else:
        rows = rows.withColumn("class_weight", F.lit(1.0))
    if proteins is not None:
        rows = rows.join(proteins.select("read_id").distinct().withColumn("has_protein", F.lit(True)), "read_id", "left")
        rows = rows.where(~F.col("method").startswith("aa.") | F.coalesce("has_protein", F.lit(False)))
    score = F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0))
    vote = F.sum(score * F.col("weight") * F.coalesce("class_weight", F.lit(1.0)))
    return rows.groupBy("read_id", "class_id").agg(vote.alias("vote"))


def posteriors(scores: DataFrame, score: str = "score") -> DataFrame:
    """Softmax of each read's scores over all classes."""
    return scores.withColumn("posterior", softmax(F.col(score), W.partitionBy("read_id")))


def top_class(votes: DataFrame, vote: str = "vote") -> DataFrame:
    """Class with the highest vote of each read; of equals, the first."""
    best = F.max_by(F.struct("class_id", vote), F.struct(F.col(vote), -F.col("class_id")))
    return votes.groupBy("read_id").agg(best.alias("best")).select("read_id", "best.*")


def clamped_quota(quota: int, classes: int, final: bool) -> int:
    """At most half (final pass: a twelfth) of the classes, but 1 at least; only cut when exceeded."""
    most = max(1, classes // (12 if final else 2))
    return most if quota > most else quota


def clamped_quotas(quota: Column, classes: Column, final: bool) -> Column:
    """The same for columns of quotas and numbers of classes."""
    return F.least(quota, F.greatest(F.lit(1), F.floor(classes / (12 if final else 2)))).cast("int")


def shortlist(votes: DataFrame, threshold: float, quota: int) -> DataFrame:
    """(read_id, class_id, vote, place) of the classes kept.

    Kept are votes of at least ``threshold`` times the read's best (with a
    negative best, then, none), and the best ``quota`` by vote, then class.
    Padding adds no zero vote; it goes below zero only where no vote is zero or
    the best is not positive.
    """
    read = W.partitionBy("read_id")
    ranked = votes.withColumns(
        {
            "best": F.max("vote").over(read),
            "zeros": F.sum((F.col("vote") == 0).cast("int")).over(read),
            "place": F.row_number().over(read.orderBy(F.desc("vote"), "class_id")),
        }
    )
    near = F.col("best") * threshold <= F.col("vote")
    pad = (F.col("vote") > 0) | ((F.col("vote") < 0) & ((F.col("best") <= 0) | (F.col("zeros") == 0)))
    return ranked.where(near | ((F.col("place") <= quota) & pad)).select("read_id", "class_id", "vote", "place")


def shortlist_counts(classes: DataFrame, shortlisted: DataFrame) -> DataFrame:
    """(class_id, reads): how many reads have each class on their shortlist, zeros included."""
    counts = shortlisted.groupBy("class_id").agg(F.count("*").alias("n"))
    return classes.select("class_id").distinct().join(counts, "class_id", "left").select("class_id", F.coalesce("n", F.lit(0)).alias("reads"))


def two_passes(first: DataFrame, second: DataFrame, weights: tuple[DataFrame, DataFrame], lists: tuple[tuple[float, int], tuple[float, int]], prune: bool = False) -> tuple[DataFrame, DataFrame]:
    """Shortlists of both passes: the second votes with the first pass's scores and its own.

    With ``prune`` the second pass scores only what the first has shortlisted.
    """
    one = shortlist(weighted_votes(first, weights[0]), *lists[0])
    every = first.unionByName(second)
    if prune:
        every = every.join(one.select("read_id", "class_id"), ["read_id", "class_id"], "left_semi")
    return one, shortlist(weighted_votes(every, weights[1]), *lists[1])
