"""Diagonal Gaussian mixtures of each class, by expectation-maximisation over arrays of all restarts."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import VARIANCE_FLOOR, softmax
from . import blocks
from .loops import cut

LEAST_WEIGHT = 1e-7
#: Genes of a class that one group holds.
BLOCK = 4096

Start = Callable[[np.ndarray, int, int], np.ndarray]


def fixed_start(keys: np.ndarray, restart: int, clusters: int) -> np.ndarray:
    """Raw responsibilities (genes, clusters) from the gene's id modulo 10, the same at each restart: only for comparison with SQL."""
    return 1.0 + (keys[:, None] * 7 + np.arange(1, clusters + 1) * 13) % 10


def random_start(keys: np.ndarray, restart: int, clusters: int) -> np.ndarray:
    """Raw responsibilities from the gene's seeded hash, its restart and cluster, mixed anew."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(restart * clusters + 1, (restart + 1) * clusters + 1, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) + 1.0


def densities(x: np.ndarray, mean: np.ndarray, variance: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """ln of weight and density of each row under each cluster; -inf for clusters that were dropped."""
    out = np.full((len(x), len(weight)), -np.inf)
    for k in np.flatnonzero(weight > 0):
        v = np.where(variance[k] <= 0, VARIANCE_FLOOR, variance[k])
        gap = x - mean[k]
        out[:, k] = math.log(weight[k]) - 0.5 * np.log(2 * math.pi * v).sum() - (gap * gap / (2 * v)).sum(axis=1)
    return out


def expectation(x: np.ndarray, raw: np.ndarray | None, model: tuple[np.ndarray, ...] | None) -> tuple[np.ndarray, float]:
    """Responsibilities, and the rows' log-likelihood under the model; raw ones are only normalised."""
    if model is None:
        return raw / raw.sum(axis=1, keepdims=True), 0.0
    score = densities(x, *model)
    most = score.max(axis=1, keepdims=True)
    e = np.exp(score - most)
    total = e.sum(axis=1, keepdims=True)
    return e / total, float((most + np.log(total)).sum())


def sums_of(x: np.ndarray, r: np.ndarray, likelihood: float) -> np.ndarray:
    """One array: the log-likelihood, and for each cluster the sums of r, r x and r x^2."""
    return np.concatenate([[likelihood], r.sum(axis=0), (r.T @ x).ravel(), (r.T @ (x * x)).ravel()])


def maximised(sums: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, variances and weights; clusters of next to no weight have weight 0."""
    s = sums[1 : clusters + 1]
    a, b = sums[clusters + 1 :].reshape(2, clusters, -1)
    kept = s >= LEAST_WEIGHT
    safe = np.where(kept, s, 1.0)[:, None]
    mean = a / safe
    return mean, b / safe - mean * mean, np.where(kept, s / s.sum(), 0.0)


def fit(
    genes: DataFrame, vectors: DataFrame, clusters: int = 3, rounds: int = 120, tolerance: float = 1e-7, restarts: int = 120, seed: int = 0, fixed: bool = False
) -> DataFrame:
    """(class_id, cluster, word, mean, variance, weight): the model of each class from the restart with the highest log-likelihood.

    ``vectors`` (gene_id, word, x) are dense: every gene has every word. Each
    restart of each class begins with random responsibilities and ends after
    ``rounds`` of EM, or when its log-likelihood gains less than ``tolerance``
    of itself; one that is not a number loses, the first of equals wins.
    ``fixed``: one start, ``fixed_start``, on whole-number ids.

    Genes stand as arrays in blocks of a class. A round is one pass: each block
    meets the models of its class's live restarts, both steps are products of
    arrays, and one array of sums a restart leaves it, summed by class and
    restart. So no row a word is built or joined, and classes of any size are
    spread. Every round is checkpointed.
    """
    restarts = 1 if fixed else restarts
    start: Start = fixed_start if fixed else random_start
    spark = genes.sparkSession
    words = sorted(r[0] for r in vectors.select("word").distinct().collect())
    own = genes.select("gene_id", "class_id").distinct()
    arrays = blocks.packed(vectors.select("gene_id", "word", F.col("x").alias("cells")), ["gene_id"], ["cells"])
    sizes = own.groupBy("class_id").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    hashed = F.col("gene_id").cast("long") if fixed else F.xxhash64(F.lit(seed), "gene_id")
    part = F.pmod(F.xxhash64("gene_id"), F.col("parts")).cast("int")
    dealt = cut(own.join(sizes, "class_id").join(arrays, "gene_id").select("class_id", part.alias("part"), hashed.alias("key"), "cells", "parts"))
    of_class = dealt.select("class_id", "parts").distinct()
    kind = genes.schema["class_id"].dataType.simpleString()
    shape = f"class_id {kind}, restart int, sums array<double>"

    def first(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x, keys = blocks.matrix(table["cells"]), table["key"].to_numpy()
        found = [sums_of(x, *expectation(x, start(keys, n, clusters), None)) for n in range(restarts)]
        return pa.table({"class_id": pa.array([key[0].as_py()] * restarts, table["class_id"].type), "restart": pa.array(range(restarts), pa.int32()), "sums": found})

    def step(table: pa.Table, models: pa.Table) -> pa.Table:
        x, found = blocks.matrix(table["cells"]) if len(table) else None, []
        for sums in models["sums"].to_pylist() if len(table) else ():
            found.append(sums_of(x, *expectation(x, None, maximised(np.array(sums), clusters))))
        some = models.slice(0, len(found))
        return pa.table({"class_id": some["class_id"], "restart": some["restart"], "sums": pa.array(found, pa.list_(pa.float64()))})

    totals = lambda parts: cut(blocks.array_sums(parts, ["class_id", "restart"], "sums"))
    model = totals(dealt.groupBy("class_id", "part").applyInArrow(first, shape))
    before = kept = None
    for number in range(rounds):
        every = F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part")
        sent = model.join(of_class, "class_id").select("class_id", "restart", "sums", every)
        after = totals(dealt.groupBy("class_id", "part").cogroup(sent.groupBy("class_id", "part")).applyInArrow(step, shape))
        now = after.select("class_id", "restart", F.col("sums")[0].alias("l"))
        gains = F.lit(False) if before is None else F.col("l") - F.col("before") > tolerance * F.abs("before")
        now = now if before is None else now.join(before, ["class_id", "restart"])
        ended = F.lit(number == rounds - 1) | F.isnan("l") | (F.lit(before is not None) & ~F.coalesce(gains, F.lit(False)))
        now = cut(now.select("class_id", "restart", "l", ended.alias("ended")))
        done = model.join(now.where("ended"), ["class_id", "restart"]).select("class_id", "restart", "sums", "l")
        kept = cut(best_restarts(done if kept is None else kept.unionByName(done)))
        live = now.where("not ended")
        if live.isEmpty():
            break
        before = live.select("class_id", "restart", F.col("l").alias("before"))
        model = after.join(live.select("class_id", "restart"), ["class_id", "restart"], "left_semi")

    cells = "array<struct<cluster:int,mean:array<double>,variance:array<double>,weight:double>>"

    def unfolded(table: pa.Table) -> pa.Table:
        out = []
        for sums in table["sums"].to_pylist():
            mean, variance, weight = maximised(np.array(sums), clusters)
            out.append([{"cluster": k + 1, "mean": mean[k], "variance": variance[k], "weight": float(weight[k])} for k in range(clusters) if weight[k] > 0])
        inner = pa.struct([("cluster", pa.int32()), ("mean", pa.list_(pa.float64())), ("variance", pa.list_(pa.float64())), ("weight", pa.float64())])
        return pa.table({"class_id": table["class_id"], "c": pa.array(out, pa.list_(inner))})

    wide = kept.groupBy("class_id").applyInArrow(unfolded, f"class_id {kind}, c {cells}").select("class_id", F.explode("c").alias("c"))
    names = F.array(*[F.lit(w) for w in words]) if words else F.array()
    each = F.explode(F.arrays_zip(names.alias("word"), F.col("c.mean").alias("mean"), F.col("c.variance").alias("variance")))
    return wide.select("class_id", F.col("c.cluster").alias("cluster"), F.col("c.weight").alias("weight"), each.alias("e")).select(
        "class_id", "cluster", F.col("e.word").cast(vectors.schema["word"].dataType).alias("word"), "e.mean", "e.variance", "weight"
    )


def best_restarts(models: DataFrame) -> DataFrame:
    """Rows of each class's restart with the highest log-likelihood l, the first of equals; one that is not a number loses."""
    rank = F.struct(F.when(F.isnan("l"), None).otherwise(F.col("l")).alias("l"), -F.col("restart"))
    best = models.groupBy("class_id").agg(F.max_by("restart", rank).alias("restart"))
    return models.join(best, ["class_id", "restart"], "left_semi")


def cluster_scores(vectors: DataFrame, model: DataFrame, key: str = "read_id", own: DataFrame | None = None) -> DataFrame:
    """(key, class_id, cluster, score): ln of weight and density; of the gene's own class only where ``own`` (key, class_id) is given.

    Vectors are packed into arrays and meet the clusters' arrays as products of blocks.
    """
    v = F.when(F.col("variance") <= 0, VARIANCE_FLOOR).otherwise(F.col("variance"))
    cells = model.select("class_id", "cluster", "word", "mean", (1 / (2 * v)).alias("scale"), (-0.5 * F.log(2 * math.pi * v)).alias("k"), "weight")
    classes = blocks.packed(cells, ["class_id", "cluster", "weight"], ["mean", "scale", "k"])
    constant = F.log("weight") + F.aggregate("k", F.lit(0.0), lambda a, b: a + b)
    classes = classes.select("class_id", "cluster", "mean", "scale", constant.alias("constant"))
    reads = blocks.packed(vectors.select(key, "word", F.col("x").alias("cells")), [key], ["cells"])
    found = blocks.score_table(reads, key, classes, ["class_id", "cluster"], ["mean", "scale", "constant"], blocks.weighted_gaps)
    return found if own is None else found.join(own.select(key, "class_id"), [key, "class_id"])


def class_posteriors(scores: DataFrame, key: str = "read_id") -> DataFrame:
    """(key, class_id, score): shares of all classes' clusters, one softmax for each read, summed by class."""
    shares = scores.withColumn("p", softmax(F.col("score"), W.partitionBy(key)))
    return shares.groupBy(key, "class_id").agg(F.sum("p").alias("score"))
