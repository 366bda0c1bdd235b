"""Models of classes and the scores they give to reads.

Vectors are long: (entity, word, x). Scores are long: (read_id, class_id, score).
A model has a row for each class and word, so it grows with the number of
classes, not of reads; whether it is broadcast is left to its measured size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import VARIANCE_FLOOR, floored, log_density
from . import blocks
from .loops import cut

#: Rows of a model (a class and word each) up to which it goes to every task: a domain of few words would deal all vectors to as many tasks.
SENT_ROWS = 1 << 20


def sent(model: DataFrame) -> DataFrame:
    """A model that was cut, broadcast if it is small."""
    return F.broadcast(model) if model.count() <= SENT_ROWS else model


def grid(reads: DataFrame, classes: DataFrame) -> DataFrame:
    """Every read with every class: the shape of a full score table, which is what its callers return."""
    rows = reads.select("read_id", F.array(F.lit(0.0)).alias("cells"))
    return blocks.score_table(rows, "read_id", classes.select("class_id").distinct().withColumn("one", F.lit(0.0)), ["class_id"], ["one"], blocks.nothing).drop("score")


def bayes_model(genes: DataFrame, vectors: DataFrame, pseudocount: float = 0.0) -> DataFrame:
    """(class_id, word, mean, variance) of the genes (gene_id, class_id) of each class.

    Sums are divided by the number of genes, so words that a gene lacks count as zero.
    """
    counts = genes.groupBy("class_id").agg(F.countDistinct("gene_id").alias("genes"))
    sums = vectors.join(genes.select("gene_id", "class_id").distinct(), "gene_id").groupBy("class_id", "word")
    sums = sums.agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).join(counts, "class_id")
    mean = (F.col("s") + pseudocount) / F.col("genes")
    plain = F.col("s") / F.col("genes")
    return sums.select("class_id", "word", mean.alias("mean"), (F.col("q") / F.col("genes") - plain * plain).alias("variance"))


def bayes_scores_direct(vectors: DataFrame, model: DataFrame) -> DataFrame:
    """Naive Bayes log densities where every vector and every class has every word (dense vectors), packed into arrays in the order of the words."""
    return bayes_scores_cells(blocks.packed(vectors.select("read_id", "word", F.col("x").alias("cells")), ["read_id"], ["cells"]), model)


def bayes_scores_cells(reads: DataFrame, model: DataFrame) -> DataFrame:
    """The same of arrays (read_id, cells) in the order of the model's words; reads are not moved while the model is small."""
    v = floored(F.col("variance"))
    cells = model.select("class_id", "word", "mean", (1 / (2 * v)).alias("scale"), (-0.5 * F.log(2 * math.pi * v)).alias("k"))
    classes = blocks.packed(cells, ["class_id"], ["mean", "scale", "k"])
    classes = classes.select("class_id", "mean", "scale", F.aggregate("k", F.lit(0.0), lambda a, b: a + b).alias("constant"))
    return blocks.score_table(reads, "read_id", classes, ["class_id"], ["mean", "scale", "constant"], blocks.weighted_gaps)


def bayes_scores(vectors: DataFrame, model: DataFrame, reads: DataFrame, domain: int) -> DataFrame:
    """The same over a domain of ``domain`` words of which most are absent.

    Each class has one constant (all words absent); present words add the
    difference. Words that a class lacks have mean 0 and the least variance.
    The model is read several times and computed once.
    """
    model = cut(model)
    v = floored(F.col("variance"))
    at_zero = log_density(F.lit(0.0), F.col("mean"), F.col("variance"))
    absent = -0.5 * math.log(2 * math.pi * VARIANCE_FLOOR)
    constants = model.groupBy("class_id").agg((F.sum(at_zero) + (domain - F.count("*")) * absent).alias("constant"))
    squares = vectors.groupBy("read_id").agg(F.sum(F.col("x") * F.col("x")).alias("squares"))
    shared = vectors.join(sent(model), "word").groupBy("read_id", "class_id")
    shared = shared.agg(
        F.sum((2 * F.col("x") * F.col("mean") - F.col("x") * F.col("x")) / (2 * v)).alias("gain"),
        F.sum(F.col("x") * F.col("x")).alias("known"),
    )
    full = grid(reads, model).join(shared, ["read_id", "class_id"], "left").join(squares, "read_id", "left").join(constants, "class_id")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rest = (zero(F.col("squares")) - zero(F.col("known"))) / (2 * VARIANCE_FLOOR)
    return full.select("read_id", "class_id", (F.col("constant") + zero(F.col("gain")) - rest).alias("score"))


def nearest_gene(reads: DataFrame, vectors: DataFrame, genes: DataFrame, gene_vectors: DataFrame, mode: str = "min") -> DataFrame:
    """Least (or, with mode ``max``, greatest) similarity of a read to a class's genes.

    Pairs that share no word have similarity 0; they are counted, not built: a
    class with more genes than the read has partners in it scores 0 at most.
    """
    right = gene_vectors.join(genes.select("gene_id", "class_id"), "gene_id").select("gene_id", "class_id", "word", F.col("x").alias("y"))
    pairs = vectors.join(right, "word").groupBy("read_id", "class_id", "gene_id").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    best = F.min("s") if mode == "min" else F.max("s")
    found = pairs.groupBy("read_id", "class_id").agg(best.alias("s"), F.count("*").alias("partners"))
    sizes = genes.groupBy("class_id").agg(F.countDistinct("gene_id").alias("genes"))
    full = grid(reads, genes).join(found, ["read_id", "class_id"], "left").join(sizes, "class_id")
    some_apart = F.coalesce("partners", F.lit(0)) < F.col("genes")
    zero_or = F.least(F.coalesce("s", F.lit(0.0)), F.lit(0.0)) if mode == "min" else F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(0.0))
    return full.select("read_id", "class_id", F.when(some_apart, zero_or).otherwise(F.col("s")).alias("score"))


def nearest_gene_dense(reads: DataFrame, genes: DataFrame, mode: str = "min", block: int = 4096) -> DataFrame:
    """As ``nearest_gene``, for arrays over a small domain of words: reads (read_id, cells), genes (gene_id, class_id, cells).

    Both sides are dealt in blocks of about ``block`` rows; each block of reads
    meets each block of genes as a product of two matrices, of which only the
    least (greatest) value of each read and class leaves the task.
    """
    import numpy as np
    import pyarrow as pa

    reads, genes = cut(reads.select("read_id", "cells")), cut(genes.select("gene_id", "class_id", "cells"))
    (r_count,), (g_count,) = reads.agg(F.count("*")).first(), genes.agg(F.count("*")).first()
    # no more pairs of blocks than tasks are worth, and enough to keep every core busy
    across, down = max(1, -(-r_count // block)), max(1, -(-g_count // block))
    place = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = reads.select(place("read_id", across).alias("a"), every(down).alias("b"), "read_id", "cells")
    right = genes.select(every(across).alias("a"), place("gene_id", down).alias("b"), "class_id", "cells")
    kind_r, kind_c = reads.schema["read_id"].dataType.simpleString(), genes.schema["class_id"].dataType.simpleString()
    ufunc = np.minimum if mode == "min" else np.maximum

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)

    def best(r: pa.Table, g: pa.Table) -> pa.Table:
        if not r.num_rows or not g.num_rows:
            return pa.table({"read_id": r["read_id"].slice(0, 0), "class_id": g["class_id"].slice(0, 0), "score": pa.array([], pa.float64())})
        g = g.sort_by("class_id")
        ids = g["class_id"].combine_chunks().dictionary_encode()
        first = np.flatnonzero(np.diff(ids.indices.to_numpy(), prepend=-1))
        found = ufunc.reduceat(matrix(r["cells"]) @ matrix(g["cells"]).T, first, axis=1)
        n, m = found.shape
        of_read, of_class = pa.array(np.repeat(np.arange(n), m)), pa.array(np.tile(first, n))
        return pa.table({"read_id": r["read_id"].take(of_read), "class_id": g["class_id"].take(of_class), "score": found.ravel()})

    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(best, f"read_id {kind_r}, class_id {kind_c}, score double")
    return met.groupBy("read_id", "class_id").agg((F.min if mode == "min" else F.max)("score").alias("score"))


def sparse_scores(read_words: DataFrame, read_lengths: DataFrame, class_words: DataFrame, class_lengths: DataFrame) -> DataFrame:
    """Shared distinct words times ln(class length / read length); pairs that share none have no row."""
    shared = read_words.select("read_id", "word").join(class_words.select("class_id", "word"), "word")
    shared = shared.groupBy("read_id", "class_id").agg(F.count("*").alias("shared"))
    sized = shared.join(read_lengths.withColumnRenamed("length", "read_length"), "read_id").join(class_lengths.withColumnRenamed("length", "class_length"), "class_id")
    score = F.col("shared") * F.log(F.col("class_length") / F.col("read_length"))
    return sized.select("read_id", "class_id", "shared", score.alias("score"))


def full_vectors(entities: DataFrame, key: str, vectors: DataFrame, symbols: str, prefix: int) -> DataFrame:
    """One row (key, cells): the dense array of all words in alphabet order."""
    size = len(symbols) ** (prefix + 1)
    from ..functions.sequence import word_code

    cells = F.map_from_entries(F.collect_list(F.struct(word_code(F.col("word"), symbols).alias("k"), F.col("x").alias("v"))))
    arrays = vectors.groupBy(key).agg(cells.alias("m"))
    filled = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    none = F.array_repeat(F.lit(0.0), size)
    return entities.select(key).distinct().join(arrays, key, "left").select(key, F.when(F.col("m").isNull(), none).otherwise(filled).alias("cells"))


def difference_model(genes: DataFrame, gene_cells: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(class_id, x, y, value): mean over a class's genes of weighted signed squared differences of cells x < y.

    ``weights`` (gene_id, weight) are the genes' relative likelihoods; 1 where
    none is given. Genes are added up as arrays of all pairs; a class unfolds
    into a row a pair at the end.
    """
    rows = genes.select("gene_id", "class_id").join(gene_cells, "gene_id")
    rows = rows.withColumn("weight", F.lit(1.0)) if weights is None else rows.join(weights, "gene_id")
    # n cells have n * (n - 1) / 2 pairs, in the order of x, then y: x begins at x * n - x * (x + 1) / 2
    n = F.round((1 + F.sqrt(1 + 8 * F.size("s"))) / 2).cast("int")
    counts = genes.groupBy("class_id").agg(F.countDistinct("gene_id").alias("genes"))
    sums = blocks.weighted_differences(rows, "class_id", "cells", "weight").join(counts, "class_id")
    per_x = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda x: F.struct(x.alias("x"), F.slice("s", (x * n - x * (x + 1) / 2).cast("int") + 1, n - 1 - x).alias("v")))
    wide = sums.select("class_id", "genes", F.explode(per_x).alias("r"))
    return wide.select("class_id", "genes", F.col("r.x").alias("x"), F.posexplode("r.v").alias("j", "v")).select(
        "class_id", "x", (F.col("x") + F.col("j") + 1).alias("y"), (F.col("v") / F.col("genes")).alias("value")
    )


def likelihood_weights(genes: DataFrame, vectors: DataFrame, model: DataFrame, domain: int) -> DataFrame:
    """(gene_id, weight): each gene's log density in its own class over that of the class mean.

    A gene meets the words of its own class alone; words that the class lacks
    have mean 0 and the least variance.
    """
    model, own = cut(model), genes.select("gene_id", "class_id").distinct()
    x, v = F.col("x"), floored(F.col("variance"))
    absent = -0.5 * math.log(2 * math.pi * VARIANCE_FLOOR)
    rest = (domain - F.count("*")) * absent
    at_zero = log_density(F.lit(0.0), F.col("mean"), F.col("variance"))
    classes = model.groupBy("class_id").agg((F.sum(at_zero) + rest).alias("constant"), (F.sum(-0.5 * F.log(2 * math.pi * v)) + rest).alias("best"))
    classes = cut(classes)
    gain = F.when(F.col("mean").isNull(), -x * x / (2 * VARIANCE_FLOOR)).otherwise((2 * x * F.col("mean") - x * x) / (2 * v))
    met = vectors.select("gene_id", "word", "x").join(own, "gene_id").join(sent(model), ["class_id", "word"], "left")
    gains = met.groupBy("gene_id", "class_id").agg(F.sum(gain).alias("gain"))
    scored = own.join(gains, ["gene_id", "class_id"], "left").join(sent(classes), "class_id")
    return scored.select("gene_id", ((F.col("constant") + F.coalesce("gain", F.lit(0.0))) / F.col("best")).alias("weight"))


def difference_scores(read_cells: DataFrame, model: DataFrame) -> DataFrame:
    """Twice the sum over pairs of the absolute difference between read and class; a class has all pairs.

    Reads become pairs inside tasks, some rows at a time, and meet each class's pairs there.
    """
    values = F.array_sort(F.collect_list(F.struct("x", "y", "value")))
    classes = model.groupBy("class_id").agg(values.alias("a_")).select("class_id", F.transform("a_", lambda s: s["value"]).alias("values"))
    return blocks.score_table(read_cells, "read_id", classes, ["class_id"], ["values"], blocks.difference_gaps)


def count_prior(classes: DataFrame, counts: DataFrame) -> DataFrame:
    """(class_id, score): ln(count / sum * (classes + 1)); a class without a count has 1."""
    every = W.partitionBy()
    rows = classes.select("class_id").distinct().join(counts, "class_id", "left").withColumn("c", F.coalesce("count", F.lit(1)))
    n = F.count("*").over(every) + 1
    return rows.select("class_id", F.log(F.col("c") / F.sum("c").over(every) * n).alias("score"))


def weight_prior(classes: DataFrame, weights: DataFrame) -> DataFrame:
    """(class_id, score): ln(weight); a class without a weight adds 0."""
    rows = classes.select("class_id").distinct().join(weights, "class_id", "left")
    return rows.select("class_id", F.coalesce(F.log("weight"), F.lit(0.0)).alias("score"))


def best_alignment(alignments: DataFrame) -> DataFrame:
    """Greatest alignment score of each read and class."""
    return alignments.groupBy("read_id", "class_id").agg(F.max("score").alias("score"))
