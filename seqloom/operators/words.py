"""Word (k-mer) tables: dense and sparse vectors of sequences in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import AMINO_ACIDS, overlapping


def word_rows(rows: DataFrame, keys: Sequence[str], prefix: int, seq: str = "seq", protein: bool = False) -> DataFrame:
    """One row (keys, word) for each word of ``prefix`` + 1 letters; sequences that are shorter have none.

    Words of a protein that hold a letter of no amino acid are skipped.
    """
    out = rows.select(*keys, F.explode(overlapping(F.col(seq), prefix + 1)).alias("word"))
    return out.where(~F.col("word").rlike(f"[^{AMINO_ACIDS}]")) if protein else out


def count_words(rows: DataFrame, keys: Sequence[str], prefix: int, seq: str = "seq", protein: bool = False) -> DataFrame:
    """(keys, word, n): counts, summed before they are shuffled."""
    return word_rows(rows, keys, prefix, seq, protein).groupBy(*keys, "word").agg(F.count("*").alias("n"))


def word_frequencies(rows: DataFrame, keys: Sequence[str], prefix: int, seq: str = "seq", protein: bool = False) -> DataFrame:
    """(keys, word, x): counts over the number of words of the sequence.

    The number is known from the sequence's length, so no second aggregation is
    needed; a protein's skipped words count in it.
    """
    sized = rows.withColumn("words_", F.length(seq) - prefix)
    counts = count_words(sized, [*keys, "words_"], prefix, seq, protein)
    return counts.select(*keys, "word", (F.col("n") / F.col("words_")).alias("x"))


def sparse_table(rows: DataFrame, keys: Sequence[str], prefix: int, seq: str = "seq", protein: bool = False) -> tuple[DataFrame, DataFrame]:
    """Word counts of groups of sequences, and (keys, length): the summed numbers of words."""
    lengths = rows.groupBy(*keys).agg(F.sum(F.greatest(F.length(seq) - prefix, F.lit(0))).alias("length"))
    return count_words(rows, keys, prefix, seq, protein), lengths


def exploded_vectors(rows: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """(keys, word, x) of an array column, with the place in it as the word."""
    return rows.select(*keys, F.posexplode(F.transform(F.col(vector), lambda v: v.cast("double"))).alias("word", "x"))
