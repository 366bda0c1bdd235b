"""Algebra of vectors in long form (keys, word, x); a word that is absent is zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks


def add(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    both = a.select(*keys, "word", "x").unionByName(b.select(*keys, "word", "x"))
    return both.groupBy(*keys, "word").agg(F.sum("x").alias("x"))


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return add(a, scale(b, -1.0), keys)


def multiply(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Cell by cell; words of one side only are zero and left out."""
    right = b.select(*on, "word", F.col("x").alias("y"))
    return a.join(right, [*on, "word"]).withColumn("x", F.col("x") * F.col("y")).drop("y")


def scale(a: DataFrame, by: float) -> DataFrame:
    return a.withColumn("x", F.col("x") * F.lit(by))


def power(a: DataFrame, exponent: float) -> DataFrame:
    return a.withColumn("x", F.pow("x", F.lit(exponent)))


def add_power(a: DataFrame, b: DataFrame, exponent: float, keys: Sequence[str]) -> DataFrame:
    return add(a, power(b, exponent), keys)


def square_root(a: DataFrame) -> DataFrame:
    return a.withColumn("x", F.sqrt("x"))


def similarity(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """(a_key, b_key, score): sums of products over shared words; pairs without one have no row."""
    right = b.select(b_key, "word", F.col("x").alias("y"))
    return a.select(a_key, "word", "x").join(right, "word").groupBy(a_key, b_key).agg(F.sum(F.col("x") * F.col("y")).alias("score"))


def dense_similarity(a: DataFrame, a_key: str, b: DataFrame, b_key: str) -> DataFrame:
    """The same where both have all words: arrays (a_key, cells) in the order of b's words (b_key, word, x), as products of blocks."""
    return blocks.score_table(a, a_key, blocks.packed(b, [b_key], ["x"]), [b_key], ["x"], blocks.inner_products)


def same_kind(a: int, b: int) -> None:
    """Tables of different word lengths can't be combined."""
    if a != b:
        raise ValueError(f"words of {a + 1} and {b + 1} letters")
