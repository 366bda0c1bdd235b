"""Score tables, weights, priors and alignments as text, and as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import class_key
from ..operators.rules import matched_by_place


def read_pairs(spark: SparkSession, path: str, value: str, kind: str) -> DataFrame:
    """(strain, value) from tab-separated lines."""
    return parse_pairs(spark.read.text(path), value, kind)


def parse_pairs(raw: DataFrame, value: str, kind: str) -> DataFrame:
    parts = F.split("value", "\t")
    return raw.where("value <> ''").select(class_key(parts[0]).alias("strain"), F.get(parts, F.lit(1)).cast(kind).alias(value))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return read_pairs(spark, path, "count", "long")


def read_prior_weights(spark: SparkSession, path: str) -> DataFrame:
    return read_pairs(spark, path, "weight", "double")


def write_scores(scores: DataFrame, path: str) -> None:
    """The long table, a folder for each method: later passes read only the methods they need."""
    scores.write.mode("overwrite").partitionBy("method").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("method", "read_id", "class_id", "score")


def score_matrix(scores: DataFrame, row: str, columns: list, column: str = "class_id", value: str = "score") -> DataFrame:
    """One row for each read, one column for each class in ``columns``."""
    return scores.groupBy(row).pivot(column, columns).agg(F.first(value))


def score_lines(scores: DataFrame, row: str, columns: list, method: str) -> DataFrame:
    """A header, then one tab-separated line for each read (place, value); absent scores are empty."""
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    wide = score_matrix(scores.where(F.col("method") == method), row, columns)
    body = wide.select(F.lit(1).alias("place"), F.concat_ws("\t", F.col(row).cast("string"), *[cell(c) for c in columns]).alias("value"))
    head = scores.sparkSession.createDataFrame([(0, "\t".join([f"method {method}", *map(str, columns)]))], "place int, value string")
    return head.unionByName(body)


def parse_score_lines(lines: DataFrame, classes: DataFrame, reads: DataFrame, method: str) -> DataFrame:
    """Long scores from (place, value); columns of unknown taxa and rows of unknown reads are left out.

    A taxon that heads several columns gives them to its classes (class_id,
    taxid) one by one, left to right.
    """
    head = lines.where("value like 'method %'").select(F.posexplode(F.split("value", "\t")).alias("at", "taxid")).where("at > 0")
    columns = head.select("at", F.col("taxid").cast("long").alias("taxid"))
    placed = matched_by_place(columns, classes.select("class_id", "taxid"), "taxid", ["at"], "class_id")
    cells = lines.where("value not like 'method %'").select(F.split("value", "\t").alias("f"))
    cells = cells.select(F.col("f")[0].alias("label"), F.posexplode("f").alias("at", "cell")).where("at > 0")
    rows = cells.join(placed, "at").join(reads.select("label", "read_id"), "label")
    return rows.select(F.lit(method).alias("method"), "read_id", "class_id", F.col("cell").cast("double").alias("score"))


def has_protein(scores: DataFrame) -> DataFrame:
    """Reads with a score in any method on proteins."""
    return scores.where("method like 'aa.%' and score is not null").select("read_id").distinct()


def weight_lines(weights: DataFrame, classes: DataFrame) -> DataFrame:
    """``taxid method weight`` lines; reverse methods share their partner's weight and are left out."""
    rows = weights.where("method not like '%\\_rc.%'").join(classes, "class_id")
    return rows.select(F.concat_ws("\t", F.col("taxid").cast("string"), "method", F.col("weight").cast("string")).alias("value"))


def parse_weight_lines(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """(method, class_id, class_weight); repeats of a taxid go to its classes in order."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where("trim(value) <> ''").select(parts[0].cast("long").alias("taxid"), parts[1].alias("method"), parts[2].cast("double").alias("class_weight"))
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    placed = matched_by_place(rows, classes.select("class_id", "taxid"), "taxid", ["at"], "class_id", among=["method"])
    return placed.select("method", "class_id", "class_weight")


def parse_sam(lines: DataFrame) -> DataFrame:
    """(short_label, class_key, score) of alignment lines (path, value); headers and lines without a score are left out."""
    score = F.nullif(F.regexp_extract("value", r"\tAS:i:(-?\d+)", 1), F.lit(""))
    rows = lines.where("value not like '@%'").select(F.split_part("value", F.lit("\t"), F.lit(1)).alias("short_label"), class_key(F.col("path")).alias("class_key"), score.cast("long").alias("score"))
    return rows.where("score is not null")


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_sam(spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value"))
