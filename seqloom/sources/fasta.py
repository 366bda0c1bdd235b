"""FASTA files: reads and genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import class_key, gi_number, scrub, short_label

#: Files of other tools that lie beside class files (fixed values).
SKIPPED = ("sa", "amb", "ann", "bwt", "pac", "sam", "bam", "sai", "lin", "log", "txt", "lst", "mcw")


def read_fasta(spark: SparkSession, path: str | list[str], labels_only: bool = False, recursive: bool = False) -> DataFrame:
    """(path, label, short_label, seq) of each record.

    A record starts with ``>`` at the start of a line; files are split between
    records, so large files are read in parallel. Sequence lines are joined
    without white space; the label is kept whole. What stands before a file's
    first record, and records without a label, are no records.
    """
    raw = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", recursive).text(path)
    out = parse_records(raw.select(F.col("_metadata.file_path").alias("path"), "value"))
    return out.drop("seq") if labels_only else out


def parse_records(raw: DataFrame) -> DataFrame:
    """(path, label, short_label, seq) of (path, value): the text of each record, from its label on."""
    # only the first record of a file still has its mark
    value = F.regexp_replace("value", r"^>", "")
    label = F.regexp_replace(F.split_part(value, F.lit("\n"), F.lit(1)), "\r$", "")
    rest = F.regexp_replace(value, r"^[^\n]*\n?", "")
    rows = raw.select("path", label.alias("label"), rest.alias("rest")).where("label <> ''")
    return rows.select("path", "label", short_label(F.col("label")).alias("short_label"), scrub(F.col("rest")).alias("seq"))


def is_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(path, fasta): whether each file's first byte is ``>``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", (F.substring("content", 1, 1) == F.lit(b">")).alias("fasta"))


def class_files(paths: DataFrame) -> DataFrame:
    """(path, class_key, profile): class files among paths; one with a saved profile (``.gist``) gives way to it."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = paths.withColumn("suffix", F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))).where(~F.col("suffix").isin(*SKIPPED))
    profiles = rows.where("suffix = 'gist'").select(F.regexp_replace("path", r"\.gist$", "").alias("path"))
    kept = rows.join(profiles, "path", "left_anti")
    return kept.select("path", class_key(F.col("path")).alias("class_key"), (F.col("suffix") == "gist").alias("profile"))


def with_gi(reads: DataFrame) -> DataFrame:
    return reads.withColumn("gi", gi_number(F.col("label")))


def write_fasta(rows: DataFrame, path: str, seq: str = "seq") -> None:
    rows.select(F.concat(F.lit(">"), "label", F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)
