"""Lineage files, taxonomy dumps and label maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions.sequence import class_key
from ..operators.taxonomy import RANKS

LINE = r"^\s*([^:]+?)\s*:\s*(\d+)\s*(?:\((.*)\))?\s*$"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, place, value) of the lines of small files; a file is read whole, by one task, so lines keep their order."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("place", "value"))
    return rows.where("value <> ''")


def read_lineage_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(class_key, place, rank, taxid, name) of lineage files, from the strain up; lines of other forms are left out."""
    return parse_lineage_lines(lines(spark, path))


def parse_lineage_lines(rows: DataFrame) -> DataFrame:
    """As ``read_lineage_lines``, from lines (path, place, value)."""
    part = lambda i: F.regexp_extract("value", LINE, i)
    rows = rows.where(F.col("value").rlike(LINE))
    return rows.select(class_key(F.col("path")).alias("class_key"), "place", part(1).alias("rank"), part(2).cast("long").alias("taxid"), part(3).alias("name"))


def lineage_table(rows: DataFrame) -> DataFrame:
    """(class_key, strain, species .. superkingdom): the first line is the strain; ranks that are absent are null."""
    cells = [F.max(F.when(F.col("rank") == r, F.col("taxid"))).alias(r) for r in RANKS]
    return rows.groupBy("class_key").agg(F.min_by("taxid", "place").alias("strain"), *cells)


def lineage_nodes(rows: DataFrame) -> DataFrame:
    """(id, parent_id, rank, name): each line is a node, the next line its parent."""
    parent = F.lead("taxid").over(W.partitionBy("class_key").orderBy("place"))
    nodes = rows.select(F.col("taxid").alias("id"), parent.alias("parent_id"), "rank", "name")
    return nodes.groupBy("id").agg(F.max("parent_id").alias("parent_id"), F.first("rank").alias("rank"), F.first("name").alias("name"))


def write_lineages(ancestry: DataFrame, path: str) -> None:
    """One file part for each id, lines in order."""
    ordered = ancestry.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    ordered.select("id", text.alias("value")).write.mode("overwrite").partitionBy("id").text(path)


def dump(raw: DataFrame) -> DataFrame:
    """Rows of a taxonomy dump as arrays: fields are parted by tab, bar, tab."""
    return raw.select(F.split(F.regexp_replace("value", r"\t\|\s*$", ""), r"\t\|\t").alias("f"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return parse_nodes(spark.read.text(path))


def parse_nodes(raw: DataFrame) -> DataFrame:
    f = F.col("f")
    return dump(raw).select(f[0].cast("long").alias("id"), f[1].cast("long").alias("parent_id"), f[2].alias("rank"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(id, name): scientific names only."""
    return parse_names(spark.read.text(path))


def parse_names(raw: DataFrame) -> DataFrame:
    f = F.col("f")
    rows = dump(raw).select(f[0].cast("long").alias("id"), f[1].alias("name"), F.element_at(f, -1).alias("kind"))
    return rows.where("kind = 'scientific name'").select("id", "name")


def read_gi_taxids(spark: SparkSession, path: str) -> DataFrame:
    return parse_gi_taxids(spark.read.text(path))


def parse_gi_taxids(raw: DataFrame) -> DataFrame:
    parts = F.split("value", r"\s+")
    return raw.where("value <> ''").select(parts[0].alias("gi"), parts[1].cast("long").alias("taxid"))


def read_label_map(spark: SparkSession, path: str, classes: DataFrame | None = None) -> DataFrame:
    """(label, taxid): the second field is a taxid, or the name of a class (class_key, taxid)."""
    return parse_label_map(spark.read.text(path), classes)


def parse_label_map(raw: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    rows = raw.where("trim(value) <> ''").select(parts[0].alias("label"), F.get(parts, F.lit(1)).alias("second"))
    number = F.when(F.col("second").rlike(r"^\d+$"), F.col("second").cast("long"))
    if classes is None:
        return rows.select("label", number.alias("taxid"))
    named = rows.join(classes.select(F.col("class_key").alias("second"), F.col("taxid").alias("of_class")), "second", "left")
    return named.select("label", F.coalesce(number, "of_class").alias("taxid"))
