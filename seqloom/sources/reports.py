"""Reports of hits, consensus and filtered reads; preparation of simulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..operators.ranks import running_sums
from ..operators.taxonomy import RANKS


def readable(hits: DataFrame) -> DataFrame:
    """(read_id, value): a label line, then a line for each hit (label, rank, taxid, name, score), best first."""
    line = F.concat(F.lit("  "), "rank", F.lit(" #"), F.col("taxid").cast("string"), F.lit(' "'), F.coalesce("name", F.lit("")), F.lit('"\t'), F.col("score").cast("string"))
    rows = hits.groupBy("read_id", "label").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "rank", "taxid", line.alias("line")))).alias("h"))
    text = F.concat(F.lit(">"), "label", F.lit("\n"), F.array_join(F.transform("h", lambda x: x["line"]), "\n"))
    return rows.select("read_id", text.alias("value"))


def tabular(hits: DataFrame) -> DataFrame:
    """Columns of the tab-separated report; hits carry strain, genus .. phylum ids, each rank's score, ``level`` (0: strain) and score.

    The first hit of a read is flagged; cells below a hit's own rank are empty.
    """
    first = F.row_number().over(W.partitionBy("read_id").orderBy(F.desc("score"), "level", "strain"))
    cols = [F.when(F.col("level") == 0, F.col("strain")).alias("strain"), F.when(F.col("level") == 0, F.col("score")).alias("strain_score")]
    for i, rank in enumerate(RANKS[1:6], 1):
        cols += [F.when(F.col("level") <= i, F.col(rank)).alias(rank), F.when(F.col("level") <= i, F.col(f"{rank}_score")).alias(f"{rank}_score")]
    return hits.select("label", (first == 1).cast("int").alias("best_hit"), *cols)


def write_tsv(rows: DataFrame, path: str, header: bool = True) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=header)


def consensus_lines(pairs: DataFrame) -> DataFrame:
    """(value) from (label, guess, reference, consensus, rank, name)."""
    none = F.format_string("no consensus for %s and %s", F.col("guess").cast("string"), F.col("reference").cast("string"))
    some = F.concat_ws("\t", "label", *[F.col(c).cast("string") for c in ("consensus", "guess", "reference")], "rank", "name")
    return pairs.select(F.when(F.col("consensus").isNull(), none).otherwise(some).alias("value"))


def filter_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("kept").alias("retained"), F.count_if(~F.col("kept")).alias("removed"))


def exons(genes: DataFrame, order: str, first: int = 1) -> DataFrame:
    """(genome, gene, start, end): places of a genome's genes laid end to end, numbered from ``first``; a genome is spread over ranges of the order."""
    sizes = genes.select("genome", order, F.length("seq").alias("size"))  # sequences stay where they are
    placed = running_sums(sizes, ["genome"], order, {"end": F.col("size").cast("long"), "number": F.lit(1).cast("long")})
    gene = F.concat(F.lit("gene_"), (F.col("number") - 1 + first).cast("string"))
    return placed.select("genome", order, gene.alias("gene"), (F.col("end") - F.col("size") + 1).alias("start"), "end")


def gtf_lines(placed: DataFrame) -> DataFrame:
    attributes = F.concat(F.lit('gene_id "'), "gene", F.lit('"; transcript_id "'), "gene", F.lit('";'))
    parts = [F.lit("condensed"), F.lit("exon"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), F.lit("+"), F.lit(".")]
    return placed.select("genome", F.concat_ws("\t", "genome", *parts, attributes).alias("value"))


def condensed(genes: DataFrame, order: str) -> DataFrame:
    """(genome, seq): all genes of a genome joined in order, in one row: for genomes of up to 2 GB."""
    rows = genes.groupBy("genome").agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("seq")))).alias("g"))
    return rows.select("genome", F.array_join(F.transform("g", lambda x: x["seq"]), "").alias("seq"))


def laid_out(genes: DataFrame, order: str) -> DataFrame:
    """(genome, start, seq): the same as rows, sorted within and over partitions, for genomes of any size."""
    placed = exons(genes, order).select("genome", order, "start")
    return placed.join(genes.select("genome", order, "seq"), ["genome", order]).select("genome", "start", "seq").repartitionByRange("genome", "start").sortWithinPartitions("genome", "start")


def filled_template(template: str, manifest: DataFrame) -> DataFrame:
    """(genome, value): a parameter file for each row (genome, reads) of the manifest."""
    text = F.replace(F.replace(F.lit(template), F.lit("{genome}"), F.col("genome")), F.lit("{reads}"), F.col("reads").cast("string"))
    return manifest.select("genome", text.alias("value"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path))


def parse_manifest(raw: DataFrame) -> DataFrame:
    parts = F.split("value", "\t")
    return raw.where("value <> ''").select(parts[0].alias("genome"), F.get(parts, F.lit(1)).cast("long").alias("reads"))
