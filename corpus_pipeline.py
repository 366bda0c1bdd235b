"""A corpus pipeline: toxic documents out, one of each near-duplicate group, no benchmark
passages, no personal data, and a mix of sources by weight.

Each stage takes (spark, docs, sf_dir); docs are rows like those of ``documents``,
and all stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import quoted, read, stored
from seqloom.llm.decontaminate import decontaminate
from seqloom.llm.mixing import mix
from seqloom.llm.pii import find_personal_data
from seqloom.llm.simhash import deduplicate
from seqloom.llm.toxicity import score_toxicity


def packed(docs: DataFrame) -> DataFrame:
    """Whole rows beside the columns that a stage looks at, so that no other column can clash with a stage's own."""
    return docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("document"), "doc_id", "text")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar, learned from the labels, scores under 0.7."""
    scored = score_toxicity(packed(docs), read(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select("document.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than 5% lie in windows of the benchmark, or none."""
    judged = decontaminate(packed(docs), read(spark, sf_dir, "benchmark"))
    return judged.where("not contaminated").select("document.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a tag in place of each span of personal data."""
    found = find_personal_data(packed(docs), redacted=True)
    changed = ~F.col("redacted_text").eqNullSafe(F.col("text"))
    new = {"text": F.col("redacted_text"), "n_chars": F.when(changed, F.length("redacted_text")).otherwise(F.col("document.n_chars"))}
    kept = lambda c: new[c].cast(docs.schema[c].dataType) if c in new else F.col("document")[c]
    return found.select(*[kept(c).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix by weights 1, 2, 3 takes words, and how many."""
    return mix(docs).where("taken > 0")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

#: The toxicity grammar and the SimHash fingerprints can't be stated in SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; what a stage keeps is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
