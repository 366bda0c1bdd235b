"""Filters by rules, label sets, and the resolution of reads to taxa."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One rule: keep or drop rows whose label or sequence holds a fragment, or whose taxon lies in a subtree."""

    kind: str
    retain: bool
    value: str


def parsed(words: list[str]) -> list[Rule]:
    """Rules from words such as ``label -plasmid taxon +561 seq +acgt``."""
    out, kind = [], ""
    for word in words:
        if word in ("label", "seq", "taxon"):
            kind = word
        elif kind and word[:1] in "+-" and len(word) > 1:
            out.append(Rule(kind, word[0] == "+", word[1:]))
        else:
            raise ValueError(f"no rule: {word}")
    return out


def matches(rule: Rule, ancestors: Column | None = None) -> Column:
    if rule.kind == "taxon":
        return F.array_contains(ancestors, F.lit(int(rule.value)))
    return F.contains(F.lower(F.col("label" if rule.kind == "label" else "seq")), F.lit(rule.value.lower()))


def kept(rules: list[Rule], ancestors: Column | None = None) -> Column:
    """Whether a row is kept: the last rule that matches decides; without a match, the opposite of the first rule."""
    if not rules:
        return F.lit(True)
    out = F.lit(not rules[0].retain)
    for rule in rules:
        out = F.when(F.coalesce(matches(rule, ancestors), F.lit(False)), F.lit(rule.retain)).otherwise(out)
    return out


def filtered(rows: DataFrame, rules: list[Rule], closure: DataFrame | None = None, taxon: str = "taxid") -> DataFrame:
    """Rows with a flag ``kept``; rules on taxa look at the ancestors of the column ``taxon``."""
    if not any(r.kind == "taxon" for r in rules):
        return rows.withColumn("kept", kept(rules))
    wanted = [int(r.value) for r in rules if r.kind == "taxon"]
    up = closure.where(F.col("ancestor").isin(wanted)).groupBy(F.col("id").alias(taxon)).agg(F.collect_set("ancestor").alias("up_"))
    return rows.join(up, taxon, "left").withColumn("kept", kept(rules, F.col("up_"))).drop("up_")


def presence(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, files): in how many of both tables a label stands."""
    both = a.select(key).distinct().unionAll(b.select(key).distinct())
    return both.groupBy(key).agg(F.count("*").alias("files"))


def common_labels(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def resolved_taxa(reads: DataFrame, by_gi: DataFrame, by_class: DataFrame) -> DataFrame:
    """Reads (label, gi, class_key) with a taxid: by their GI number, else by their class, else -1."""
    out = reads.join(by_gi.select("gi", F.col("taxid").alias("a")), "gi", "left").join(by_class.select("class_key", F.col("taxid").alias("b")), "class_key", "left")
    return out.withColumn("taxid", F.coalesce("a", "b", F.lit(-1))).drop("a", "b")


def matched_by_place(rows: DataFrame, targets: DataFrame, key: str, order: list[str], target_order: str, among: list[str] | None = None) -> DataFrame:
    """The nth row of a key goes to the nth target of that key: one-to-one where keys repeat."""
    from pyspark.sql import Window as W

    nth = lambda *cols, by: F.row_number().over(W.partitionBy(*cols).orderBy(*by))
    a = rows.withColumn("nth_", nth(key, *(among or []), by=order))
    b = targets.withColumn("nth_", nth(key, by=[target_order]))
    return a.join(b, [key, "nth_"]).drop("nth_")
