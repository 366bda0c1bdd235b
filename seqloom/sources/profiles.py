"""Saved class models: Parquet tables, and the text form with one field a line."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineages import lines


@dataclass(frozen=True)
class Config:
    """Settings of a run: word lengths, weights by method, and shortlist limits for both passes."""

    prefixes: dict[str, int] = field(default_factory=lambda: {"nt.bayes": 5, "nt.1nn": 3, "nt.codelta": 3, "nt.gmm": 3, "nt.sparse": 14, "aa.bayes": 1, "aa.1nn": 1, "aa.codelta": 1, "aa.gmm": 1, "aa.sparse": 5})
    weights: dict[str, float] = field(default_factory=dict)
    passes: tuple[dict[str, float], dict[str, float]] = field(default_factory=lambda: ({}, {}))
    thresholds: tuple[float, float] = (0.7, 0.7)
    quotas: tuple[int, int] = (10, 1)
    blooms: tuple[float, float] = (0.7, 0.995)


def parse_config(text: str) -> tuple[dict[str, str], list[str]]:
    """Settings by key (``key value`` lines, ``#`` starts a comment line), and lines that are no setting."""
    out, odd = {}, []
    for line in text.splitlines():
        parts = line.split(None, 1)
        if not parts or parts[0].startswith("#"):
            continue
        if len(parts) == 2 and "." in parts[0]:
            out[parts[0]] = parts[1].strip()
        else:
            odd.append(line)
    return out, odd


def configured(settings: dict[str, str]) -> tuple[Config, list[str]]:
    """A Config from keys such as ``prefix.nt.bayes``, ``weight.nt.bayes``, ``pass1.nt.bayes``, ``pass1.threshold``; and unknown keys."""
    base = Config()
    prefixes, weights, passes = dict(base.prefixes), dict(base.weights), ({}, {})
    limits = {"threshold": list(base.thresholds), "quota": list(base.quotas), "bloom": list(base.blooms)}
    unknown = []
    for key, value in settings.items():
        head, _, rest = key.partition(".")
        if head == "prefix" and rest in prefixes:
            prefixes[rest] = int(value)
        elif head == "weight":
            weights[rest] = float(value)
        elif head in ("pass1", "pass2"):
            i = int(head[-1]) - 1
            if rest in limits:
                limits[rest][i] = int(value) if rest == "quota" else float(value)
            else:
                passes[i][rest] = float(value)
        else:
            unknown.append(key)
    for table in (weights, *passes):  # reverse complements weigh what their partners do
        table.update({k.replace("nt.", "nt_rc.", 1): v for k, v in list(table.items()) if k.startswith("nt.")})
    return Config(prefixes, weights, passes, tuple(limits["threshold"]), tuple(limits["quota"]), tuple(limits["bloom"])), unknown


def write_model(model: DataFrame, path: str) -> None:
    """A model table, a folder for each class: a reader of some classes opens only theirs."""
    model.write.mode("overwrite").partitionBy("class_id").parquet(path)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def encoded(values: DataFrame, keys: list[str], name: str, place: str = "word", value: str = "x") -> DataFrame:
    """(keys, line): ``name: length v0 v1 ...``, cells in order of their place."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(place), F.col(value))))
    rows = values.groupBy(*keys).agg(cells.alias("c"))
    text = F.concat_ws(" ", F.size("c").cast("string"), F.transform("c", lambda x: x[value].cast("string")))
    return rows.select(*keys, F.concat(F.lit(f"{name}: "), text).alias("line"))


def decoded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, place, x) of such lines; ``null`` has no cells; a wrong number of cells is an error."""
    name, body = F.split_part("line", F.lit(":"), F.lit(1)), F.trim(F.regexp_replace("line", r"^[^:]*:", ""))
    parts = F.split("body", r"\s+")
    rows = rows.select(*keys, name.alias("name"), body.alias("body")).where("body <> 'null'")
    checked = F.when(F.size(parts) - 1 == parts[0].cast("int"), F.slice(parts, 2, F.size(parts) - 1)).otherwise(F.raise_error(F.concat(F.lit("wrong number of cells: "), "name")))
    return rows.select(*keys, "name", F.posexplode(checked).alias("place", "x")).withColumn("x", F.col("x").cast("double"))


def read_profiles(spark: SparkSession, path: str | list[str], prefixes: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Scalar fields (path, field, value) and tables (path, name, place, x) of text profiles.

    A stored word length that differs from the session's is an error; 0 in the
    session takes any.
    """
    return parse_profiles(lines(spark, path), prefixes)


def parse_profiles(rows: DataFrame, prefixes: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``read_profiles``, from lines (path, value)."""
    rows = rows.select("path", "value").where(F.col("value").contains(":"))
    key = F.split_part("value", F.lit(":"), F.lit(1))
    body = F.trim(F.regexp_replace("value", r"^[^:]*:", ""))
    table = F.size(F.split(body, r"\s+")) > 1
    fields = rows.where(~table).select("path", key.alias("field"), body.alias("value"))
    for name, length in (prefixes or {}).items():
        wrong = (F.col("field") == f"{name}-prefix-length") & (F.col("value").cast("int") != length) & F.lit(length != 0)
        fields = fields.withColumn("value", F.when(wrong, F.raise_error(F.lit(f"Wrong {name} prefix length"))).otherwise(F.col("value")))
    return fields, decoded(rows.where(table).withColumnRenamed("value", "line"), ["path"])
