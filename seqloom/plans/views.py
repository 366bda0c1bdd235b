"""The sample tables as reads, genes, vectors, lineages and trees, in Spark and in SQL.

Each SQL constant is a list of common table expressions for use after WITH.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement, translated
from ..operators import models, tables
from ..operators.loops import cut
from ..operators.words import exploded_vectors

BASES = "[^ACGTacgt]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bases(text: str):
    return F.upper(F.regexp_replace(text, BASES, ""))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("read_id"), bases("text").alias("seq"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    class_id = F.substring("source", 4, 10).cast("int")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("gene_id"), class_id.alias("class_id"), bases("text").alias("seq"))


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).withColumn("seq", translated(F.col("seq")))


def reverse_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).withColumn("seq", reverse_complement(F.col("seq")))


READS = f"reads AS (SELECT item_id AS read_id, upper(regexp_replace(text, '{BASES}', '', 'g')) AS seq FROM benchmark)"
GENES = f"""genes AS (SELECT doc_id AS gene_id, CAST(substr(source, 4) AS INTEGER) AS class_id,
    upper(regexp_replace(text, '{BASES}', '', 'g')) AS seq FROM documents)"""


def words_cte(source: str, key: str, letters: int, name: str, more: str = "") -> str:
    return f"""{name} AS (SELECT {key}{more}, word, count(*) AS n FROM (
    SELECT {key}{more}, substr(seq, CAST(i AS BIGINT), {letters}) AS word FROM (
      SELECT {key}{more}, seq, unnest(generate_series(1, length(seq) - {letters - 1})) AS i FROM {source} WHERE length(seq) >= {letters}))
    GROUP BY ALL)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, label, word, x) of the embeddings."""
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "read_id")
    return exploded_vectors(rows, ["read_id", "label"], "embedding")


VECTORS = """vec AS (SELECT vec_id AS read_id, label, unnest(generate_series(0, len(embedding) - 1)) AS word,
    CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""
BAYES_MODEL = """size AS (SELECT label AS class_id, count(*) AS genes FROM embeddings GROUP BY 1),
nb AS (SELECT class_id, word, sum(x) / max(genes) AS mean, sum(x * x) / max(genes) - pow(sum(x) / max(genes), 2) AS variance
    FROM vec JOIN size ON label = class_id GROUP BY 1, 2)"""
DENSITY = "-0.5 * ln(2 * pi() * v) - pow(x - mean, 2) / (2 * v)"
BAYES_SCORES = f"""bayes AS (SELECT read_id, class_id, sum({DENSITY}) AS score FROM (
    SELECT read_id, class_id, x, mean, CASE WHEN variance <= 0 THEN 1e-8 ELSE variance END AS v FROM vec JOIN nb USING (word))
    GROUP BY 1, 2)"""
D2_SCORES = "d2 AS (SELECT read_id, class_id, sum(x * mean) AS score FROM vec JOIN nb USING (word) GROUP BY 1, 2)"
PRIOR = """prior AS (SELECT class_id, ln(CAST(genes AS DOUBLE) / sum(genes) OVER () * (count(*) OVER () + 1)) AS score FROM size)"""
SCORES = f"""{VECTORS}, {BAYES_MODEL}, {BAYES_SCORES}, {D2_SCORES}, {PRIOR},
scores AS (SELECT 'bayes' AS method, read_id, class_id, round(score, 6) AS score FROM bayes
    UNION ALL SELECT 'd2', read_id, class_id, round(score, 6) FROM d2
    UNION ALL SELECT 'prior', e.vec_id, class_id, round(score, 6) FROM embeddings e CROSS JOIN prior)"""
WEIGHTS = {"bayes": 1.0, "d2": 20.0, "prior": 2.0}
VOTES = f"""{SCORES}, votes AS (SELECT read_id, class_id,
    round(sum(score * CASE method WHEN 'bayes' THEN 1.0 WHEN 'd2' THEN 20.0 ELSE 2.0 END), 6) AS vote FROM scores GROUP BY 1, 2)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, cells) of the embeddings, as arrays."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("read_id"), F.transform("embedding", lambda v: v.cast("double")).alias("cells"))


def vector_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    members = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gene_id"), F.col("label").alias("class_id"))
    return models.bayes_model(members, rows.withColumnRenamed("read_id", "gene_id").drop("label"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(class_id, count) of the labels of the embeddings."""
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("class_id")).agg(F.count("*").alias("count"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three methods over the embeddings: naive Bayes, similarity to the class mean, and a prior by class size."""
    model = vector_model(spark, sf_dir)
    each = lambda df, method: df.select(F.lit(method).alias("method"), "read_id", "class_id", F.round("score", 6).alias("score"))
    model = cut(model)
    d2 = tables.dense_similarity(cells(spark, sf_dir), "read_id", model.select("class_id", "word", F.col("mean").alias("x")), "class_id")
    sizes = classes(spark, sf_dir)
    prior = models.count_prior(sizes, sizes)
    every = models.grid(cells(spark, sf_dir), sizes).join(prior, "class_id")
    return each(models.bayes_scores_cells(cells(spark, sf_dir), model), "bayes").unionByName(each(d2, "d2")).unionByName(each(every, "prior"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.votes import weighted_votes

    weights = spark.createDataFrame(list(WEIGHTS.items()), "method string, weight double")
    return weighted_votes(scores(spark, sf_dir), weights).withColumn("vote", F.round("vote", 6))


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested taxonomy by arithmetic on class ids."""
    c = F.col("class_id")
    up = {"species": 10000 + c, **{r: F.lit(b) + F.floor(c / d).cast("int") for r, b, d in (("genus", 20000, 2), ("family", 30000, 4), ("order", 40000, 8), ("class", 50000, 16))}}
    up |= {"phylum": F.lit(60000), "superkingdom": F.lit(70000)}
    return classes(spark, sf_dir).select("class_id", *[x.cast("int").alias(r) for r, x in up.items()])


LINEAGE = """lineage AS (SELECT class_id, 10000 + class_id AS species, 20000 + class_id // 2 AS genus, 30000 + class_id // 4 AS family,
    40000 + class_id // 8 AS ord, 50000 + class_id // 16 AS cls, 60000 AS phylum, 70000 AS superkingdom
    FROM (SELECT DISTINCT label AS class_id FROM embeddings))"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under nations under regions under one root (id 1)."""
    nations, regions, customers = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    node = lambda i, p, rank, name: [i.cast("long").alias("id"), p.cast("long").alias("parent_id"), F.lit(rank).alias("rank"), F.col(name).alias("name")]
    out = spark.createDataFrame([(1, None, "root", "root")], "id long, parent_id long, rank string, name string")
    out = out.unionByName(regions.select(*node(10 + F.col("r_regionkey"), F.lit(1), "region", "r_name")))
    out = out.unionByName(nations.select(*node(1000 + F.col("n_nationkey"), 10 + F.col("n_regionkey"), "nation", "n_name")))
    return out.unionByName(customers.select(*node(1000000 + F.col("c_custkey"), 1000 + F.col("c_nationkey"), "customer", "c_name")))


TREE = """tree AS (SELECT CAST(1 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, 'root' AS rank, 'root' AS name
    UNION ALL SELECT 10 + r_regionkey, 1, 'region', r_name FROM region
    UNION ALL SELECT 1000 + n_nationkey, 10 + n_regionkey, 'nation', n_name FROM nation
    UNION ALL SELECT 1000000 + c_custkey, 1000 + c_nationkey, 'customer', c_name FROM customer)"""
CLOSURE = f"""{TREE}, up AS (SELECT id, id AS ancestor, 0 AS distance FROM tree
    UNION ALL SELECT up.id, tree.parent_id, distance + 1 FROM up JOIN tree ON up.ancestor = tree.id WHERE tree.parent_id IS NOT NULL)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(guess, reference): each order's customer, and the nation of its supplier-like number."""
    orders = table(spark, sf_dir, "orders")
    guess = F.when(F.col("o_orderkey") % 3 == 0, 1000 + F.col("o_orderkey") % 25).otherwise(1000000 + (F.col("o_orderkey") * 7) % 97)
    return orders.select(guess.cast("long").alias("guess"), (1000000 + F.col("o_custkey")).cast("long").alias("reference")).distinct()


PAIRS = """pairs AS (SELECT DISTINCT CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1000 + o_orderkey % 25 ELSE 1000000 + (o_orderkey * 7) % 97 END AS BIGINT) AS guess,
    1000000 + o_custkey AS reference FROM orders)"""
