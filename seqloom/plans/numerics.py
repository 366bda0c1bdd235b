"""Queries of the numeric operators: neighbours, solvers, ranks, tests, moments, transforms and fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import neighbours, ranks, solvers, splines, statistics, transforms
from ..operators.words import count_words
from .views import GENES, genes, table, words_cte


def whole(vector: str, dims: int | None = None) -> Column:
    """The first components of a vector as whole numbers of 1/256, so that sums are exact."""
    part = F.col(vector) if dims is None else F.slice(vector, 1, dims)
    return F.transform(part, lambda x: F.floor(256 * x.cast("double")).cast("double"))


def points(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), whole("embedding", dims).alias("vector"))


def asked(rows: DataFrame, every: int = 20) -> DataFrame:
    return rows.where(F.col("id") % every == 0).withColumnRenamed("id", "query_id")


def points_cte(dims: str = "") -> str:
    part = f"embedding[1:{dims}]" if dims else "embedding"
    return f"p AS (SELECT vec_id AS id, list_transform({part}, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings)"


def distance_cte(distance: str, where: str = "q.id % 20 = 0") -> str:
    return f"""d AS (SELECT q.id AS query_id, c.id AS id, {distance} AS distance FROM p q, p c WHERE {where}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM d WHERE distance > 0)"""


EUCLID = "sqrt(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i]))))"
CITY = "list_sum(list_transform(generate_series(1, len(q.v)), lambda i: abs(q.v[i] - c.v[i])))"
CHESS = "list_max(list_transform(generate_series(1, len(q.v)), lambda i: abs(q.v[i] - c.v[i])))"


def knn_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's 5 nearest others in its first 3 dimensions, by Euclid's norm."""
    rows = points(spark, sf_dir, 3)
    tree = neighbours.build(rows, box_rows=256)
    return tree.nearest(rows.withColumnRenamed("id", "query_id"), 5, self_match=False).drop("boxes")


def knn_tree_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of every twentieth one over all dimensions, by the sum of gaps."""
    rows = points(spark, sf_dir)
    return neighbours.build(rows, norm=1).nearest(asked(rows), 5, self_match=False).drop("boxes")


def radius_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors within 24/256 of every twentieth one in each of the first 4 dimensions, itself included."""
    rows = points(spark, sf_dir, 4)
    return neighbours.build(rows, norm=0, box_rows=256).within(asked(rows), 24.0)


def knn_tree_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether approximate distances, at each rank, are at most twice the true ones and no shorter."""
    rows = points(spark, sf_dir, 3)
    tree = neighbours.build(rows, box_rows=256)
    true = tree.nearest(asked(rows), 5, self_match=False).select("query_id", "rank", F.col("distance").alias("true_distance"))
    rough = tree.nearest(asked(rows), 5, self_match=False, eps=1.0).select("query_id", "rank", "distance")
    fits = F.col("distance").between(F.col("true_distance"), 2 * F.col("true_distance"))
    return true.join(rough, ["query_id", "rank"], "left").select("query_id", "rank", "true_distance", F.coalesce(fits, F.lit(False)).alias("fits"))


def two_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A system with a row a document: 1 and its counts of two words, against its number of characters."""
    counts = count_words(genes(spark, sf_dir), ["gene_id"], 1).where("word IN ('AC', 'GT')").select(F.col("gene_id").alias("row"), F.col("word").alias("col"), F.col("n").alias("value"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), F.col("n_chars").alias("value"))
    ones = docs.select("row", F.lit("one").alias("col"), F.lit(1).cast("long").alias("value"))
    return ones.unionByName(counts), docs


def lsqr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix, side = two_words(spark, sf_dir)
    return solvers.lsqr(matrix, side).x.select(F.col("col").alias("term"), F.round("x", 4).alias("coefficient"))


def cg_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of regions, nations and customers as a resistor network: potentials back from the currents that they cause."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    up = nation.select((1000 + F.col("n_nationkey")).cast("long").alias("a"), (10 + F.col("n_regionkey")).cast("long").alias("b"))
    up = up.unionByName(customer.select((1000000 + F.col("c_custkey")).alias("a"), (1000 + F.col("c_nationkey")).cast("long").alias("b")))
    links = up.unionByName(up.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = links.groupBy("a").agg(F.count("*").alias("n"))
    matrix = links.select(F.col("a").alias("row"), F.col("b").alias("col"), F.lit(-1.0).alias("value"))
    matrix = matrix.unionByName(degree.select(F.col("a").alias("row"), F.col("a").alias("col"), (1.0 + F.col("n")).alias("value")))
    side = matrix.groupBy("row").agg(F.sum(F.col("value") * (F.col("col") % 10)).alias("value"))
    return solvers.conjugate_gradients(matrix, side).x.select(F.col("col").alias("id"), (F.round("x", 6) + 0.0).alias("x"))


def qr_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of line items by quantity and discount."""
    names = ["one", "l_quantity", "l_discount"]
    columns = [F.lit(1.0), F.col("l_quantity"), F.col("l_discount")]
    fit = solvers.least_squares(table(spark, sf_dir, "lineitem"), columns, F.col("l_extendedprice"))
    rows = [(n, float(x)) for n, x in zip(names, fit.coefficients)]
    return spark.createDataFrame(rows, "term string, coefficient double").withColumn("coefficient", F.round("coefficient", 4))


def global_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ranks.ranks(rows, "l_extendedprice")


def group_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities within their return flag, around the mean rank; there are few quantities, each in very many rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return ranks.ranks(rows, "l_quantity", ["l_returnflag"], centered=True)


def row_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select(F.col("id").alias("vec_id"), F.posexplode(ranks.row_ranks(F.col("vector"))).alias("pos", "rank"))
    return rows


def sample_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("x"))
    found = statistics.moments(rows, "x", ["l_returnflag"])
    return found.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "skewness", "kurtosis", "deviation")])


SHARES = (0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0)


def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.percentiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", SHARES, ["l_returnflag"])
    return found.select("l_returnflag", "share", F.round("x", 6).alias("x"))


def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of documents by source, one of which may hold a third of all."""
    found = statistics.percentiles(table(spark, sf_dir, "documents"), "n_chars", SHARES, ["source"])
    return found.select("source", "share", F.round("x", 6).alias("x"))


def length_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.ranks(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "n_chars", ["source"])


def median_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.median(table(spark, sf_dir, "customer"), "c_acctbal").select(F.round("median", 6).alias("median"))


def covariance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.correlation_matrix(points(spark, sf_dir), "vector")
    return found.select("i", "j", F.round("covariance", 5).alias("covariance"), (F.round("correlation", 7) + 0.0).alias("correlation"))


def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.rank_correlation_matrix(points(spark, sf_dir), "vector")
    return found.select("i", "j", (F.round("correlation", 7) + 0.0).alias("correlation"))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and other orders by priority."""
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderpriority").alias("priority"), (F.col("o_orderstatus") == "O").alias("open"), (F.col("o_totalprice") / 1000).alias("x"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select("priority", *[(F.round(c, 6) + 0.0).alias(c) if c not in ("n", "m", "above") else F.col(c) for c in names])


def rank_sum_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.rank_sum_test(priced(spark, sf_dir), "x", F.col("open"), ["priority"]), "n", "m", "u", "z")


def signed_rank_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.signed_rank_test(priced(spark, sf_dir), "x", 250.0, ["priority"]), "n", "w", "z")


def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.sign_test(priced(spark, sf_dir), "x", 250.0, ["priority"]), "n", "above")


def variance_ratio_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.variance_ratio_test(priced(spark, sf_dir), "x", F.col("open"), ["priority"]), "f", "df1", "df2")


def mean_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.mean_test(priced(spark, sf_dir), "x", F.col("open"), ["priority"]), "t", "df")


def pooled_mean_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.mean_test(priced(spark, sf_dir), "x", F.col("open"), ["priority"], equal_variances=True), "t", "df")


def variance_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.variance_test(priced(spark, sf_dir), "x", 20000.0, ["priority"]), "chi2", "df")


def normality_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.normality_test(priced(spark, sf_dir), "x", ["priority"]), "n", "jb", "p")


PRICED = "x AS (SELECT o_orderpriority AS priority, o_orderstatus = 'O' AS open, o_totalprice / 1000 AS x FROM orders)"
LONG_POINTS = "l AS (SELECT id, CAST(unnest(generate_series(1, len(v))) - 1 AS INTEGER) AS i, unnest(v) AS x FROM p)"
SAMPLES = """s AS (SELECT priority, CAST(count(*) FILTER (WHERE open) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE NOT open) AS DOUBLE) AS m,
  avg(x) FILTER (WHERE open) AS mx, avg(x) FILTER (WHERE NOT open) AS my, var_samp(x) FILTER (WHERE open) AS vx, var_samp(x) FILTER (WHERE NOT open) AS vy
  FROM x GROUP BY priority)"""


KERNEL = (1.0, 4.0, 6.0, 4.0, 1.0)
BASES = "ACGT"
PATTERN = (1.0, -0.5, -0.5) * 4


def convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of customers in order of their keys, smoothed over five."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_acctbal").alias("x"))
    return transforms.convolve(rows, KERNEL, chunk=1 << 12).select("pos", (F.round("x", 4) + 0.0).alias("x"))


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene_id, base, pos, x): 1 where a sequence has a base."""
    rows = genes(spark, sf_dir).select("gene_id", F.posexplode(F.split("seq", "")).alias("pos", "base"))
    return rows.where("base <> ''").withColumn("x", F.lit(1.0))


def period_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The power of each sequence at period 3, over its four bases' indicators."""
    power = transforms.power_at(indicators(spark, sf_dir), 3, ["gene_id", "base"])
    return power.groupBy("gene_id").agg((F.round(F.sum("power"), 4) + 0.0).alias("power"))


def shifted_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a triplet pattern fits the A of each sequence at its best shift."""
    found = transforms.correlate(indicators(spark, sf_dir).where("base = 'A'"), PATTERN, ["gene_id"])
    return found.groupBy("gene_id").agg(F.max(F.round("x", 6)).alias("x"))


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Fourier transform of suppliers' balances in order of their keys."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), (F.col("s_acctbal") / 1000).alias("x"))
    found = transforms.fourier(rows)
    return found.select("pos", (F.round("re", 6) + 0.0).alias("re"), (F.round("im", 6) + 0.0).alias("im"))


def weekly_spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The natural spline through each week's mean order total, in the middle of the weeks before the last."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    rows = table(spark, sf_dir, "orders").select(F.floor(day / 7).alias("x"), (F.col("o_totalprice") / 1000).alias("y"))
    spline = splines.natural_spline(rows, cell_rows=64)
    asked = spline.pieces.select((F.col("x0") + 0.5).alias("x"))
    return spline.at(asked).select("x", F.round("value", 5).alias("value"), (F.round("curvature", 5) + 0.0).alias("curvature"))


def plane_sql(source: str, a: str, b: str, y: str, names: tuple[str, str]) -> str:
    """The normal equations of y on 1, a and b, centred, as three rows."""
    return f"""s AS (SELECT avg({a}) AS ma, avg({b}) AS mb, avg({y}) AS my, var_pop({a}) AS aa, var_pop({b}) AS bb,
  covar_pop({a}, {b}) AS ab, covar_pop({a}, {y}) AS ay, covar_pop({b}, {y}) AS yb FROM {source}),
c AS (SELECT *, (bb * ay - ab * yb) / (aa * bb - ab * ab) AS ca, (aa * yb - ab * ay) / (aa * bb - ab * ab) AS cb FROM s)
SELECT 'one' AS term, round(my - ca * ma - cb * mb, 4) AS coefficient FROM c
UNION ALL SELECT '{names[0]}', round(ca, 4) FROM c UNION ALL SELECT '{names[1]}', round(cb, 4) FROM c"""


QUERIES = {
    "knn_tree": knn_tree,
    "knn_tree_wide": knn_tree_wide,
    "radius_tree": radius_tree,
    "knn_tree_approximate": knn_tree_approximate,
    "lsqr_words": lsqr_words,
    "cg_tree": cg_tree,
    "qr_fit": qr_fit,
    "global_ranks": global_ranks,
    "group_ranks": group_ranks,
    "row_ranks": row_ranks,
    "sample_moments": sample_moments,
    "exact_percentiles": exact_percentiles,
    "median_balance": median_balance,
    "length_percentiles": length_percentiles,
    "length_ranks": length_ranks,
    "covariance_matrix": covariance_matrix,
    "spearman_matrix": spearman_matrix,
    "rank_sum_test": rank_sum_test,
    "signed_rank_test": signed_rank_test,
    "sign_test": sign_test,
    "variance_ratio_test": variance_ratio_test,
    "mean_test": mean_test,
    "pooled_mean_test": pooled_mean_test,
    "variance_test": variance_test,
    "normality_test": normality_test,
    "convolution": convolution,
    "period_three": period_three,
    "shifted_correlation": shifted_correlation,
    "spectrum": spectrum,
    "weekly_spline": weekly_spline,
}
SQL = {
    "knn_tree": f"WITH {points_cte('3')}, {distance_cte(EUCLID, 'true')} SELECT query_id, rank, id, distance FROM r WHERE rank <= 5",
    "knn_tree_wide": f"WITH {points_cte()}, {distance_cte(CITY)} SELECT query_id, rank, id, distance FROM r WHERE rank <= 5",
    "radius_tree": f"WITH {points_cte('4')}, {distance_cte(CHESS)} SELECT query_id, id, distance FROM d WHERE distance <= 24",
    "knn_tree_approximate": f"WITH {points_cte('3')}, {distance_cte(EUCLID)} SELECT query_id, rank, distance AS true_distance, true AS fits FROM r WHERE rank <= 5",
    "lsqr_words": f"""WITH {GENES}, {words_cte("genes", "gene_id", 2, "w")},
x AS (SELECT doc_id, n_chars AS y, coalesce(f.n, 0) AS a, coalesce(g.n, 0) AS b FROM documents
  LEFT JOIN w f ON f.gene_id = doc_id AND f.word = 'AC' LEFT JOIN w g ON g.gene_id = doc_id AND g.word = 'GT'),
{plane_sql("x", "a", "b", "y", ("AC", "GT"))}""",
    "cg_tree": """WITH i AS (SELECT DISTINCT 10 + n_regionkey AS id FROM nation UNION SELECT 1000 + n_nationkey FROM nation
  UNION SELECT 1000 + c_nationkey FROM customer UNION SELECT 1000000 + c_custkey FROM customer)
SELECT CAST(id AS BIGINT) AS id, CAST(id % 10 AS DOUBLE) AS x FROM i""",
    "qr_fit": f"""WITH {plane_sql("lineitem", "l_quantity", "l_discount", "l_extendedprice", ("l_quantity", "l_discount"))}""",
    "global_ranks": """SELECT l_orderkey, l_linenumber, l_extendedprice,
  rank() OVER (ORDER BY l_extendedprice) - 1 + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS rank FROM lineitem""",
    "group_ranks": """SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1
  + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 - (count(*) OVER (PARTITION BY l_returnflag) - 1) / 2 AS rank FROM lineitem""",
    "row_ranks": f"""WITH {points_cte()}, {LONG_POINTS}
SELECT id AS vec_id, i AS pos, rank() OVER (PARTITION BY id ORDER BY x) - 1 + (count(*) OVER (PARTITION BY id, x) - 1) / 2 AS rank FROM l""",
    "sample_moments": """WITH x AS (SELECT l_returnflag, l_extendedprice / 1000 AS x FROM lineitem),
m AS (SELECT l_returnflag, count(*) AS n, avg(x) AS mean, var_samp(x) AS variance FROM x GROUP BY l_returnflag)
SELECT l_returnflag, n, round(mean, 6) AS mean, round(variance, 6) AS variance, round(avg(pow((x - mean) / sqrt(variance), 3)), 6) AS skewness,
  round(avg(pow((x - mean) / sqrt(variance), 4)) - 3, 6) AS kurtosis, round(avg(abs(x - mean)), 6) AS deviation FROM x JOIN m USING (l_returnflag) GROUP BY l_returnflag, n, mean, variance""",
    "exact_percentiles": f"""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, {list(SHARES)}) AS xs FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, CAST(unnest({list(SHARES)}) AS DOUBLE) AS share, round(unnest(xs), 6) AS x FROM q""",
    "length_percentiles": f"""WITH q AS (SELECT source, quantile_cont(n_chars, {list(SHARES)}) AS xs FROM documents WHERE n_chars IS NOT NULL GROUP BY source)
SELECT source, CAST(unnest({list(SHARES)}) AS DOUBLE) AS share, round(unnest(xs), 6) AS x FROM q""",
    "length_ranks": """SELECT doc_id, source, n_chars, CASE WHEN n_chars IS NOT NULL THEN rank() OVER (PARTITION BY source, n_chars IS NULL ORDER BY n_chars) - 1
  + (count(*) OVER (PARTITION BY source, n_chars) - 1) / 2 END AS rank FROM documents""",
    "median_balance": "SELECT round(median(c_acctbal), 6) AS median FROM customer",
    "covariance_matrix": f"""WITH {points_cte()}, {LONG_POINTS}
SELECT a.i AS i, b.i AS j, round(covar_samp(a.x, b.x), 5) AS covariance, round(corr(a.x, b.x), 7) + 0 AS correlation FROM l a JOIN l b USING (id) GROUP BY a.i, b.i""",
    "spearman_matrix": f"""WITH {points_cte()}, {LONG_POINTS},
r AS (SELECT id, i, rank() OVER (PARTITION BY i ORDER BY x) + (count(*) OVER (PARTITION BY i, x) - 1) / 2 AS x FROM l)
SELECT a.i AS i, b.i AS j, round(corr(a.x, b.x), 7) + 0 AS correlation FROM r a JOIN r b USING (id) GROUP BY a.i, b.i""",
    "rank_sum_test": f"""WITH {PRICED}, r AS (SELECT priority, open, rank() OVER (PARTITION BY priority ORDER BY x) + (count(*) OVER (PARTITION BY priority, x) - 1) / 2 AS r,
  count(*) OVER (PARTITION BY priority, x) AS t FROM x),
s AS (SELECT priority, count(*) FILTER (WHERE open) AS n, count(*) FILTER (WHERE NOT open) AS m, coalesce(sum(r) FILTER (WHERE open), 0) AS r, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY priority),
u AS (SELECT *, r - n * (n + 1) / 2 AS u, CAST(n AS DOUBLE) * m / 12 * (n + m + 1 - ties / (CAST(n + m AS DOUBLE) * (n + m - 1))) AS v FROM s)
SELECT priority, n, m, round(u, 6) AS u, round((u - CAST(n AS DOUBLE) * m / 2) / sqrt(v), 6) AS z FROM u""",
    "signed_rank_test": f"""WITH {PRICED}, d AS (SELECT priority, abs(x - 250) AS d, x > 250 AS up FROM x WHERE x <> 250),
r AS (SELECT priority, up, rank() OVER (PARTITION BY priority ORDER BY d) + (count(*) OVER (PARTITION BY priority, d) - 1) / 2 AS r, count(*) OVER (PARTITION BY priority, d) AS t FROM d),
s AS (SELECT priority, count(*) AS n, coalesce(sum(r) FILTER (WHERE up), 0) AS w, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY priority)
SELECT priority, n, round(w, 6) AS w, round((w - CAST(n AS DOUBLE) * (n + 1) / 4) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM s""",
    "sign_test": f"WITH {PRICED} SELECT priority, count(*) AS n, count(*) FILTER (WHERE x > 250) AS above FROM x WHERE x <> 250 GROUP BY priority",
    "variance_ratio_test": f"WITH {PRICED}, {SAMPLES} SELECT priority, round(vx / vy, 6) AS f, n - 1 AS df1, m - 1 AS df2 FROM s",
    "mean_test": f"""WITH {PRICED}, {SAMPLES} SELECT priority, round((mx - my) / sqrt(vx / n + vy / m), 6) AS t,
  round(pow(vx / n + vy / m, 2) / (vx * vx / (n * n * (n - 1)) + vy * vy / (m * m * (m - 1))), 6) AS df FROM s""",
    "pooled_mean_test": f"""WITH {PRICED}, {SAMPLES} SELECT priority, round((mx - my) / sqrt(((n - 1) * vx + (m - 1) * vy) / (n + m - 2) * (1 / n + 1 / m)), 6) AS t, n + m - 2 AS df FROM s""",
    "variance_test": f"WITH {PRICED} SELECT priority, round((count(*) - 1) * var_samp(x) / 20000, 6) AS chi2, CAST(count(*) - 1 AS DOUBLE) AS df FROM x GROUP BY priority",
    "normality_test": f"""WITH {PRICED}, m AS (SELECT priority, count(*) AS n, avg(x) AS mean, sqrt(var_pop(x)) AS sd FROM x GROUP BY priority),
j AS (SELECT priority, n, n / 6 * (pow(avg(pow((x - mean) / sd, 3)), 2) + pow(avg(pow((x - mean) / sd, 4)) - 3, 2) / 4) AS jb FROM x JOIN m USING (priority) GROUP BY priority, n)
SELECT priority, n, round(jb, 6) AS jb, round(exp(-jb / 2), 6) AS p FROM j""",
    "convolution": f"""WITH k AS (SELECT CAST(unnest(generate_series(0, 4)) AS BIGINT) AS j, CAST(unnest({list(KERNEL)}) AS DOUBLE) AS w)
SELECT c_custkey + j AS pos, round(sum(w * c_acctbal), 4) + 0 AS x FROM customer, k GROUP BY c_custkey + j""",
    "period_three": f"""WITH {GENES}, b AS (SELECT gene_id, i - 1 AS pos, substr(seq, i, 1) AS base FROM (SELECT gene_id, seq, unnest(generate_series(1, length(seq))) AS i FROM genes)),
p AS (SELECT gene_id, base, sum(cos(2 * pi() * (pos % 3) / 3)) AS re, sum(sin(2 * pi() * (pos % 3) / 3)) AS im FROM b GROUP BY gene_id, base)
SELECT gene_id, round(sum(re * re + im * im), 4) + 0 AS power FROM p GROUP BY gene_id""",
    "shifted_correlation": f"""WITH {GENES}, k AS (SELECT unnest(generate_series(0, {len(PATTERN) - 1})) AS j, CAST(unnest({list(PATTERN)}) AS DOUBLE) AS w),
b AS (SELECT gene_id, i - 1 AS pos FROM (SELECT gene_id, seq, unnest(generate_series(1, length(seq))) AS i FROM genes) WHERE substr(seq, i, 1) = 'A'),
c AS (SELECT gene_id, pos - j AS pos, sum(w) AS x FROM b, k GROUP BY gene_id, pos - j)
SELECT gene_id, max(round(x, 6)) AS x FROM c GROUP BY gene_id""",
    "spectrum": """WITH n AS (SELECT max(s_suppkey) + 1 AS n FROM supplier), k AS (SELECT unnest(generate_series(0, (SELECT n - 1 FROM n))) AS k)
SELECT CAST(k AS BIGINT) AS pos, round(sum(s_acctbal / 1000 * cos(2 * pi() * (s_suppkey * k % n) / n)), 6) + 0 AS re,
  round(-sum(s_acctbal / 1000 * sin(2 * pi() * (s_suppkey * k % n) / n)), 6) + 0 AS im FROM supplier, k, n GROUP BY k""",
    "weekly_spline": """WITH RECURSIVE p AS (SELECT floor(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) / 7) AS x, avg(o_totalprice / 1000) AS y FROM orders GROUP BY 1),
k AS (SELECT row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n, x, y, lag(x) OVER (ORDER BY x) AS x0, lag(y) OVER (ORDER BY x) AS y0,
  lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM p),
e AS (SELECT i, n, x - x0 AS h, x2 - x AS g, 6 * ((y2 - y) / (x2 - x) - (y - y0) / (x - x0)) AS r FROM k),
f AS (SELECT CAST(1 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS d
  UNION ALL SELECT e.i, e.g / (2 * (e.h + e.g) - e.h * f.c), (e.r - e.h * f.d) / (2 * (e.h + e.g) - e.h * f.c) FROM f JOIN e ON e.i = f.i + 1 WHERE e.i < e.n),
m AS (SELECT n AS i, CAST(0 AS DOUBLE) AS m FROM k WHERE i = n
  UNION ALL SELECT f.i, f.d - f.c * m.m FROM m JOIN f ON f.i = m.i - 1)
SELECT k.x + 0.5 AS x, round(k.y + 0.5 * ((x2 - x) * -(2 * a.m + b.m) / 6 + (y2 - y) / (x2 - x)) + a.m / 8 + (b.m - a.m) / (6 * (x2 - x)) / 8, 5) AS value,
  round(a.m + (b.m - a.m) / (x2 - x) / 2, 5) + 0 AS curvature FROM k JOIN m a ON a.i = k.i JOIN m b ON b.i = k.i + 1""",
}
