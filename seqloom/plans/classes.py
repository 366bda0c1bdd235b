"""Queries on class models, their scores, votes and shortlists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import mixture, models, votes, words
from ..operators.loops import cut
from . import views as V

BASES_4 = S.NUCLEOTIDES


def rounded(df, digits=6, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def nb_model(spark, d):
    return rounded(V.vector_model(spark, d), 9, "mean", "variance").withColumn("word", F.col("word").cast("int"))


def nb_score(spark, d):
    return rounded(models.bayes_scores_cells(V.cells(spark, d), V.vector_model(spark, d)), 6, "score")


def nb_classify(spark, d):
    """The class of highest naive Bayes score for each vector."""
    return votes.top_class(nb_score(spark, d), "score")


def gene_model(spark, d, once=False):
    """Word model of the genes of each class, two letters a word; ``once`` counts the words for all that reads them."""
    rows = V.genes(spark, d)
    freq = words.word_frequencies(rows, ["gene_id"], 1)
    freq = cut(freq) if once else freq
    return rows.select("gene_id", "class_id"), freq, models.bayes_model(rows.select("gene_id", "class_id"), freq)


def nb_gene_score(spark, d):
    """Reads against word models of classes, over the domain of 16 words, absent words included."""
    _, _, model = gene_model(spark, d)
    rows = V.reads(spark, d)
    freq = words.word_frequencies(rows, ["read_id"], 1)
    return rounded(models.bayes_scores(freq, model, rows, 16), 4, "score")


def nn_min_d2(spark, d):
    """Least similarity of a read's 3-letter words to those of a class's genes."""
    rows, members = V.reads(spark, d), V.genes(spark, d)
    mine = models.full_vectors(rows, "read_id", words.word_frequencies(rows, ["read_id"], 2), BASES_4, 2)
    theirs = models.full_vectors(members, "gene_id", words.word_frequencies(members, ["gene_id"], 2), BASES_4, 2)
    found = models.nearest_gene_dense(mine, theirs.join(members.select("gene_id", "class_id"), "gene_id"))
    return rounded(found, 9, "score")


def codelta_model(spark, d):
    members, freq, _ = gene_model(spark, d)
    cells = models.full_vectors(members, "gene_id", freq, BASES_4, 1)
    return rounded(models.difference_model(members, cells), 12, "value")


def codelta_score(spark, d):
    members, freq, _ = gene_model(spark, d)
    model = models.difference_model(members, models.full_vectors(members, "gene_id", freq, BASES_4, 1))
    rows = V.reads(spark, d)
    mine = models.full_vectors(rows, "read_id", words.word_frequencies(rows, ["read_id"], 1), BASES_4, 1)
    return rounded(models.difference_scores(mine, model), 9, "score")


def sparse_shared_score(spark, d):
    """Distinct shared words of 8 letters between reads and classes."""
    r_words, r_len = words.sparse_table(V.reads(spark, d), ["read_id"], 7)
    c_words, c_len = words.sparse_table(V.genes(spark, d), ["class_id"], 7)
    return rounded(models.sparse_scores(r_words, r_len, c_words, c_len), 6, "score")


def members(spark, d):
    return V.table(spark, d, "embeddings").select(F.col("vec_id").alias("gene_id"), F.col("label").alias("class_id"))


def gmm_2iter(spark, d, rounds=2):
    genes = members(spark, d)
    rows = V.vectors(spark, d).select(F.col("read_id").alias("gene_id"), "word", "x")
    return mixture.fit(genes, rows, 2, rounds, fixed=True), rows.withColumnRenamed("gene_id", "read_id")


def gmm_em_2iter(spark, d):
    model, _ = gmm_2iter(spark, d)
    return rounded(model.withColumn("word", F.col("word").cast("int")), 6, "mean", "variance", "weight")


def gmm_posterior(spark, d):
    model, rows = gmm_2iter(spark, d)
    return rounded(mixture.class_posteriors(mixture.cluster_scores(rows, model)), 6, "score")


def gmm_restarts(spark, d):
    """Whether mixtures from 8 seeded starts are sound: two clusters a class at most, weights that sum to 1, and means around the class's own."""
    genes = members(spark, d)
    rows = V.vectors(spark, d).select(F.col("read_id").alias("gene_id"), "word", "x")
    model = mixture.fit(genes, rows, 2, rounds=10, restarts=8)
    cells = model.groupBy("class_id", "word").agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("mean")).alias("mean"))
    cells = cells.select("class_id", F.col("word").cast("int").alias("word"), F.round("weight", 6).alias("weight"), (F.round("mean", 6) + 0.0).alias("mean"))
    return cells


def class_prior_16s(spark, d):
    rows = V.table(spark, d, "documents").groupBy(F.substring("source", 4, 10).cast("int").alias("class_id")).agg(F.count("*").alias("count"))
    return rounded(models.count_prior(rows, rows.where("class_id % 5 <> 0")), 9, "score")


def class_prior_ap(spark, d):
    rows = V.table(spark, d, "documents").groupBy(F.substring("source", 4, 10).cast("int").alias("class_id")).agg(F.avg("n_chars").alias("weight"))
    return rounded(models.weight_prior(rows, rows.where("class_id % 5 <> 0")), 6, "score")


def orientation_pick(spark, d):
    """Reads whose reverse complement has more shared words with the classes."""
    c_words, c_len = words.sparse_table(V.genes(spark, d), ["class_id"], 7)
    sides = []
    for reverse, rows in ((False, V.reads(spark, d)), (True, V.reverse_reads(spark, d))):
        r_words, r_len = words.sparse_table(rows, ["read_id"], 7)
        found = models.sparse_scores(r_words, r_len, c_words, c_len)
        sides.append(found.select(F.lit("nt.sparse").alias("forward_method"), F.lit(reverse).alias("reverse"), "read_id", "class_id", F.round("score", 6).alias("score")))
    weights = spark.createDataFrame([("nt.sparse", 1.0)], "method string, weight double")
    return rounded(votes.orientation(sides[0].unionByName(sides[1]), weights), 6, "forward", "backward")


def weighted_vote(spark, d):
    return V.votes(spark, d)


def softmax_vote(spark, d):
    return rounded(votes.posteriors(V.votes(spark, d), "vote").drop("vote"), 6, "posterior")


def top_class(spark, d):
    return votes.top_class(V.votes(spark, d))


def shortlist_threshold(spark, d):
    return votes.shortlist(V.votes(spark, d), 0.7, 1)


def shortlist_quota(spark, d):
    """Votes less 35, so that many are negative: the quota pads."""
    rows = V.votes(spark, d).withColumn("vote", F.round(F.col("vote") - 35, 6))
    return votes.shortlist(rows, 0.7, votes.clamped_quota(4, 10, final=False))


def shortlist_hist(spark, d):
    return votes.shortlist_counts(V.classes(spark, d), votes.shortlist(V.votes(spark, d), 0.98, 2))


QUERIES = {f.__name__: f for f in (nb_model, nb_score, nb_classify, nb_gene_score, nn_min_d2, codelta_model, codelta_score, sparse_shared_score, gmm_em_2iter, gmm_posterior, gmm_restarts, class_prior_16s, class_prior_ap, orientation_pick, weighted_vote, softmax_vote, top_class, shortlist_threshold, shortlist_quota, shortlist_hist)}

DOMAIN = "dom AS (SELECT a.l || b.l AS word, (a.i * 4 + b.i) AS cell FROM (VALUES ('T', 0), ('C', 1), ('A', 2), ('G', 3)) a(l, i) CROSS JOIN (VALUES ('T', 0), ('C', 1), ('A', 2), ('G', 3)) b(l, i))"
GENE_MODEL = f"""{V.READS}, {V.GENES}, {DOMAIN},
{V.words_cte('genes', 'gene_id', 2, 'gw')}, {V.words_cte('reads', 'read_id', 2, 'rw')},
gf AS (SELECT g.gene_id, g.class_id, cell, word, coalesce(n / (length(seq) - 1), 0.0) AS x
    FROM genes g CROSS JOIN dom LEFT JOIN gw USING (gene_id, word)),
rf AS (SELECT r.read_id, cell, word, coalesce(n / (length(seq) - 1), 0.0) AS x
    FROM reads r CROSS JOIN dom LEFT JOIN rw USING (read_id, word)),
gm AS (SELECT class_id, cell, word, sum(x) / count(*) AS mean, sum(x * x) / count(*) - pow(sum(x) / count(*), 2) AS variance FROM gf GROUP BY 1, 2, 3)"""
PAIRS_OF = "SELECT {key}, a.cell AS x, b.cell AS y, pow(b.x - a.x, 2) * sign(b.x - a.x) AS d FROM {t} a JOIN {t} b USING ({key}) WHERE a.cell < b.cell"
CODELTA = f"""{GENE_MODEL}, gd AS ({PAIRS_OF.format(key='gene_id', t='gf')}),
cd AS (SELECT class_id, x, y, avg(d) AS value FROM gd JOIN genes USING (gene_id) GROUP BY 1, 2, 3)"""
SHARED = f"""{V.READS}, rc AS (SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM reads), {V.GENES},
{V.words_cte('reads', 'read_id', 8, 'fw')}, {V.words_cte('rc', 'read_id', 8, 'bw')}, {V.words_cte('genes', 'class_id', 8, 'cw')},
cl AS (SELECT class_id, sum(greatest(length(seq) - 7, 0)) AS class_length FROM genes GROUP BY 1),
rl AS (SELECT read_id, greatest(length(seq) - 7, 0) AS read_length FROM reads),
fs AS (SELECT read_id, class_id, count(*) AS shared FROM fw JOIN cw USING (word) GROUP BY 1, 2),
bs AS (SELECT read_id, class_id, count(*) AS shared FROM bw JOIN cw USING (word) GROUP BY 1, 2)"""
RAW = "CAST(1 + (gene_id * 7 + cluster * 13) % 10 AS DOUBLE)"


def em(rounds: int) -> str:
    out = f"""{V.VECTORS}, g AS (SELECT vec_id AS gene_id, label AS class_id FROM embeddings),
r0 AS (SELECT gene_id, class_id, cluster, {RAW} / sum({RAW}) OVER (PARTITION BY gene_id) AS r FROM g CROSS JOIN (VALUES (1), (2)) k(cluster))"""
    for i in range(1, rounds + 1):
        out += f""",
s{i} AS (SELECT class_id, cluster, word, sum(r) AS s, sum(r * x) AS a, sum(r * x * x) AS b FROM r{i - 1} JOIN vec ON gene_id = read_id GROUP BY 1, 2, 3),
m{i} AS (SELECT * FROM (SELECT class_id, cluster, word, a / s AS mean, b / s - pow(a / s, 2) AS variance,
    s / sum(s) OVER (PARTITION BY class_id, word) AS weight, s FROM s{i}) WHERE s >= 1e-7),
l{i} AS (SELECT read_id, class_id, cluster, sum({V.DENSITY}) + ln(max(weight)) AS score FROM (
    SELECT read_id, m.class_id, cluster, x, mean, weight, CASE WHEN variance <= 0 THEN 1e-8 ELSE variance END AS v FROM vec JOIN m{i} m USING (word)) GROUP BY 1, 2, 3),
r{i} AS (SELECT gene_id, class_id, cluster, exp(score - mx) / sum(exp(score - mx)) OVER (PARTITION BY gene_id) AS r FROM (
    SELECT gene_id, l.class_id, cluster, score, max(score) OVER (PARTITION BY gene_id) AS mx FROM l{i} l JOIN g ON gene_id = read_id AND g.class_id = l.class_id))"""
    return out


SHORTLIST = """WITH {votes}, v AS (SELECT read_id, class_id, {vote} AS vote FROM votes),
k AS (SELECT *, max(vote) OVER w AS best, count(*) FILTER (WHERE vote = 0) OVER w AS zeros,
    CAST(row_number() OVER (PARTITION BY read_id ORDER BY vote DESC, class_id) AS INTEGER) AS place FROM v WINDOW w AS (PARTITION BY read_id)),
short AS (SELECT read_id, class_id, vote, place FROM k
    WHERE best * {threshold} <= vote OR (place <= {quota} AND (vote > 0 OR (vote < 0 AND (best <= 0 OR zeros = 0)))))"""

SQL = {
    "nb_model": f"WITH {V.VECTORS}, {V.BAYES_MODEL} SELECT class_id, CAST(word AS INTEGER) AS word, round(mean, 9) AS mean, round(variance, 9) AS variance FROM nb",
    "nb_score": f"WITH {V.VECTORS}, {V.BAYES_MODEL}, {V.BAYES_SCORES} SELECT read_id, class_id, round(score, 6) AS score FROM bayes",
    "nb_classify": f"""WITH {V.VECTORS}, {V.BAYES_MODEL}, {V.BAYES_SCORES}
SELECT read_id, class_id, score FROM (SELECT read_id, class_id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY read_id ORDER BY round(score, 6) DESC, class_id) AS place FROM bayes) WHERE place = 1""",
    "nb_gene_score": f"""WITH {GENE_MODEL}
SELECT read_id, class_id, round(sum({V.DENSITY}), 4) AS score FROM (
  SELECT read_id, class_id, x, mean, CASE WHEN variance <= 0 THEN 1e-8 ELSE variance END AS v FROM rf JOIN gm USING (word)) GROUP BY 1, 2""",
    "nn_min_d2": f"""WITH {V.READS}, {V.GENES}, {V.words_cte('genes', 'gene_id', 3, 'gw')}, {V.words_cte('reads', 'read_id', 3, 'rw')},
p AS (SELECT read_id, gene_id, sum(rw.n / (length(r.seq) - 2) * (gw.n / (length(g.seq) - 2))) AS s
  FROM rw JOIN gw USING (word) JOIN reads r USING (read_id) JOIN genes g USING (gene_id) GROUP BY 1, 2)
SELECT r.read_id, g.class_id, round(min(coalesce(s, 0.0)), 9) AS score FROM reads r CROSS JOIN genes g LEFT JOIN p USING (read_id, gene_id) GROUP BY 1, 2""",
    "codelta_model": f"WITH {CODELTA} SELECT class_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(value, 12) AS value FROM cd",
    "codelta_score": f"""WITH {CODELTA}, rd AS ({PAIRS_OF.format(key='read_id', t='rf')})
SELECT read_id, class_id, round(2 * sum(abs(d - value)), 9) AS score FROM rd JOIN cd USING (x, y) GROUP BY 1, 2""",
    "sparse_shared_score": f"""WITH {SHARED}
SELECT read_id, class_id, shared, round(shared * ln(CAST(class_length AS DOUBLE) / read_length), 6) AS score FROM fs JOIN cl USING (class_id) JOIN rl USING (read_id)""",
    "gmm_em_2iter": f"WITH {em(2)} SELECT class_id, cluster, CAST(word AS INTEGER) AS word, round(mean, 6) AS mean, round(variance, 6) AS variance, round(weight, 6) AS weight FROM m2",
    # responsibilities sum to 1, so a round keeps the weighted mean of the clusters at the class's mean
    "gmm_restarts": f"WITH {V.VECTORS} SELECT label AS class_id, CAST(word AS INTEGER) AS word, CAST(1 AS DOUBLE) AS weight, round(avg(x), 6) + 0 AS mean FROM vec GROUP BY label, word",
    "gmm_posterior": f"""WITH {em(2)}, p AS (SELECT read_id, class_id, exp(score - max(score) OVER (PARTITION BY read_id)) AS e FROM l2)
SELECT read_id, class_id, round(sum(e) / sum(sum(e)) OVER (PARTITION BY read_id), 6) AS score FROM p GROUP BY 1, 2""",
    "class_prior_16s": """WITH c AS (SELECT CAST(substr(source, 4) AS INTEGER) AS class_id, count(*) AS n FROM documents GROUP BY 1),
p AS (SELECT class_id, CASE WHEN class_id % 5 <> 0 THEN n ELSE 1 END AS c FROM c)
SELECT class_id, round(ln(CAST(c AS DOUBLE) / sum(c) OVER () * (count(*) OVER () + 1)), 9) AS score FROM p""",
    "class_prior_ap": """SELECT class_id, CASE WHEN class_id % 5 <> 0 THEN round(ln(w), 6) ELSE 0.0 END AS score
FROM (SELECT CAST(substr(source, 4) AS INTEGER) AS class_id, avg(n_chars) AS w FROM documents GROUP BY 1)""",
    "orientation_pick": f"""WITH {SHARED},
s AS (SELECT read_id, round(shared * ln(CAST(class_length AS DOUBLE) / read_length), 6) AS f, 0.0 AS b FROM fs JOIN cl USING (class_id) JOIN rl USING (read_id)
  UNION ALL SELECT read_id, 0.0, round(shared * ln(CAST(class_length AS DOUBLE) / read_length), 6) FROM bs JOIN cl USING (class_id) JOIN rl USING (read_id))
SELECT read_id, round(sum(f), 6) AS forward, round(sum(b), 6) AS backward, round(sum(b) - sum(f), 6) > 0 AS use_reverse FROM s GROUP BY 1""",
    "weighted_vote": f"WITH {V.VOTES} SELECT * FROM votes",
    "softmax_vote": f"""WITH {V.VOTES}, e AS (SELECT read_id, class_id, exp(vote - max(vote) OVER (PARTITION BY read_id)) AS e FROM votes)
SELECT read_id, class_id, round(e / sum(e) OVER (PARTITION BY read_id), 6) AS posterior FROM e""",
    "top_class": f"""WITH {V.VOTES} SELECT read_id, class_id, vote FROM (
SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY vote DESC, class_id) AS place FROM votes) WHERE place = 1""",
    "shortlist_threshold": SHORTLIST.format(votes=V.VOTES, vote="vote", threshold=0.7, quota=1) + " SELECT * FROM short",
    "shortlist_quota": SHORTLIST.format(votes=V.VOTES, vote="round(vote - 35, 6)", threshold=0.7, quota=4) + " SELECT * FROM short",
    "shortlist_hist": SHORTLIST.format(votes=V.VOTES, vote="vote", threshold=0.98, quota=2)
    + " SELECT c.class_id, count(s.read_id) AS reads FROM size c LEFT JOIN short s USING (class_id) GROUP BY 1",
}
