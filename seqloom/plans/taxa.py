"""Queries on trees, lineages, rules, training and text formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import genefinder, rules, taxonomy, training, votes
from ..sources import lineages, profiles, reports, scores as score_tables
from . import views as V
from .classes import SHORTLIST, rounded


#: Means of few rounded numbers often end in a 5 just beyond the digits that are kept.
TIE = 1e-8


def ancestors(spark, d):
    return taxonomy.ancestors(V.tree(spark, d))


def lca_prec(spark, d):
    return taxonomy.common_ancestor(V.pairs(spark, d), taxonomy.ancestors(V.tree(spark, d)))


def lca_sens(spark, d):
    return taxonomy.common_ancestor(V.pairs(spark, d), taxonomy.ancestors(V.tree(spark, d)), sensitive=True)


def subtree_filter(spark, d):
    """Customers below the second region."""
    closure = taxonomy.ancestors(V.tree(spark, d))
    rows = V.table(spark, d, "customer").select((1000000 + F.col("c_custkey")).alias("taxid"), "c_name")
    return taxonomy.in_subtree(rows, "taxid", closure, 12)


RULES = ["label", "-a", "label", "+th", "taxon", "+11", "label", "-00000001", "seq", "+spain"]


def rule_filter(spark, d):
    closure = taxonomy.ancestors(V.tree(spark, d))
    rows = V.table(spark, d, "customer").select((1000000 + F.col("c_custkey")).alias("taxid"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("seq"))
    return rules.filtered(rows, rules.parsed(RULES), closure)


def ancestry_line(spark, d):
    nodes = V.tree(spark, d)
    ids = V.table(spark, d, "nation").select((1000 + F.col("n_nationkey")).cast("long").alias("id"))
    return taxonomy.ancestry_lines(nodes, nodes.select("id", "name"), ids)


def label_presence(spark, d):
    return rules.presence(V.table(spark, d, "documents"), V.table(spark, d, "labels"), "doc_id")


def labels_common(spark, d):
    return rules.common_labels(V.table(spark, d, "documents"), V.table(spark, d, "labels"), "doc_id")


def read_taxa(spark, d):
    """Customers resolved by an account number found among the suppliers, else by market segment."""
    reads = V.table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("gi"), F.col("c_mktsegment").alias("class_key"))
    gi = V.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("gi"), (5000 + F.col("s_nationkey")).alias("taxid"))
    by_class = reads.select("class_key").distinct().where("class_key < 'G'").select("class_key", (9000 + F.length("class_key")).alias("taxid"))
    return rules.resolved_taxa(reads, gi, by_class).select("c_custkey", F.col("taxid").cast("int").alias("taxid"))


def short(spark, d, threshold=0.98, quota=3):
    return votes.shortlist(V.votes(spark, d), threshold, quota)


def tax_mean_of_means(spark, d):
    found = taxonomy.rank_means(V.votes(spark, d), V.lineage(spark, d))
    return rounded(found.withColumn("score", F.col("score") + TIE), 6, "score")


def hit_collapse(spark, d):
    return taxonomy.collapsed_hits(short(spark, d, 0.9, 4), V.lineage(spark, d))


def lineage_propagate(spark, d):
    """Ranks knocked out by the class id's remainders."""
    rows = V.lineage(spark, d).withColumn("strain", 1000 + F.col("class_id"))
    for i, r in enumerate(taxonomy.RANKS):
        rows = rows.withColumn(r, F.when((F.col("class_id") + i) % 3 != 0, F.col(r)))
    return taxonomy.propagated(rows)


def lineage_long(spark, d):
    return taxonomy.long_lineage(V.lineage(spark, d))


def loo_t_stat(spark, d):
    """Each vote against those of the other classes of its order."""
    rows = V.votes(spark, d).join(V.lineage(spark, d).select("class_id", "order"), "class_id")
    found = taxonomy.sibling_test(rows, ["read_id", "order"], "vote")
    found = found.withColumn("sibling_mean", F.round(F.col("sibling_mean") + TIE, 6))
    return rounded(found.select("read_id", "class_id", "siblings", "sibling_mean", "t"), 4, "t")


def bloomed(spark, d, width=5, top="genus"):
    """Shortlists with whole taxa added by the t-test, and the scores of tested taxa; ``width`` classes to a genus, one family, order, class."""
    c, lineage = F.col("class_id"), V.lineage(spark, d)
    above = {"family": F.lit(30000), "order": F.lit(40000), "class": F.lit(50000)}
    lineage = lineage.withColumns({"genus": (20000 + F.floor(c / width)).cast("int"), **above})
    return taxonomy.include_taxa(V.votes(spark, d), short(spark, d, 0.9, 4), lineage, 0.7, top)


def taxon_bloom(spark, d):
    return bloomed(spark, d)[0]


def taxon_bloom_scores(spark, d):
    found = bloomed(spark, d)[1]
    return rounded(found.withColumn("score", F.col("score") + TIE), 6, "score")


def family_bloom(spark, d):
    """Five genera of two classes in a family: the family is tested by its genera."""
    return bloomed(spark, d, 2, "order")[0]


def family_bloom_scores(spark, d):
    """Scores of genera, the family and the order of the same."""
    found = bloomed(spark, d, 2, "order")[1]
    return rounded(found.withColumn("score", F.col("score") + TIE), 6, "score")


def truth_rows(spark, d):
    reads = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("read_id"), F.col("label").alias("key"))
    return training.truth(reads, V.classes(spark, d).select("class_id", F.col("class_id").alias("key")))


def autocross_truth(spark, d):
    reads = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("read_id"), F.col("label").alias("key"))
    return training.truth(reads, V.classes(spark, d).select("class_id", F.col("class_id").alias("key")), V.lineage(spark, d), "genus")


def small_scores(spark, d):
    """Scores of a few units, so that a softmax is not flat or all at one class."""
    scale = F.when(F.col("method") == "bayes", 0.1).when(F.col("method") == "d2", 10.0).otherwise(1.0)
    return V.scores(spark, d).withColumn("score", F.round(F.col("score") * scale, 7))


def autocross_error(spark, d):
    s, right = small_scores(spark, d), truth_rows(spark, d)
    state = training.forward(s, training.uniform_weights(s), right)
    return rounded(training.error(s, state), 6, "error")


def autocross_2iter(spark, d):
    """Weights after two steps at a rate of 2."""
    s, right = small_scores(spark, d), truth_rows(spark, d)
    weights = training.uniform_weights(s)
    for _ in range(2):
        weights = training.stepped(weights, training.error(s, training.forward(s, weights, right)), 2.0)
    return rounded(weights, 6, "weight")


def rmse(spark, d):
    s = small_scores(spark, d)
    return rounded(training.rmse(training.forward(s, training.uniform_weights(s), truth_rows(spark, d))), 6, "rmse")


def method_accuracy(spark, d):
    return training.method_accuracy(small_scores(spark, d), truth_rows(spark, d))


def perf_hits(spark, d):
    """Reads with a right class on the shortlist."""
    return training.performance(short(spark, d), truth_rows(spark, d), V.table(spark, d, "embeddings").withColumnRenamed("vec_id", "read_id"))


def gtf_offsets(spark, d):
    rows = V.table(spark, d, "documents").select(F.col("source").alias("genome"), "doc_id", F.col("text").alias("seq"))
    return reports.exons(rows, "doc_id")


def sam_max_as(spark, d):
    """Alignment lines made from line items, parsed, and the best score of each read and class."""
    li = V.table(spark, d, "lineitem")
    line = F.concat_ws("\t", F.concat(F.lit("r"), F.col("l_orderkey").cast("string")), F.lit("0"), F.lit("*"), F.concat(F.lit("AS:i:"), F.col("l_quantity").cast("int").cast("string")), F.lit("XS:i:3"))
    path = F.concat(F.lit("/x/class"), (F.col("l_suppkey") % 7).cast("string"), F.lit(".fa.sam"))
    found = score_tables.parse_sam(li.select(path.alias("path"), line.alias("value")))
    return found.groupBy(F.col("short_label").alias("read"), "class_key").agg(F.max("score").alias("score"))


def score_pivot(spark, d):
    return score_tables.score_matrix(V.scores(spark, d).where("method = 'd2'"), "read_id", list(range(10)))


def score_unpivot(spark, d):
    """Scores written as lines and parsed again; two classes share a taxid."""
    s = V.scores(spark, d).where("method = 'd2'")
    taxid = F.when(F.col("class_id") < 2, 500).otherwise(500 + F.col("class_id")).cast("long")
    cls = V.classes(spark, d).select("class_id", taxid.alias("taxid"))
    names = sorted(r.class_id for r in cls.select("class_id").collect())
    lines = score_tables.score_lines(s, "read_id", names, "d2")
    head = "\t".join(["method d2", *["500" if i < 2 else str(500 + i) for i in names]])
    lines = lines.withColumn("value", F.when(F.col("place") == 0, head).otherwise(F.col("value")))
    reads = V.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("label"), F.col("vec_id").alias("read_id"))
    return score_tables.parse_score_lines(lines, cls, reads, "d2")


def profile_lines(spark, d):
    """Class means as profile lines, decoded again."""
    rows = V.vector_model(spark, d).select("class_id", "word", F.round("mean", 6).alias("x"))
    again = profiles.decoded(profiles.encoded(rows, ["class_id"], "means"), ["class_id"])
    return again.select("class_id", "name", F.col("place").cast("int").alias("place"), "x")


def report_table(spark, d):
    """The tab-separated report of shortlisted strains."""
    rows = short(spark, d).join(V.lineage(spark, d), "class_id")
    hits = rows.select("read_id", F.concat(F.lit("r"), F.col("read_id").cast("string")).alias("label"), F.lit(0).alias("level"), F.col("class_id").alias("strain"), F.col("vote").alias("score"), *taxonomy.RANKS[1:6], *[F.col("vote").alias(f"{r}_score") for r in taxonomy.RANKS[1:6]])
    return reports.tabular(hits)


def consensus_report(spark, d):
    nodes = V.tree(spark, d)
    found = lca_prec(spark, d).join(nodes.select(F.col("id").alias("consensus"), "rank", "name"), "consensus", "left")
    return reports.consensus_lines(found.withColumn("label", F.concat(F.lit("p"), F.col("guess").cast("string"))))


def pairs_of_lines(spark, d):
    """Consecutive turns of a conversation as child and parent."""
    rows = V.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("class_key"), F.col("turn").alias("place"), (F.col("conv_id") * 1000 + F.col("turn")).alias("taxid"), F.col("role").alias("rank"), F.lit("").alias("name"))
    return lineages.lineage_nodes(rows.distinct()).select("id", "parent_id", "rank")


def filter_counts(spark, d):
    return reports.filter_counts(rule_filter(spark, d))


def orf_viterbi(spark, d):
    """Proteins of reading frames that the gene finder sees in the reads, with neutral parameters."""
    rows = V.reads(spark, d)
    return genefinder.find_genes(rows, genefinder.Parameters.uniform(), least_length=30, least_frame=18).select("read_id", "protein")


NAMES = "orf_viterbi ancestors lca_prec lca_sens subtree_filter rule_filter ancestry_line label_presence labels_common read_taxa tax_mean_of_means hit_collapse lineage_propagate lineage_long loo_t_stat taxon_bloom taxon_bloom_scores family_bloom family_bloom_scores autocross_truth autocross_error autocross_2iter rmse method_accuracy perf_hits gtf_offsets sam_max_as score_pivot score_unpivot profile_lines report_table consensus_report pairs_of_lines filter_counts".split()
QUERIES = {name: globals()[name] for name in NAMES}

LCA = f"""{V.CLOSURE}, {V.PAIRS},
met AS (SELECT guess, reference, a.ancestor, a.distance AS dg FROM pairs JOIN up a ON guess = a.id JOIN up b ON reference = b.id AND a.ancestor = b.ancestor),
best AS (SELECT guess, reference, arg_min(ancestor, dg) AS consensus, min(dg) AS dg FROM met GROUP BY 1, 2)"""
RULE_FILTER = f"""{V.CLOSURE}, c AS (SELECT 1000000 + c_custkey AS taxid, c_name AS label, c_mktsegment AS seq FROM customer),
f AS (SELECT taxid, label, seq, CASE WHEN contains(lower(seq), 'spain') THEN true WHEN contains(lower(label), '00000001') THEN false
  WHEN taxid IN (SELECT id FROM up WHERE ancestor = 11) THEN true WHEN contains(lower(label), 'th') THEN true
  WHEN contains(lower(label), 'a') THEN false ELSE true END AS kept FROM c)"""
R = ["genus", "family", "ord", "cls", "phylum", "superkingdom"]


def means_sql() -> str:
    """Genus: mean of votes; each higher rank: mean of the means below."""
    out = f"WITH {V.VOTES}, {V.LINEAGE}, m0 AS (SELECT read_id, {', '.join(R)}, avg(vote) AS score FROM votes JOIN lineage USING (class_id) GROUP BY ALL)"
    for i in range(1, len(R)):
        out += f", m{i} AS (SELECT read_id, {', '.join(R[i:])}, avg(score) AS score FROM m{i - 1} GROUP BY ALL)"
    names = ["genus", "family", "order", "class", "phylum", "superkingdom"]
    parts = [f"SELECT read_id, '{n}' AS rank, CAST({R[i]} AS INTEGER) AS taxid, round(score + 1e-8, 6) AS score FROM m{i}" for i, n in enumerate(names)]
    return out + " " + " UNION ALL ".join(parts)


def collapse_sql() -> str:
    out = SHORTLIST.format(votes=V.VOTES, vote="vote", threshold=0.9, quota=4) + f", {V.LINEAGE}, t0 AS (SELECT read_id, lineage.* FROM short JOIN lineage USING (class_id))"
    children = {"superkingdom": "phylum", "phylum": "cls", "cls": "ord", "ord": "family", "family": "genus", "genus": "class_id"}
    names = {"ord": "order", "cls": "class"}
    parts = []
    for i, rank in enumerate(reversed(R)):
        out += f""", h{i} AS (SELECT read_id, {rank} FROM (SELECT read_id, {rank}, count(*) AS n FROM t{i} GROUP BY 1, 2)
            JOIN (SELECT {rank}, count(*) AS members, count(DISTINCT {children[rank]}) AS kids FROM lineage GROUP BY 1) USING ({rank}) WHERE n = members AND kids > 1),
            t{i + 1} AS (SELECT * FROM t{i} ANTI JOIN h{i} USING (read_id, {rank}))"""
        parts.append(f"SELECT read_id, '{names.get(rank, rank)}' AS rank, CAST({rank} AS BIGINT) AS taxid FROM h{i}")
    parts.append(f"SELECT read_id, 'strain' AS rank, CAST(class_id AS BIGINT) AS taxid FROM t{len(R)}")
    return out + " " + " UNION ALL ".join(parts)


def propagate_sql() -> str:
    cols = ["species", *R]
    out, below = [], "strain"
    for i, c in enumerate(cols):
        below = f"coalesce(CASE WHEN (class_id + {i}) % 3 <> 0 THEN {c} END, {below})"
        name = {"ord": "order", "cls": "class"}.get(c, c)
        out.append(f'CAST({below} AS INTEGER) AS "{name}"')
    return f"WITH {V.LINEAGE} SELECT class_id, strain, {', '.join(out)} FROM (SELECT *, 1000 + class_id AS strain FROM lineage)"


SMALL = f"""{V.SCORES}, s AS (SELECT method, read_id, class_id, round(score * CASE method WHEN 'bayes' THEN 0.1 WHEN 'd2' THEN 10.0 ELSE 1.0 END, 7) AS score FROM scores),
right_ AS (SELECT vec_id AS read_id, label AS class_id FROM embeddings)"""


def step_sql(rounds: int) -> str:
    out = f"{SMALL}, w0 AS (SELECT DISTINCT method, class_id, CAST(0.5 AS DOUBLE) AS weight FROM s)"
    for i in range(rounds):
        out += f""", v{i} AS (SELECT read_id, class_id, sum(score * weight) AS vote FROM s JOIN w{i} USING (method, class_id) GROUP BY 1, 2),
e{i} AS (SELECT read_id, class_id, vote, exp(vote - max(vote) OVER (PARTITION BY read_id)) AS e FROM v{i}),
p{i} AS (SELECT read_id, class_id, vote, e / sum(e) OVER (PARTITION BY read_id) AS p, CASE WHEN rc IS NULL THEN 0.0 ELSE 1.0 END AS y
  FROM e{i} LEFT JOIN (SELECT read_id AS rr, class_id AS rc FROM right_) ON rr = read_id AND rc = class_id),
g{i} AS (SELECT method, class_id, sum((y - p) * score) / (SELECT count(DISTINCT read_id) FROM p{i}) AS error FROM s JOIN p{i} USING (read_id, class_id) GROUP BY 1, 2),
w{i + 1} AS (SELECT method, class_id, c / sum(c) OVER () AS weight FROM (SELECT method, class_id, least(greatest(weight + 2.0 * error, 0.0001), 0.9999) AS c FROM w{i} JOIN g{i} USING (method, class_id)))"""
    return out


#: With five classes to a genus a class has four siblings, so the t-test has three degrees of freedom, and a closed form.
BLOOM = SHORTLIST.format(votes=V.VOTES, vote="vote", threshold=0.9, quota=4) + """,
g AS (SELECT a.read_id, a.class_id, a.vote, 20000 + a.class_id // 5 AS genus, count(b.vote) AS n, avg(b.vote) AS m, var_samp(b.vote) AS v
  FROM votes a JOIN votes b ON a.read_id = b.read_id AND a.class_id // 5 = b.class_id // 5 AND a.class_id <> b.class_id GROUP BY 1, 2, 3),
means AS (SELECT read_id, 20000 + class_id // 5 AS genus, avg(vote) AS score FROM votes GROUP BY 1, 2),
t AS (SELECT g.*, (m - g.vote) / sqrt(v / n) / sqrt(3.0) AS u FROM g JOIN short USING (read_id, class_id) JOIN means USING (read_id, genus) WHERE v > 1e-12 AND score > 0),
whole AS (SELECT DISTINCT read_id, genus FROM t WHERE 0.5 - (u / (1 + u * u) + atan(u)) / pi() < 0.7),
taken AS (SELECT votes.read_id, class_id, vote, genus FROM votes JOIN whole ON votes.read_id = whole.read_id AND 20000 + class_id // 5 = genus),
hits AS (SELECT DISTINCT read_id, 20000 + class_id // 5 AS genus FROM short)"""
#: The same one rank higher: two classes are too few to test a genus, five genera to a family leave three degrees of freedom.
FAMILY_BLOOM = SHORTLIST.format(votes=V.VOTES, vote="vote", threshold=0.9, quota=4) + """,
means AS (SELECT read_id, class_id // 2 AS genus, avg(vote) AS score FROM votes GROUP BY 1, 2),
hits AS (SELECT DISTINCT read_id, class_id // 2 AS genus FROM short),
g AS (SELECT a.read_id, a.genus, a.score, count(b.score) AS n, avg(b.score) AS m, var_samp(b.score) AS v
  FROM means a JOIN means b ON a.read_id = b.read_id AND a.genus <> b.genus GROUP BY 1, 2, 3),
t AS (SELECT g.*, (m - score) / sqrt(v / n) / sqrt(3.0) AS u FROM g JOIN hits USING (read_id, genus) WHERE v > 1e-12),
takes AS (SELECT read_id, max(score) AS most FROM t WHERE 0.5 - (u / (1 + u * u) + atan(u)) / pi() < 0.7 GROUP BY read_id),
family AS (SELECT read_id, avg(score) AS mean FROM means GROUP BY read_id),
scored AS (SELECT read_id, mean, most IS NOT NULL AND mean > 0 AS taken,
  greatest(0, mean, CASE WHEN most IS NOT NULL AND mean > 0 THEN most ELSE 0 END) AS score FROM family LEFT JOIN takes USING (read_id)
  WHERE read_id IN (SELECT read_id FROM hits))"""

SQL = {
    "taxon_bloom": BLOOM + " SELECT read_id, class_id, vote FROM short UNION SELECT read_id, class_id, vote FROM taken",
    "taxon_bloom_scores": BLOOM + " SELECT read_id, CAST(genus AS INTEGER) AS taxid, round(score + 1e-8, 6) AS score FROM means JOIN hits USING (read_id, genus)",
    "family_bloom": FAMILY_BLOOM + """ SELECT read_id, class_id, vote FROM short UNION
SELECT read_id, class_id, vote FROM votes WHERE read_id IN (SELECT read_id FROM scored WHERE taken)""",
    "family_bloom_scores": FAMILY_BLOOM + """ SELECT read_id, CAST(20000 + genus AS INTEGER) AS taxid, round(score + 1e-8, 6) AS score FROM means JOIN hits USING (read_id, genus)
UNION ALL SELECT read_id, 30000, round(score + 1e-8, 6) FROM scored UNION ALL SELECT read_id, 40000, round(greatest(score, 0) + 1e-8, 6) FROM scored""",
    "ancestors": f"WITH RECURSIVE {V.CLOSURE} SELECT * FROM up",
    "lca_prec": f"WITH RECURSIVE {LCA} SELECT guess, reference, consensus FROM pairs LEFT JOIN best USING (guess, reference)",
    "lca_sens": f"WITH RECURSIVE {LCA} SELECT guess, reference, CASE WHEN dg = 0 THEN reference ELSE consensus END AS consensus FROM pairs LEFT JOIN best USING (guess, reference)",
    "subtree_filter": f"WITH RECURSIVE {V.CLOSURE} SELECT 1000000 + c_custkey AS taxid, c_name FROM customer WHERE 1000000 + c_custkey IN (SELECT id FROM up WHERE ancestor = 12)",
    "rule_filter": f"WITH RECURSIVE {RULE_FILTER} SELECT * FROM f",
    "filter_counts": f"WITH RECURSIVE {RULE_FILTER} SELECT count(*) FILTER (WHERE kept) AS retained, count(*) FILTER (WHERE NOT kept) AS removed FROM f",
    "ancestry_line": f"""WITH RECURSIVE {V.CLOSURE} SELECT up.id, distance AS place, rank || ': ' || tree.id || ' (' || name || ')' AS line
FROM up JOIN tree ON ancestor = tree.id WHERE up.id BETWEEN 1000 AND 1024 AND ancestor <> 1""",
    "label_presence": "SELECT doc_id, count(*) AS files FROM (SELECT DISTINCT doc_id FROM documents UNION ALL SELECT DISTINCT doc_id FROM labels) GROUP BY 1",
    "labels_common": "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels",
    "read_taxa": """SELECT c_custkey, CAST(coalesce(5000 + s_nationkey, CASE WHEN c_mktsegment < 'G' THEN 9000 + length(c_mktsegment) END, -1) AS INTEGER) AS taxid
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""",
    "tax_mean_of_means": means_sql(),
    "hit_collapse": collapse_sql(),
    "lineage_propagate": propagate_sql(),
    "lineage_long": f"WITH {V.LINEAGE} "
    + " UNION ALL ".join(f"SELECT class_id, '{n}' AS rank, {i} AS level, CAST({c} AS INTEGER) AS taxid FROM lineage" for i, (n, c) in enumerate(zip(taxonomy.RANKS, ["species", *R]))),
    "loo_t_stat": f"""WITH {V.VOTES}, {V.LINEAGE}, o AS (SELECT read_id, class_id, vote, ord FROM votes JOIN lineage USING (class_id)),
g AS (SELECT a.read_id, a.class_id, a.vote, count(b.vote) AS siblings, avg(b.vote) AS m, var_samp(b.vote) AS v
  FROM o a LEFT JOIN o b ON a.read_id = b.read_id AND a.ord = b.ord AND a.class_id <> b.class_id GROUP BY 1, 2, 3)
SELECT read_id, class_id, siblings, round(m + 1e-8, 6) AS sibling_mean, CASE WHEN v > 1e-12 THEN round((m - vote) / sqrt(v / siblings), 4) END AS t FROM g""",
    "autocross_truth": f"""WITH {V.LINEAGE} SELECT DISTINCT vec_id AS read_id, b.class_id FROM embeddings JOIN lineage a ON label = a.class_id JOIN lineage b ON a.genus = b.genus""",
    "autocross_error": f"WITH {step_sql(1)} SELECT method, class_id, round(error, 6) AS error FROM g0",
    "autocross_2iter": f"WITH {step_sql(2)} SELECT method, class_id, round(weight, 6) AS weight FROM w2",
    "rmse": f"WITH {step_sql(1)} SELECT round(sqrt(avg(pow(y - p, 2))), 6) AS rmse FROM p0",
    "method_accuracy": f"""WITH {SMALL}, b AS (SELECT *, row_number() OVER (PARTITION BY method, read_id ORDER BY score DESC, class_id) AS k FROM s)
SELECT method, count(*) AS reads, CAST(count(r.read_id) AS BIGINT) AS hits FROM (SELECT * FROM b WHERE k = 1) b LEFT JOIN right_ r ON r.read_id = b.read_id AND r.class_id = b.class_id GROUP BY 1""",
    "perf_hits": SHORTLIST.format(votes=V.VOTES, vote="vote", threshold=0.98, quota=3)
    + " SELECT (SELECT count(*) FROM embeddings) AS reads, count(DISTINCT read_id) AS hits FROM short JOIN embeddings ON vec_id = read_id AND label = class_id",
    "gtf_offsets": """SELECT source AS genome, doc_id, 'gene_' || row_number() OVER w AS gene,
CAST(sum(length(text)) OVER w - length(text) + 1 AS BIGINT) AS start, CAST(sum(length(text)) OVER w AS BIGINT) AS "end" FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)""",
    "sam_max_as": "SELECT 'r' || l_orderkey AS read, 'class' || (l_suppkey % 7) AS class_key, CAST(max(CAST(floor(l_quantity) AS INTEGER)) AS BIGINT) AS score FROM lineitem GROUP BY 1, 2",
    "score_pivot": f"WITH {V.SCORES} SELECT read_id, " + ", ".join(f'max(CASE WHEN class_id = {i} THEN score END) AS "{i}"' for i in range(10)) + " FROM scores WHERE method = 'd2' GROUP BY 1",
    "score_unpivot": f"WITH {V.SCORES} SELECT method, read_id, class_id, score FROM scores WHERE method = 'd2'",
    "profile_lines": f"WITH {V.VECTORS}, {V.BAYES_MODEL} SELECT class_id, 'means' AS name, CAST(word AS INTEGER) AS place, round(mean, 6) AS x FROM nb",
    "report_table": SHORTLIST.format(votes=V.VOTES, vote="vote", threshold=0.98, quota=3)
    + f""", {V.LINEAGE} SELECT 'r' || read_id AS label, CAST(row_number() OVER (PARTITION BY read_id ORDER BY vote DESC, class_id) = 1 AS INTEGER) AS best_hit,
class_id AS strain, vote AS strain_score, """
    + ", ".join(f'CAST({c} AS INTEGER) AS "{n}", vote AS {n}_score' for c, n in zip(R[:5], taxonomy.RANKS[1:6]))
    + " FROM short JOIN lineage USING (class_id)",
    "consensus_report": f"""WITH RECURSIVE {LCA} SELECT CASE WHEN consensus IS NULL THEN 'no consensus for ' || guess || ' and ' || reference
ELSE concat_ws(chr(9), 'p' || guess, consensus, guess, reference, rank, name) END AS value FROM pairs LEFT JOIN best USING (guess, reference) LEFT JOIN tree ON consensus = id""",
    "pairs_of_lines": """SELECT id, max(parent_id) AS parent_id, first(role) AS rank FROM (
SELECT conv_id * 1000 + turn AS id, lead(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_id, role FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)) GROUP BY 1""",
}
