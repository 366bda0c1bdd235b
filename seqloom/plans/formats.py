"""Queries on text formats, read and written, on small helpers of the models, and on whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import classify
from ..functions import numeric
from ..functions import sequence as S
from ..operators import models, tables, taxonomy, votes
from ..operators.loops import scratch
from ..sources import fasta, lineages, profiles, reports, scores as score_tables
from . import views as V
from .classes import BASES_4, CODELTA, GENE_MODEL, PAIRS_OF, SHARED, SHORTLIST, codelta_score, gene_model, nb_model, rounded
from .classes import SQL as CLASS_SQL
from .taxa import SQL as TAXA_SQL
from .taxa import short
from .words import REVERSED, TRANSLATED, class_vectors


def text(*parts):
    return F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])


# FASTA and the folders of classes


def labelled(spark, d):
    rows = V.genes(spark, d)
    return rows.select("class_id", text("g", F.col("gene_id"), "|", F.col("class_id"), " of class").alias("label"), F.coalesce("seq", F.lit("")).alias("seq"))


def fasta_records(spark, d):
    """Genes written as FASTA and read again."""
    path = scratch(spark, "fasta")
    fasta.write_fasta(labelled(spark, d), path)
    return fasta.read_fasta(spark, path).select("label", "short_label", "seq")


def fasta_labels(spark, d):
    """Labels alone, from a tree of folders."""
    path = scratch(spark, "fasta")
    rows = labelled(spark, d).select("class_id", text(">", F.col("label"), "\n", F.col("seq")).alias("value"))
    rows.write.partitionBy("class_id").text(path)
    return fasta.read_fasta(spark, path, labels_only=True, recursive=True).select("label", "short_label")


def class_files(spark, d):
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".fa", ".fa.gist", ".fa.bwt", ".lin", ".ffn")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return fasta.class_files(V.table(spark, d, "documents").select(text("/c/", F.col("source"), suffix).alias("path")).distinct())


# Profiles, settings, lineages, dumps and maps


def profile_fields(spark, d):
    n = F.col("count").cast("string")
    lines = F.array(text("gene-count: ", n), F.lit("nucleotide-prefix-length: 5"), text("means: 2 ", n, " 0.5"), F.lit("protein-row: null"), F.lit("no field"))
    rows = V.classes(spark, d).select(text("/c/", F.col("class_id"), ".gist").alias("path"), F.explode(lines).alias("value"))
    return profiles.parse_profiles(rows, {"nucleotide": 5})[0]


SETTINGS = """# a comment
weight.nt.bayes 1
prefix.nt.bayes 5
pass1.nt.bayes 2
pass1.nt.sparse 1
pass2.nt.bayes 1
weight.nt.sparse 0.5
weight.bwa 0
odd
pass1.threshold 0.6
"""


def config_settings(spark, d):
    settings, _ = profiles.parse_config(SETTINGS)
    return spark.createDataFrame(list(settings.items()), "key string, value string")


def method_words(spark, d):
    """Methods that the settings ask for, with their word lengths."""
    config, _ = profiles.configured(profiles.parse_config(SETTINGS)[0])
    names = votes.enabled(config.weights, config.prefixes, list(config.passes))
    lengths = votes.prefix_lengths(names, config.prefixes)["nt"]
    rows = [(n, config.prefixes[n.replace("_rc", "")], lengths.index(config.prefixes[n.replace("_rc", "")])) for n in names]
    return spark.createDataFrame(rows, "method string, prefix int, place int")


def method_dimension(spark, d):
    return votes.methods(spark)


def lineage_files(spark, d):
    """Lineage files of which some ranks are missing, as a table with these filled in."""
    rows = V.lineage(spark, d)
    c = F.col("class_id")
    lines = [F.struct(F.lit(0).alias("place"), text("no rank: ", 1000 + c, " (strain ", c, ")").alias("value"))]
    for i, r in enumerate(taxonomy.RANKS):
        line = F.when((c + i) % 3 != 0, text(f"{r}: ", F.col(r), " (name)"))
        lines.append(F.struct(F.lit(i + 1).alias("place"), line.alias("value")))
    rows = rows.select(text("/l/", c, ".lin").alias("path"), F.explode(F.array(*lines)).alias("x")).select("path", "x.*").where("value is not null")
    found = lineages.lineage_table(lineages.parse_lineage_lines(rows)).withColumnRenamed("class_key", "class_id")
    return taxonomy.propagated(found).select(*[F.col(f"`{n}`").cast("int").alias(n) for n in ("class_id", "strain", *taxonomy.RANKS)])


def lineage_text(spark, d):
    """Ancestries of nations, written as a file each and read again."""
    nodes = V.tree(spark, d)
    ids = V.table(spark, d, "nation").select((1000 + F.col("n_nationkey")).cast("long").alias("id"))
    path = scratch(spark, "lineages")
    lineages.write_lineages(taxonomy.ancestry_lines(nodes, nodes.select("id", "name"), ids), path)
    id_ = F.regexp_extract("path", r"id=(\d+)", 1).cast("long")
    return lineages.lines(spark, path).select(id_.alias("id"), F.col("place").cast("int").alias("place"), F.col("value").alias("line"))


def dump_nodes(spark, d):
    parent = F.coalesce("parent_id", "id")
    return lineages.parse_nodes(V.tree(spark, d).select(text(F.col("id"), "\t|\t", parent, "\t|\t", F.col("rank"), "\t|").alias("value")))


def dump_names(spark, d):
    line = lambda name, kind: text(F.col("id"), "\t|\t", name, "\t|\t\t|\t", kind, "\t|")
    both = F.array(line(F.col("name"), "scientific name"), line(text("other ", F.col("name")), "synonym"))
    return lineages.parse_names(V.tree(spark, d).select(F.explode(both).alias("value")))


def gi_taxids(spark, d):
    rows = V.table(spark, d, "customer").select(text(F.col("c_custkey"), "\t", 9000 + F.col("c_nationkey")).alias("value"))
    return lineages.parse_gi_taxids(rows)


def label_map(spark, d):
    """Customers with the number of a taxon, the name of a class, or neither."""
    second = F.when(F.col("c_custkey") % 3 == 0, text(" ", 9000 + F.col("c_nationkey"))).when(F.col("c_custkey") % 3 == 1, text(" NC_", F.col("c_nationkey"))).otherwise("")
    rows = V.table(spark, d, "customer").select(text("c", F.col("c_custkey"), second).alias("value"))
    named = V.table(spark, d, "nation").where("n_nationkey < 20").select(text("NC_", F.col("n_nationkey")).alias("class_key"), (100 + F.col("n_nationkey")).cast("long").alias("taxid"))
    return lineages.parse_label_map(rows, named)


# Priors, weights, scores, reports and simulations


def by_source(spark, d):
    return V.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))


def prior_files(spark, d):
    """Counts and weights of sources, from their lines."""
    rows = by_source(spark, d)
    counts = score_tables.parse_pairs(rows.select(text(F.col("source"), ".fa\t", F.col("n")).alias("value")), "count", "long")
    weights = score_tables.parse_pairs(rows.select(text(F.col("source"), "\t", F.col("n") * 0.25).alias("value")), "weight", "double")
    return counts.join(weights, "strain")


def learned_weights(spark, d):
    """(method, class_id, weight); the first two classes, which share a taxid, weigh the same."""
    of = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(w).alias("w")) for m, w in (("nt.bayes", 0.5), ("bwa", 0.25), ("nt_rc.bayes", 1.0))]))
    rows = V.classes(spark, d).select("class_id", of.alias("x"))
    return rows.select("x.method", "class_id", (F.col("x.w") + F.greatest(F.col("class_id"), F.lit(1)) * 0.125).alias("weight"))


def weight_files(spark, d):
    """Learned weights written as text and read again; reverse methods are left out."""
    taxid = F.when(F.col("class_id") < 2, 500).otherwise(500 + F.col("class_id")).cast("long")
    cls = V.classes(spark, d).select("class_id", taxid.alias("taxid"))
    path = scratch(spark, "weights")
    score_tables.weight_lines(learned_weights(spark, d), cls).write.text(path)
    return score_tables.parse_weight_lines(spark.read.text(path), cls)


def model_files(spark, d):
    """A class model, saved and read again."""
    path = scratch(spark, "model")
    profiles.write_model(nb_model(spark, d), path)
    return profiles.read_model(spark, path).select("class_id", "word", "mean", "variance")


def score_files(spark, d):
    """Scores, recorded and read again."""
    path = scratch(spark, "scores")
    score_tables.write_scores(V.scores(spark, d), path)
    return score_tables.read_scores(spark, path)


def readable_report(spark, d):
    rows = short(spark, d)
    hits = rows.select("read_id", text("r", F.col("read_id")).alias("label"), F.lit("strain").alias("rank"), F.col("class_id").alias("taxid"), text("class ", F.col("class_id")).alias("name"), F.floor("vote").alias("score"))
    return reports.readable(hits)


def manifest_files(spark, d):
    """A parameter file for each source, from a manifest and a template."""
    manifest = reports.parse_manifest(by_source(spark, d).select(text(F.col("source"), "\t", F.col("n")).alias("value")))
    return reports.filled_template("REF {genome}\nN {reads}\n", manifest)


# Sequences and numbers


def nucleotide_codes(spark, d):
    letters = V.table(spark, d, "benchmark").select(F.explode(F.split("text", "")).alias("letter")).where("letter <> ''")
    return letters.groupBy(S.nucleotide_code(F.col("letter")).alias("code")).agg(F.count("*").alias("n"))


def letters_of(spark, d):
    seq = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return V.table(spark, d, "benchmark").select(F.col("item_id").alias("read_id"), seq.alias("seq")).where("seq <> ''")


def resolved_bases(spark, d):
    """How many letters of a sequence are, after ambiguity is resolved, what they may be."""
    sets = F.create_map(*[F.lit(x) for pair in S.AMBIGUOUS.items() for x in pair])
    rows = letters_of(spark, d).withColumn("plain", S.resolved(F.col("seq"), F.col("read_id")))
    pairs = F.arrays_zip(F.split("seq", "").alias("a"), F.split("plain", "").alias("b"))
    fits = F.filter(pairs, lambda p: F.contains(F.coalesce(F.element_at(sets, p["a"]), p["a"]), p["b"]))
    return rows.select("read_id", F.length("plain").alias("letters"), F.size(fits).alias("fits"))


def noisy_reads(spark, d):
    """Noise changes some bases to others; without noise nothing changes."""
    rows = V.reads(spark, d).where("length(seq) >= 60")
    noisy = S.with_noise(F.col("seq"), 0.3, 5, F.col("read_id"))
    same = S.with_noise(F.col("seq"), 0.0, 5, F.col("read_id")) == F.col("seq")
    return rows.select("read_id", F.length(noisy).alias("length"), noisy.rlike("^[ACGT]*$").alias("bases"), (noisy != F.col("seq")).alias("changed"), same.alias("same"))


def antisense_protein(spark, d):
    rows = V.reads(spark, d).where("length(seq) > 2")
    at = lambda i: S.trinucleotide(F.col("seq"), F.lit(i))
    return rows.select("read_id", S.antisense(F.col("seq")).alias("protein"), at(1).alias("first"), at(3).alias("third"))


def vec_sqrt(spark, d):
    """Roots of squared class means."""
    out = tables.square_root(tables.power(class_vectors(spark, d), 2.0))
    return out.select("class_id", F.col("word").cast("int"), F.round("x", 9).alias("x"))


def codelta_similarity(spark, d):
    found = codelta_score(spark, d)
    return rounded(found.withColumn("score", numeric.inverted_distance(F.col("score"), F.lit(4.0))), 6, "score")


def codelta_weighted(spark, d):
    """Pair differences of classes, each gene weighted by its likelihood in its class."""
    members, freq, model = gene_model(spark, d, once=True)
    weights = models.likelihood_weights(members, freq, model, 16)
    return rounded(models.difference_model(members, models.full_vectors(members, "gene_id", freq, BASES_4, 1), weights), 9, "value")


def t_tail(spark, d):
    """Right tails of Student's t with one to four degrees of freedom."""
    t = ((F.col("l_quantity") - 25) / 10).alias("t")
    rows = V.table(spark, d, "lineitem").select(t, (1 + F.col("l_linenumber") % 4).alias("df")).distinct()
    return rows.select("t", "df", F.round(numeric.right_tail(F.col("t"), F.col("df").cast("double")), 8).alias("p"))


# Whole runs


def library_scores(spark, d):
    """Models of two methods fitted to the genes, and scores of the reads, both strands."""
    config, _ = profiles.configured(profiles.parse_config("prefix.nt.bayes 1\nprefix.nt.sparse 7\nweight.nt.bayes 1\nweight.nt.sparse 1\npass1.nt.bayes 1\npass2.nt.sparse 1\n")[0])
    library = classify.fit(V.genes(spark, d), config)
    return rounded(classify.score(V.reads(spark, d), library), 4, "score")


def two_pass_shortlist(spark, d):
    """A first pass by similarity, a second with naive Bayes beside it."""
    s = V.scores(spark, d)
    weights = [spark.createDataFrame(rows, "method string, weight double") for rows in ([("d2", 1.0)], [("d2", 20.0), ("bayes", 1.0)])]
    one, two = votes.two_passes(s.where("method = 'd2'"), s.where("method = 'bayes'"), tuple(weights), ((0.9, 2), (0.7, 1)))
    both = one.withColumn("pass", F.lit(1)).unionByName(two.withColumn("pass", F.lit(2)))
    return rounded(both, 6, "vote")


def class_weighted_vote(spark, d):
    """Votes with learned weights of some classes."""
    learned = V.classes(spark, d).where("class_id % 2 = 0").select(F.lit("bayes").alias("method"), "class_id", (1 + F.col("class_id") / 10.0).alias("class_weight"))
    weights = spark.createDataFrame(list(V.WEIGHTS.items()), "method string, weight double")
    return rounded(votes.weighted_votes(V.scores(spark, d), weights, learned), 7, "vote")


def distinct_children(spark, d):
    """The first class of each genus."""
    return taxonomy.distinct_children(V.lineage(spark, d).select("class_id", "genus"), "genus", "class_id")


NAMES = """fasta_records fasta_labels class_files profile_fields config_settings method_words method_dimension lineage_files lineage_text
dump_nodes dump_names gi_taxids label_map prior_files weight_files model_files score_files readable_report manifest_files nucleotide_codes
resolved_bases noisy_reads antisense_protein vec_sqrt codelta_similarity codelta_weighted t_tail library_scores two_pass_shortlist
class_weighted_vote distinct_children""".split()
QUERIES = {name: globals()[name] for name in NAMES}

LETTERS = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
GENE_LABEL = "'g' || gene_id || '|' || class_id"
D2_VOTES = "votes AS (SELECT read_id, class_id, score AS vote FROM scores WHERE method = 'd2')"
BOTH_VOTES = "votes AS (SELECT read_id, class_id, sum(score * CASE method WHEN 'd2' THEN 20.0 ELSE 1.0 END) AS vote FROM scores WHERE method <> 'prior' GROUP BY 1, 2)"

RC_BAYES = f"""{GENE_MODEL}, {REVERSED}, {V.words_cte('rc', 'read_id', 2, 'bw')},
bf AS (SELECT r.read_id, cell, word, coalesce(n / (length(seq) - 1), 0.0) AS x FROM rc r CROSS JOIN dom LEFT JOIN bw USING (read_id, word)),
each AS (SELECT 'nt.bayes' AS method, * FROM rf UNION ALL SELECT 'nt_rc.bayes', * FROM bf)"""
SPARSE = "SELECT '{m}' AS method, read_id, class_id, round(shared * ln(CAST(class_length AS DOUBLE) / read_length), 4) AS score FROM {t} JOIN cl USING (class_id) JOIN rl USING (read_id)"

SQL = {
    "fasta_records": f"WITH {V.GENES} SELECT {GENE_LABEL} || ' of class' AS label, {GENE_LABEL} AS short_label, coalesce(seq, '') AS seq FROM genes",
    "fasta_labels": f"WITH {V.GENES} SELECT {GENE_LABEL} || ' of class' AS label, {GENE_LABEL} AS short_label FROM genes",
    "class_files": """WITH p AS (SELECT DISTINCT source, '/c/' || source
    || CASE doc_id % 5 WHEN 0 THEN '.fa' WHEN 1 THEN '.fa.gist' WHEN 2 THEN '.fa.bwt' WHEN 3 THEN '.lin' ELSE '.ffn' END AS path FROM documents)
SELECT path, source AS class_key, ends_with(path, '.gist') AS profile FROM p
WHERE NOT ends_with(path, '.bwt') AND NOT ends_with(path, '.lin') AND path || '.gist' NOT IN (SELECT path FROM p)""",
    "profile_fields": """WITH c AS (SELECT '/c/' || label || '.gist' AS path, count(*) AS n FROM embeddings GROUP BY 1)
SELECT path, 'gene-count' AS field, CAST(n AS VARCHAR) AS value FROM c UNION ALL
SELECT path, 'nucleotide-prefix-length', '5' FROM c UNION ALL SELECT path, 'protein-row', 'null' FROM c""",
    "config_settings": """SELECT * FROM (VALUES ('weight.nt.bayes', '1'), ('prefix.nt.bayes', '5'), ('pass1.nt.bayes', '2'), ('pass1.nt.sparse', '1'),
('pass2.nt.bayes', '1'), ('weight.nt.sparse', '0.5'), ('weight.bwa', '0'), ('pass1.threshold', '0.6')) t(key, value)""",
    "method_words": """SELECT method, CAST(prefix AS INTEGER) AS prefix, CAST(dense_rank() OVER (ORDER BY prefix) - 1 AS INTEGER) AS place
FROM (VALUES ('nt.bayes', 5), ('nt_rc.bayes', 5), ('nt.sparse', 14), ('nt_rc.sparse', 14)) t(method, prefix)""",
    "method_dimension": """SELECT replace(a.l, 'rc', '_rc') || '.' || f AS method, CASE a.l WHEN 'aa' THEN 'aa' ELSE 'nt' END AS alphabet, a.l = 'ntrc' AS reverse,
  CASE WHEN a.l = 'ntrc' THEN 'nt.' || f END AS forward
FROM (VALUES ('nt'), ('aa'), ('ntrc')) a(l) CROSS JOIN (VALUES ('bayes'), ('1nn'), ('codelta'), ('gmm'), ('sparse')) b(f)
UNION ALL SELECT m, CASE m WHEN 'bwa' THEN 'alignment' ELSE 'prior' END, false, NULL FROM (VALUES ('bwa'), ('16s'), ('prior'), ('bias')) c(m)""",
    "lineage_files": TAXA_SQL["lineage_propagate"].replace("SELECT class_id, strain,", "SELECT class_id, CAST(strain AS INTEGER) AS strain,"),
    "lineage_text": TAXA_SQL["ancestry_line"],
    "dump_nodes": f"WITH {V.TREE} SELECT id, coalesce(parent_id, id) AS parent_id, rank FROM tree",
    "dump_names": f"WITH {V.TREE} SELECT id, name FROM tree",
    "gi_taxids": "SELECT CAST(c_custkey AS VARCHAR) AS gi, CAST(9000 + c_nationkey AS BIGINT) AS taxid FROM customer",
    "label_map": """SELECT 'c' || c_custkey AS label,
CAST(CASE c_custkey % 3 WHEN 0 THEN 9000 + c_nationkey WHEN 1 THEN CASE WHEN c_nationkey < 20 THEN 100 + c_nationkey END END AS BIGINT) AS taxid FROM customer""",
    "prior_files": "SELECT source AS strain, count(*) AS count, count(*) * CAST(0.25 AS DOUBLE) AS weight FROM documents GROUP BY 1",
    "weight_files": """SELECT method, class_id, CAST(w + greatest(class_id, 1) * 0.125 AS DOUBLE) AS class_weight
FROM (SELECT DISTINCT label AS class_id FROM embeddings) CROSS JOIN (VALUES ('nt.bayes', 0.5), ('bwa', 0.25)) m(method, w)""",
    "model_files": CLASS_SQL["nb_model"],
    "score_files": f"WITH {V.SCORES} SELECT * FROM scores",
    "readable_report": SHORTLIST.format(votes=V.VOTES, vote="vote", threshold=0.98, quota=3)
    + """ SELECT read_id, '>r' || read_id || chr(10) || string_agg('  strain #' || class_id || ' "class ' || class_id || '"' || chr(9) || CAST(floor(vote) AS BIGINT),
    chr(10) ORDER BY floor(vote) DESC, class_id) AS value FROM short GROUP BY 1""",
    "manifest_files": "SELECT source AS genome, 'REF ' || source || chr(10) || 'N ' || count(*) || chr(10) AS value FROM documents GROUP BY source",
    "nucleotide_codes": """SELECT CAST(nullif(instr('TCAG', replace(upper(letter), 'U', 'T')) - 1, -1) AS INTEGER) AS code, count(*) AS n
FROM (SELECT unnest(string_split(text, '')) AS letter FROM benchmark) WHERE letter <> '' GROUP BY 1""",
    "resolved_bases": f"""SELECT item_id AS read_id, CAST(length({LETTERS}) AS INTEGER) AS letters, CAST(length({LETTERS}) AS INTEGER) AS fits
FROM benchmark WHERE {LETTERS} <> ''""",
    "noisy_reads": f"WITH {V.READS} SELECT read_id, CAST(length(seq) AS INTEGER) AS length, true AS bases, true AS changed, true AS same FROM reads WHERE length(seq) >= 60",
    "antisense_protein": f"""WITH {V.READS}, {REVERSED}, {TRANSLATED[: TRANSLATED.index('aa AS')].rstrip().rstrip(',')},
t AS (SELECT read_id, string_agg(coalesce(amino, 'X'), '' ORDER BY i) AS protein FROM (
  SELECT read_id, i, substr(seq, CAST(i AS BIGINT), 3) AS codon FROM (SELECT read_id, seq, unnest(generate_series(1, length(seq) - 2, 3)) AS i FROM rc WHERE length(seq) > 2))
  LEFT JOIN codons USING (codon) GROUP BY 1),
n AS (SELECT read_id, k, CASE WHEN length(seq) >= k + 2 THEN (instr('ACGT', seq[k]) - 1) * 16 + (instr('ACGT', seq[k + 1]) - 1) * 4 + instr('ACGT', seq[k + 2]) - 1 ELSE 0 END AS code
  FROM reads CROSS JOIN (VALUES (1), (3)) v(k))
SELECT read_id, protein, CAST(a.code AS INTEGER) AS first, CAST(b.code AS INTEGER) AS third FROM t JOIN (SELECT * FROM n WHERE k = 1) a USING (read_id) JOIN (SELECT * FROM n WHERE k = 3) b USING (read_id)""",
    "vec_sqrt": f"WITH {V.VECTORS}, {V.BAYES_MODEL} SELECT class_id, CAST(word AS INTEGER) AS word, round(abs(mean), 9) AS x FROM nb",
    "codelta_similarity": f"""WITH {CODELTA}, rd AS ({PAIRS_OF.format(key='read_id', t='rf')})
SELECT read_id, class_id, round(1.0 / greatest(round(2 * sum(abs(d - value)), 9), 1e-5) / sqrt(4.0), 6) AS score FROM rd JOIN cd USING (x, y) GROUP BY 1, 2""",
    "codelta_weighted": f"""WITH {GENE_MODEL}, gv AS (SELECT class_id, word, mean, CASE WHEN variance <= 0 THEN 1e-8 ELSE variance END AS v FROM gm),
top AS (SELECT class_id, sum(-0.5 * ln(2 * pi() * v)) AS best FROM gv GROUP BY 1),
gene_weight AS (SELECT gene_id, sum({V.DENSITY}) / max(best) AS weight FROM gf JOIN gv USING (class_id, word) JOIN top USING (class_id) GROUP BY 1),
gd AS ({PAIRS_OF.format(key='gene_id', t='gf')})
SELECT class_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(sum(d * weight) / count(*), 9) AS value FROM gd JOIN genes USING (gene_id) JOIN gene_weight USING (gene_id) GROUP BY 1, 2, 3""",
    "t_tail": """SELECT t, df, round(0.5 - CASE df WHEN 1 THEN atan(t) / pi() WHEN 2 THEN t / (2 * sqrt(2 + t * t))
  WHEN 3 THEN (t / sqrt(3.0) / (1 + t * t / 3) + atan(t / sqrt(3.0))) / pi()
  ELSE 0.375 * t / sqrt(1 + t * t / 4) * (1 - t * t / (1 + t * t / 4) / 12) END, 8) AS p
FROM (SELECT DISTINCT (l_quantity - 25) / 10 AS t, 1 + l_linenumber % 4 AS df FROM lineitem)""",
    "library_scores": f"""SELECT * FROM (WITH {RC_BAYES} SELECT method, read_id, class_id, round(sum({V.DENSITY}), 4) AS score FROM (
  SELECT method, read_id, class_id, x, mean, CASE WHEN variance <= 0 THEN 1e-8 ELSE variance END AS v FROM each JOIN gm USING (word)) GROUP BY 1, 2, 3)
UNION ALL SELECT * FROM (WITH {SHARED} {SPARSE.format(m='nt.sparse', t='fs')} UNION ALL {SPARSE.format(m='nt_rc.sparse', t='bs')})""",
    "two_pass_shortlist": "SELECT read_id, class_id, round(vote, 6) AS vote, place, pass FROM (SELECT *, 1 AS pass FROM ("
    + SHORTLIST.format(votes=f"{V.SCORES}, {D2_VOTES}", vote="vote", threshold=0.9, quota=2)
    + " SELECT * FROM short) UNION ALL SELECT *, 2 AS pass FROM ("
    + SHORTLIST.format(votes=f"{V.SCORES}, {BOTH_VOTES}", vote="vote", threshold=0.7, quota=1)
    + " SELECT * FROM short))",
    "class_weighted_vote": f"""WITH {V.SCORES} SELECT read_id, class_id, round(sum(score * CASE method WHEN 'bayes' THEN 1.0 WHEN 'd2' THEN 20.0 ELSE 2.0 END
  * CASE WHEN method = 'bayes' AND class_id % 2 = 0 THEN 1 + class_id / 10.0 ELSE 1.0 END), 7) AS vote FROM scores GROUP BY 1, 2""",
    "distinct_children": f"WITH {V.LINEAGE} SELECT CAST(min(class_id) AS INTEGER) AS class_id, CAST(genus AS INTEGER) AS genus FROM lineage GROUP BY genus",
}
