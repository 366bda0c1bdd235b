"""Queries on sequences, word tables and their algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import tables, votes, words
from ..operators.loops import scratch
from ..sources.fasta import read_fasta, write_fasta
from . import views as V

ALPHABET = S.AMINO_ACIDS
CODON_MAP = ", ".join(f"('{c}', '{a}')" for c, a in S.CODONS.items())
TRANSLATED = f"""codons(codon, amino) AS (VALUES {CODON_MAP}),
aa AS (SELECT read_id, split_part(string_agg(coalesce(amino, 'X'), '' ORDER BY i), '*', 1) AS seq FROM (
    SELECT read_id, i, substr(seq, CAST(i AS BIGINT), 3) AS codon
    FROM (SELECT read_id, seq, unnest(generate_series(1, length(seq) - 2, 3)) AS i FROM reads WHERE length(seq) > 2))
    LEFT JOIN codons USING (codon) GROUP BY read_id)"""
REVERSED = "rc AS (SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM reads)"


def kmer_count(spark, d):
    return words.count_words(V.reads(spark, d), ["read_id"], 5)


def kmer_freq(spark, d):
    return words.word_frequencies(V.reads(spark, d), ["read_id"], 3).withColumn("x", F.round("x", 9))


def kmer_sparse(spark, d):
    """Word counts of the genes of each class, with the class's number of words."""
    counts, lengths = words.sparse_table(V.genes(spark, d), ["class_id"], 7)
    return counts.join(lengths, "class_id")


def kmer_protein(spark, d):
    return words.count_words(V.proteins(spark, d), ["read_id"], 1, protein=True)


def revcomp_kmer(spark, d):
    return words.count_words(V.reverse_reads(spark, d), ["read_id"], 3)


def codon_translate(spark, d):
    rows = V.reads(spark, d).where("length(seq) > 2")
    return rows.select("read_id", S.translated(F.col("seq")).alias("protein"), F.length(S.translated(F.col("seq"), stop=False)).alias("codons"))


def amino_code(spark, d):
    rows = V.proteins(spark, d).select("read_id", F.explode(F.split("seq", "")).alias("letter")).where("letter <> ''")
    return rows.groupBy(S.amino_code(F.col("letter")).alias("code")).agg(F.count("*").alias("n"))


def gc_bucket(spark, d):
    return V.genes(spark, d).select("gene_id", S.gc_bucket(F.col("seq")).alias("bucket"))


def word_codec(spark, d):
    """Words as numbers and back."""
    rows = words.word_rows(V.reads(spark, d), ["read_id"], 4).select("word").distinct()
    code = S.word_code(F.col("word"))
    return rows.select("word", code.alias("code"), S.word_of_code(code, 5).alias("again"))


def scrubbed_labels(spark, d):
    """Keys of labels such as ``url|conv:turn.x``."""
    label = F.concat(F.col("role"), F.lit("|"), F.col("conv_id").cast("string"), F.lit("|"), F.col("turn").cast("string"), F.lit(" x y"))
    rows = V.table(spark, d, "conversations").select("conv_id", "turn", label.alias("label"))
    return rows.select("conv_id", "turn", S.truth_key(F.col("label")).alias("truth_key"), S.gi_number(F.col("label")).alias("gi"), S.short_label(F.col("label")).alias("short_label"), S.scrub(F.col("label")).alias("scrubbed"))


def class_vectors(spark, d):
    return V.vector_model(spark, d).select("class_id", "word", F.col("mean").alias("x"))


def algebra(name):
    """Class means against the mean of the class with the next id."""

    def query(spark, d):
        a = class_vectors(spark, d)
        b = a.withColumn("class_id", F.col("class_id") - 1)
        on = ["class_id"]
        out = {
            "vec_add": lambda: tables.add(a, b, on),
            "vec_sub": lambda: tables.subtract(a, b, on),
            "vec_mul": lambda: tables.multiply(a, b, on),
            "vec_pow": lambda: tables.add_power(a, b, 2.0, on),
            "vec_scale": lambda: tables.scale(a, 2.5),
        }[name]()
        return out.select("class_id", F.col("word").cast("int"), F.round("x", 9).alias("x"))

    return query


def algebra_sql(value):
    return f"""WITH {V.VECTORS}, {V.BAYES_MODEL}, a AS (SELECT class_id, word, mean AS x FROM nb),
b AS (SELECT class_id - 1 AS class_id, word, x FROM a)
SELECT class_id, CAST(word AS INTEGER) AS word, round({value}, 9) AS x FROM a FULL JOIN b USING (class_id, word)"""


def indel_codec(spark, d):
    """Texts' letters, in their case, on the opposite strand, and the sum of their numbers in each of three codes."""
    rows = V.table(spark, d, "benchmark").select(F.col("item_id").alias("read_id"), F.regexp_replace("text", "[^A-Za-z]", "").alias("seq"))
    total = lambda code: F.aggregate(F.transform(F.filter(F.split("seq", ""), lambda c: c != ""), code), F.lit(0).cast("long"), lambda a, b: a + b)
    codes = {"plain": lambda c: S.base_number(c), "opposite": lambda c: S.base_number(c, True), "indel": lambda c: S.indel_number(c)}
    return rows.select("read_id", S.reverse_complement_indel(F.col("seq")).alias("other"), *[total(f).alias(n) for n, f in codes.items()])


def protein_fasta(spark, d):
    """Translated reads written as FASTA and read again."""
    path = scratch(spark, "proteins")
    rows = V.proteins(spark, d).where("seq <> ''").withColumn("label", F.concat(F.lit("r"), F.col("read_id").cast("string"), F.lit(" protein")))
    write_fasta(rows, path)
    return read_fasta(spark, path).select("label", "short_label", "seq")


def quota_clamp(spark, d):
    """A quota of 40 against each nation's number of customers, in the first and the final pass."""
    rows = V.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("classes"))
    return rows.select("nation", "classes", *[votes.clamped_quotas(F.lit(40), F.col("classes"), final).alias(n) for n, final in (("first", False), ("final", True))])


def d2_similarity(spark, d):
    """Similarity of every vector to every class mean."""
    found = tables.dense_similarity(V.cells(spark, d), "read_id", class_vectors(spark, d), "class_id")
    return found.withColumn("score", F.round("score", 8))


QUERIES = {
    "kmer_count": kmer_count, "kmer_freq": kmer_freq, "kmer_sparse": kmer_sparse, "kmer_protein": kmer_protein,
    "revcomp_kmer": revcomp_kmer, "codon_translate": codon_translate, "amino_code": amino_code, "gc_bucket": gc_bucket,
    "indel_codec": indel_codec, "protein_fasta": protein_fasta, "quota_clamp": quota_clamp,
    "word_codec": word_codec, "scrubbed_labels": scrubbed_labels, "d2_similarity": d2_similarity,
    **{n: algebra(n) for n in ("vec_add", "vec_sub", "vec_mul", "vec_pow", "vec_scale")},
}

SQL = {
    "kmer_count": f"WITH {V.READS}, {V.words_cte('reads', 'read_id', 6, 'w')} SELECT * FROM w",
    "kmer_freq": f"WITH {V.READS}, {V.words_cte('reads', 'read_id', 4, 'w')} SELECT read_id, word, round(n / (length(seq) - 3), 9) AS x FROM w JOIN reads USING (read_id)",
    "kmer_sparse": f"""WITH {V.GENES}, {V.words_cte('genes', 'class_id', 8, 'w')},
l AS (SELECT class_id, CAST(sum(greatest(length(seq) - 7, 0)) AS BIGINT) AS length FROM genes GROUP BY 1)
SELECT class_id, word, n, length FROM w JOIN l USING (class_id)""",
    "kmer_protein": f"WITH {V.READS}, {TRANSLATED}, {V.words_cte('aa', 'read_id', 2, 'w')} SELECT * FROM w WHERE NOT regexp_matches(word, '[^{ALPHABET}]')",
    "revcomp_kmer": f"WITH {V.READS}, {REVERSED}, {V.words_cte('rc', 'read_id', 4, 'w')} SELECT * FROM w",
    "codon_translate": f"WITH {V.READS}, {TRANSLATED} SELECT read_id, aa.seq AS protein, CAST(length(reads.seq) // 3 AS INTEGER) AS codons FROM aa JOIN reads USING (read_id)",
    "amino_code": f"""WITH {V.READS}, {TRANSLATED}
SELECT CAST(instr('{ALPHABET}', letter) - 1 AS INTEGER) AS code, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS letter FROM aa WHERE seq <> '') WHERE letter <> '' GROUP BY 1""",
    "gc_bucket": f"""WITH {V.GENES} SELECT gene_id, CASE WHEN length(seq) > 0 THEN
CAST(least(greatest(CAST(floor(100.0 * length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq)) AS INTEGER) - 26, 0), 43) AS INTEGER) END AS bucket FROM genes""",
    "word_codec": f"""WITH {V.READS}, {V.words_cte('reads', 'read_id', 5, 'w')}
SELECT DISTINCT word, CAST((((instr('TCAG', word[1]) - 1) * 4 + instr('TCAG', word[2]) - 1) * 4 + instr('TCAG', word[3]) - 1) * 16
  + (instr('TCAG', word[4]) - 1) * 4 + instr('TCAG', word[5]) - 1 AS BIGINT) AS code, word AS again FROM w""",
    "scrubbed_labels": """SELECT conv_id, turn, role AS truth_key, CAST(conv_id AS VARCHAR) AS gi, role || '|' || conv_id || '|' || turn AS short_label,
role || '|' || conv_id || '|' || turn || 'xy' AS scrubbed FROM conversations""",
    "d2_similarity": f"WITH {V.VECTORS}, {V.BAYES_MODEL}, {V.D2_SCORES} SELECT read_id, class_id, round(score, 8) AS score FROM d2",
    "vec_scale": f"WITH {V.VECTORS}, {V.BAYES_MODEL} SELECT class_id, CAST(word AS INTEGER) AS word, round(2.5 * mean, 9) AS x FROM nb",
    "indel_codec": """WITH s AS (SELECT item_id AS read_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS seq FROM benchmark),
l AS (SELECT read_id, unnest(string_split(seq, '')) AS c FROM s WHERE seq <> ''),
n AS (SELECT read_id, CAST(sum(CASE upper(c) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END) AS BIGINT) AS plain,
  CAST(sum(CASE upper(c) WHEN 'A' THEN 3 WHEN 'C' THEN 2 WHEN 'G' THEN 1 WHEN 'T' THEN 0 ELSE 4 END) AS BIGINT) AS opposite,
  CAST(sum(CASE c WHEN 'A' THEN 3 WHEN 'C' THEN 2 WHEN 'G' THEN 1 WHEN 'T' THEN 0 WHEN 'a' THEN 8 WHEN 'c' THEN 7 WHEN 'g' THEN 6 WHEN 't' THEN 5 WHEN 'n' THEN 9 WHEN 'x' THEN 10 ELSE 4 END) AS BIGINT) AS indel
  FROM l GROUP BY read_id)
SELECT read_id, reverse(translate(regexp_replace(seq, '[^ACGTacgtnx]', 'N', 'g'), 'ACGTacgtnx', 'TGCAtgcanx')) AS other,
  coalesce(plain, 0) AS plain, coalesce(opposite, 0) AS opposite, coalesce(indel, 0) AS indel FROM s LEFT JOIN n USING (read_id)""",
    "protein_fasta": f"WITH {V.READS}, {TRANSLATED} SELECT 'r' || read_id || ' protein' AS label, 'r' || read_id AS short_label, seq FROM aa WHERE seq <> ''",
    "quota_clamp": """SELECT c_nationkey AS nation, count(*) AS classes, CAST(least(40, greatest(1, count(*) // 2)) AS INTEGER) AS first,
  CAST(least(40, greatest(1, count(*) // 12)) AS INTEGER) AS final FROM customer GROUP BY 1""",
    "vec_add": algebra_sql("coalesce(a.x, 0) + coalesce(b.x, 0)"),
    "vec_sub": algebra_sql("coalesce(a.x, 0) - coalesce(b.x, 0)"),
    "vec_mul": algebra_sql("a.x * b.x") + " WHERE a.x IS NOT NULL AND b.x IS NOT NULL",
    "vec_pow": algebra_sql("coalesce(a.x, 0) + coalesce(pow(b.x, 2), 0)"),
}
