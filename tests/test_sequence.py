"""Expectations worked by hand, and properties, of sequence functions and word tables."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.functions.numeric import t_cdf
from seqloom.operators import genefinder, models, words


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("r")).first()["r"]


def test_word_counts(spark):
    rows = spark.createDataFrame([(1, "ACGTACGT"), (2, "A"), (3, ""), (4, None)], "id int, seq string")
    got = {(r.id, r.word): r.n for r in words.count_words(rows, ["id"], 1).collect()}
    assert got == {(1, "AC"): 2, (1, "CG"): 2, (1, "GT"): 2, (1, "TA"): 1}
    freq = words.word_frequencies(rows, ["id"], 1).agg(F.sum("x")).first()[0]
    assert freq == pytest.approx(1.0)


def test_protein_words_skip_unknown_letters(spark):
    rows = spark.createDataFrame([(1, "MXKF")], "id int, seq string")
    assert [r.word for r in words.word_rows(rows, ["id"], 1, protein=True).collect()] == ["KF"]


@pytest.mark.parametrize(
    "seq, want", [("AACGTRK", "NYACGTT"), ("", ""), ("acgu", "ACGT"), ("ACGT", "ACGT")]
)
def test_reverse_complement(spark, seq, want):
    assert one(spark, S.reverse_complement(F.col("s")), s=seq) == want


@pytest.mark.parametrize("seq, want", [("ATGAAATAGCCC", "MK"), ("AT", ""), ("", ""), ("ATGNNNTTT", "MXF"), ("ATGAA", "M")])
def test_translation(spark, seq, want):
    assert one(spark, S.translated(F.col("s")), s=seq) == want
    assert one(spark, S.translated(F.lit(None).cast("string")), s=seq) is None


@pytest.mark.parametrize("letter, want", [("F", 0), ("G", 19), ("X", -1), ("", -1)])
def test_amino_code(spark, letter, want):
    assert one(spark, S.amino_code(F.col("s")), s=letter) == want


@pytest.mark.parametrize("gc, want", [(50, 24), (10, 0), (90, 43)])
def test_gc_bucket(spark, gc, want):
    assert one(spark, S.gc_bucket(F.col("s")), s="G" * gc + "A" * (100 - gc)) == want
    assert one(spark, S.gc_bucket(F.col("s")), s="") is None
    assert genefinder.bucket_of("G" * gc + "A" * (100 - gc)) == want


def test_keys(spark):
    row = {"s": "gi|123|ref|NC_1.1| some gene"}
    assert one(spark, S.gi_number(F.col("s")), **row) == "123"
    assert one(spark, S.gi_number(F.col("s")), s="a|b") is None
    assert one(spark, S.truth_key(F.col("s")), s="NC_1.1:x|y") == "NC_1"
    assert one(spark, S.short_label(F.col("s")), **row) == "gi|123|ref|NC_1.1|"
    assert one(spark, S.class_key(F.col("s")), s="/a/b.c/NC_1.fa.gist") == "NC_1"


def test_ambiguity_is_resolved_the_same_way_each_time(spark):
    row = [one(spark, S.resolved(F.col("s"), F.lit(7)), s="ACYRN") for _ in range(2)]
    assert row[0] == row[1] and row[0][:2] == "AC" and row[0][2] in "TC" and row[0][3] in "AG" and row[0][4] in "ACGT"


def test_noise_keeps_the_length(spark):
    assert one(spark, S.with_noise(F.col("s"), 0.0, 1, F.lit(1)), s="ACGT" * 5) == "ACGT" * 5
    assert len(one(spark, S.with_noise(F.col("s"), 0.9, 1, F.lit(1)), s="ACGT" * 5)) == 20


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ACGT", max_size=40), min_size=1, max_size=5))
def test_reverse_complement_is_an_involution(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    again = rows.select("s", S.reverse_complement(S.reverse_complement(F.col("s"))).alias("r")).collect()
    assert all(r.s == r.r for r in again)


@settings(max_examples=10, deadline=None)
@given(st.text("TCAG", min_size=1, max_size=12))
def test_word_codes_round_trip(spark, word):
    back = S.word_of_code(S.word_code(F.col("s")), len(word))
    assert one(spark, back, s=word) == word


def test_t_distribution():
    assert t_cdf([0.0, 2.228139, -1.812461], [5, 10, 10]) == pytest.approx([0.5, 0.975, 0.05], abs=1e-6)


def test_shared_words_score(spark):
    r = spark.createDataFrame([(1, "AAA", 1), (1, "CCC", 1), (1, "GGG", 2)], "read_id int, word string, n long")
    c = spark.createDataFrame([(9, "AAA", 5), (9, "CCC", 1), (9, "GGG", 1), (9, "TTT", 1)], "class_id int, word string, n long")
    lengths = spark.createDataFrame([(1, 10)], "read_id int, length long"), spark.createDataFrame([(9, 100)], "class_id int, length long")
    row = models.sparse_scores(r, lengths[0], c, lengths[1]).first()
    assert row.shared == 3 and row.score == pytest.approx(3 * np.log(10))


def test_closed_bayes_form_equals_the_direct_one(spark):
    genes = spark.createDataFrame([(1, 0, "ACGTAC"), (2, 0, "ACCCGT"), (3, 1, "TTTTTA")], "gene_id int, class_id int, seq string")
    freq = words.word_frequencies(genes, ["gene_id"], 1)
    model = models.bayes_model(genes, freq)
    reads = spark.createDataFrame([(7, "ACGTT"), (8, "GGGGG")], "read_id int, seq string")
    got = {(r.read_id, r.class_id): r.score for r in models.bayes_scores(words.word_frequencies(reads, ["read_id"], 1), model, reads, 16).collect()}
    known = {(r.class_id, r.word): (r.mean, r.variance) for r in model.collect()}
    for read, seq in ((7, "ACGTT"), (8, "GGGGG")):
        for cls in (0, 1):
            total = 0.0
            for w in (a + b for a in "ACGT" for b in "ACGT"):
                x = sum(seq[i : i + 2] == w for i in range(4)) / 4
                mean, v = known.get((cls, w), (0.0, 0.0))
                v = v if v > 0 else 1e-8
                total += -0.5 * np.log(2 * np.pi * v) - (x - mean) ** 2 / (2 * v)
            assert got[read, cls] == pytest.approx(total, rel=1e-9)


def gene_model(gene, reverse=False):
    """Emissions that expect the codons of one gene, on one strand."""
    par = genefinder.Parameters.uniform()
    table = np.full((6, 16, 4), 0.02)
    for i in range(3, len(gene)):
        before = ["ACGT".index(c) for c in gene[i - 2 : i]]
        table[(i - 3) % 6, 4 * before[0] + before[1], "ACGT".index(gene[i])] = 0.9
    par.match[:], par.match_r[:] = (1e-4, table) if reverse else (table, 1e-4)
    par.noncoding[:] = 0.15
    par.transitions |= {"GE": 0.01, "GG": 0.99}
    return par


def test_gene_finder_frames():
    gene, tail = "ATG" + "GCTGAAACCCGTCATTTC" * 6 + "TAA", "GGCATCCA"
    par, whole = gene_model(gene), "AETRHF" * 6

    def found(seq, model=par):
        return [(a, b, strand, genefinder.protein(bases, strand)) for a, b, strand, bases in genefinder.frames(seq, genefinder.viterbi(seq, model))]

    # stop codons out of frame (TGA in GCTGAA) don't end it
    assert found(gene + tail) == [(3, 111, 1, whole)]
    assert found("GGCACCCT" + gene + tail) == [(11, 119, 1, whole)]
    assert found(gene[:60] + "C" + gene[60:] + tail) == [(3, 112, 1, whole)]
    assert found(gene[:60] + gene[61:] + tail) == [(3, 110, 1, whole[:19] + "X" + whole[20:])]
    assert not found("GGCATCCA" * 20)
    complement = str.maketrans("ACGT", "TGCA")
    minus = gene[::-1].translate(complement)
    assert found(minus + "GT" * 20, gene_model(minus, reverse=True)) == [(3, 111, -1, whole)]
    path = genefinder.viterbi(gene, par)
    assert len(path) == len(gene) and path.min() >= 0 and path.max() < genefinder.STATES
    assert genefinder.protein("ATGAAA", 1) == "MK" and genefinder.protein("TTTCAT", -1) == "MK"
    assert genefinder.viterbi("N" * 40, par)[20] == genefinder.NONCODING


def test_insertions_that_spell_stop_codons():
    assert genefinder.spells("CCTCCAACC", 2, 5, 1, genefinder.STOPS)
    assert genefinder.spells("CTACCAC", 2, 5, 2, genefinder.STOPS) and not genefinder.spells("CTACCCC", 2, 5, 2, genefinder.STOPS)
    assert genefinder.spells("CCTCCTACC", 2, 5, 4, genefinder.STOPS_R) and not genefinder.spells("CCTCCAACC", 2, 5, 3, genefinder.STOPS)


def test_gene_finder_parameters_round_trip():
    par = genefinder.Parameters.uniform()
    main = "\n".join(f"{k} {v}" for k, v in par.transitions.items()) + "\nMI\n" + " ".join(["0.25"] * 16) + "\nII\n" + " ".join(["0.25"] * 16) + "\nPI\n" + " ".join(map(str, par.initial))
    text = lambda a: "\n".join(f"{26 + i} " + " ".join(map(str, block.ravel())) for i, block in enumerate(a))
    tables = {"match": par.match, "match_r": par.match_r, "noncoding": par.noncoding, "pwm": par.pwm, **par.windows}
    again = genefinder.parse_parameters(main, {k: text(v) for k, v in tables.items()})
    assert again.transitions == par.transitions and np.allclose(again.pwm, par.pwm) and again.windows["start"].shape == (44, 61, 64)
