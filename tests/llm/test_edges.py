"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import common, decontaminate, langid, mixing, pii, repeats, secrets, simhash, suffix_tree, topk, toxicity

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key int, target string, score string, fp int, h string, t int, found string, row int"
LONG = "lorem ipsum dolor " * 8000


@pytest.fixture(scope="module")
def odd(spark):
    base = [
        (1, "the quick brown fox jumps", "en", "a", 25), (1, "the quick brown fox jumps", "en", "a", 25), (2, None, None, None, None), (None, "no id here", "en", "b", 10),
        (None, None, None, None, None), (3, "", "en", "a", 0), (4, LONG, "en", None, len(LONG)), (5, "  \t\n ", "de", "b", 5), (6, "x" * 30000, None, "a", 30000), (7, "\u0000\u001f 😀 é", "fr", "c", 6), (8, LONG, "de", "c", 1),
    ]
    return spark.createDataFrame([(*r, "s", 1, "t", "u", 2, "h", 3, "f", 4) for r in base], SCHEMA)


def operators(spark):
    bench = spark.createDataFrame([(1, "quick brown fox"), (None, None), (2, ""), (3, "lorem ipsum dolor " * 5), (1, "jumps")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (None, 1, 1), (3, None, None), (5, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    return {
        "mix": mixing.mix,
        "secrets": secrets.find_secrets,
        "language": langid.identify,
        "decontaminate": lambda d: decontaminate.decontaminate(d, bench),
        "pii": lambda d: pii.find_personal_data(d, redacted=True),
        "toxicity": lambda d: toxicity.score_toxicity(d, labels),
        "scores": suffix_tree.score_texts,
        "near_duplicates": simhash.near_duplicates,
        "repeats": lambda d: repeats.remove_repeats(d, cleaned=True),
    }


NAMES = ["mix", "secrets", "language", "decontaminate", "pii", "toxicity", "scores", "near_duplicates", "repeats"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    out = operators(spark)[name](odd)
    rows = out.collect()
    assert len(rows) == odd.count()
    assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(out.columns)
    assert len(out.columns) == len({c.lower() for c in out.columns})
    twins = [tuple(r) for r in rows if r.doc_id == 1]
    if name != "mix":  # a mix may cut between repeated rows
        assert len(twins) == 2 and twins[0] == twins[1]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, odd, name):
    assert operators(spark)[name](odd.limit(0)).count() == 0


def test_defined_values(spark, odd):
    ops = operators(spark)
    lang = {(r.doc_id, r.text): r for r in ops["language"](odd).collect()}
    assert lang[2, None].lang_pred == lang[3, ""].lang_pred == "und" and lang[2, None].score == 0
    near = {r.doc_id: r for r in ops["near_duplicates"](odd).collect() if r.doc_id is not None}
    assert near[2].fp == near[3].fp == near[5].fp == 0 and near[5].component_id == 2 and near[8].component_id == 4
    cut = {r.doc_id: r for r in ops["repeats"](odd).collect() if r.doc_id is not None}
    assert cut[4].n_removed == len(LONG) and cut[1].n_removed == 0 and cut[6].n_removed == 30000 and cut[2].n_bytes == 0
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 2, 4, 6, 7]


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, score int")
    assert topk.top_k(df, F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0]), (0, [1.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(one, F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_odd_vectors(spark):
    vectors = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("-inf"), 1.0]), (5, []), (6, [-1.0]), (7, [0.0, 3.0]), (None, [9.0, 9.0]), (8, [0.0, 3.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    asked = lambda d: [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(d, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert asked(df) == [(0, 1, 7, 6.0), (0, 2, 8, 6.0), (0, 3, 5, 0.0), (0, 4, 6, -1.0)]
    none = spark.createDataFrame([(0, []), (1, []), (2, [])], "vec_id long, embedding array<float>")
    assert asked(none) == [(0, 1, 1, 0.0), (0, 2, 2, 0.0)]


def test_a_row_repeated_very_often_stays_once(spark):
    rows = spark.createDataFrame([(i, "one two three four five", "en", "a", 23) for i in (7, 8)], "doc_id long, text string, lang string, source string, n_chars long")
    many = rows.crossJoin(spark.range(2000)).drop("id").unionByName(spark.createDataFrame([(None, None, None, None, None)] * 3, rows.schema))
    assert sorted((r.doc_id or -1, r.text) for r in simhash.deduplicate(many).collect()) == [(-1, None), (7, "one two three four five")]


@pytest.mark.parametrize("i", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows(spark, odd, i):
    name, stage = corpus_pipeline.STAGES[i]
    for rows in (odd, odd.limit(0)):
        out = stage(spark, rows, SMALL)
        out.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]


def test_samples_are_bounded_whatever_the_ids(spark):
    """Null ids, one id in all rows, and one row in most of them keep to the bound."""
    n, bound = 6000, 200
    made = spark.range(n).selectExpr("id as n", "concat('text ', id) as t")
    for key in ("cast(null as long)", "7", "n"):
        rows = made.selectExpr(f"{key} as id", "t", "'en' as lang")
        size = common.sampled(rows, F.col("id"), F.col("lang"), bound, F.col("t")).count()
        assert bound / 2 < size < 2 * bound
    alike = made.selectExpr("7 as id", "if(n < 5000, 'same', t) as t", "'en' as lang")
    assert common.sampled(alike, F.col("id"), F.col("lang"), bound, F.col("t")).count() < 2 * bound


def test_null_ids_of_a_mix_are_spread(spark):
    df = spark.range(2000).selectExpr("cast(null as long) as doc_id", "concat('a b ', id) as text", "'s' as source")
    taken = mixing.mix(df, share=0.5).agg(F.sum("taken"), F.max("target")).first()
    assert abs(taken[0] - taken[1]) < 1


def test_blocks_of_a_benchmark_are_sent_one_after_the_other(spark, capsys):
    docs = spark.createDataFrame([(1, "quick brown fox and more"), (2, "none"), (3, "the end of it all")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(["quick brown fox", "end of it", "brown", "all", "more"])], "item_id long, text string")
    want, got = (decontaminate.decontaminate(docs, bench, cleaned=True, block_bytes=size) for size in (1 << 20, 8))
    decontaminate.decontaminate(docs, bench, block_bytes=8).explain()
    assert "MapInArrow" not in capsys.readouterr().out  # each block is read from what was written
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
