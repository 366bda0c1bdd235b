"""Votes, shortlists, rules, trees and training, on small tables worked by hand."""

import pytest
from pyspark.sql import functions as F

from seqloom.operators import mixture, rules, taxonomy, training, votes


def listed(spark, values, threshold, quota):
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "read_id int, class_id int, vote double")
    return sorted(r.class_id for r in votes.shortlist(rows, threshold, quota).collect())


@pytest.mark.parametrize(
    "values, threshold, quota, want",
    [
        ([10, 9, 5, 0], 0.7, 4, [0, 1, 2]),
        ([10, 0, -1], 0.7, 3, [0]),
        ([-1, -2, -3], 0.7, 1, [0]),
        ([5, 5, 5], 1.0, 1, [0, 1, 2]),
        ([0, 0], 0.7, 2, [0, 1]),
    ],
)
def test_shortlist(spark, values, threshold, quota, want):
    assert listed(spark, values, threshold, quota) == want


def test_quota_clamp():
    assert votes.clamped_quota(4, 4, final=False) == 2
    assert votes.clamped_quota(4, 4, final=True) == 1
    assert votes.clamped_quota(3, 100, final=True) == 3


def test_method_planning():
    names = votes.enabled({"nt.bayes": 1.0, "aa.1nn": 1.0, "bwa": 1.0, "bias": 0.0}, {"nt.bayes": 5, "aa.1nn": 0}, [{"nt.bayes": 1.0, "bwa": 1.0, "aa.1nn": 1.0}])
    assert names == ["nt.bayes", "nt_rc.bayes", "bwa"]
    assert votes.prefix_lengths(names, {"nt.bayes": 5}) == {"nt": [5], "aa": []}


def test_votes_ignore_nan_and_proteins_of_reads_without_one(spark):
    s = spark.createDataFrame([("nt.bayes", 1, 0, float("nan")), ("nt.bayes", 1, 1, 2.0), ("aa.bayes", 1, 1, 5.0), ("aa.bayes", 2, 1, 5.0)], "method string, read_id int, class_id int, score double")
    w = spark.createDataFrame([("nt.bayes", 2.0), ("aa.bayes", 1.0)], "method string, weight double")
    p = spark.createDataFrame([(2,)], "read_id int")
    got = {(r.read_id, r.class_id): r.vote for r in votes.weighted_votes(s, w, proteins=p).collect()}
    assert got == {(1, 0): 0.0, (1, 1): 4.0, (2, 1): 5.0}


def test_two_passes_can_prune(spark):
    kind = "method string, read_id int, class_id int, score double"
    first = spark.createDataFrame([("a", 1, 0, 10.0), ("a", 1, 1, 1.0)], kind)
    second = spark.createDataFrame([("b", 1, 0, 1.0), ("b", 1, 1, 20.0)], kind)
    w = tuple(spark.createDataFrame([("a", 1.0), ("b", x)], "method string, weight double") for x in (0.0, 1.0))
    for prune, want in ((False, 1), (True, 0)):
        _, last = votes.two_passes(first, second, w, ((0.7, 1), (0.9, 1)), prune)
        assert [r.class_id for r in last.collect()] == [want]


def test_last_matching_rule_wins(spark):
    rows = spark.createDataFrame([("ab", ""), ("a", ""), ("c", ""), (None, None)], "label string, seq string")
    got = [r.kept for r in rules.filtered(rows, rules.parsed(["label", "+a", "-b"])).collect()]
    assert got == [False, True, False, False]
    with pytest.raises(ValueError):
        rules.parsed(["label", "x"])


@pytest.fixture
def tree(spark):
    rows = [(1, None), (2, 1), (3, 1), (4, 2), (5, 2), (6, 4), (7, 7), (8, 99)]
    return spark.createDataFrame(rows, "id long, parent_id long")


def test_ancestors(tree):
    got = {(r.id, r.ancestor): r.distance for r in taxonomy.ancestors(tree).collect()}
    assert got[6, 1] == 3 and got[6, 6] == 0 and got[7, 7] == 0 and got[8, 99] == 1 and (7, 1) not in got


def test_deep_chain(spark):
    n = 41
    rows = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)], "id long, parent_id long")
    got = taxonomy.ancestors(rows)
    assert got.count() == n * (n + 1) // 2
    assert got.where("id = 40 and ancestor = 0").first().distance == 40


def test_consensus_is_symmetric(spark, tree):
    closure = taxonomy.ancestors(tree)
    pairs = spark.createDataFrame([(6, 5), (5, 6), (4, 6), (6, 4), (3, 7)], "guess long, reference long")
    got = {(r.guess, r.reference): r.consensus for r in taxonomy.common_ancestor(pairs, closure).collect()}
    assert got == {(6, 5): 2, (5, 6): 2, (4, 6): 4, (6, 4): 4, (3, 7): None}
    sens = {(r.guess, r.reference): r.consensus for r in taxonomy.common_ancestor(pairs, closure, sensitive=True).collect()}
    assert sens[4, 6] == 6 and sens[6, 4] == 4


def lineage_of(spark, n):
    rows = [(c, 100 + c, 200 + c // 2, 300 + c // 4, 400 + c // 8, 500, 600, 700) for c in range(n)]
    return spark.createDataFrame(rows, "class_id int, species int, genus int, family int, `order` int, class int, phylum int, superkingdom int")


def test_collapse_takes_members_only(spark):
    lin = lineage_of(spark, 8)
    short = spark.createDataFrame([(1, c) for c in (0, 1, 2, 4, 5, 6, 7)], "read_id int, class_id int")
    got = {(r.rank, r.taxid) for r in taxonomy.collapsed_hits(short, lin).collect()}
    assert got == {("genus", 200), ("strain", 2), ("family", 301)}


def test_weak_hit_pulls_in_its_genus(spark):
    rows = [(c, 100 + c, 200 + c // 4, 300, 400, 500, 600, 700) for c in range(8)]
    lin = spark.createDataFrame(rows, "class_id int, species int, genus int, family int, `order` int, class int, phylum int, superkingdom int")
    values = [5.0, 9.0, 9.1, 8.9, 1.0, 0.5, 0.4, 0.6]
    v = spark.createDataFrame([(1, c, x) for c, x in enumerate(values)], "read_id int, class_id int, vote double")
    weak = v.where("class_id = 0").select("read_id", "class_id")
    got, scores = taxonomy.include_taxa(v, weak, lin, 0.05, top="genus")
    assert sorted(r.class_id for r in got.collect()) == [0, 1, 2, 3]
    assert {r.taxid for r in scores.collect()} == {200}
    strong = v.where("class_id = 4").select("read_id", "class_id")
    got, _ = taxonomy.include_taxa(v, strong, lin, 0.05, top="genus")
    assert [r.class_id for r in got.collect()] == [4]


def test_mixture_likelihood_does_not_fall(spark):
    genes = spark.createDataFrame([(i, 0) for i in range(24)], "gene_id long, class_id int")
    vec = spark.createDataFrame([(i, w, float((i % 2) * 4 + w + (i * 7 % 5) / 10)) for i in range(24) for w in range(2)], "gene_id long, word int, x double")
    last = None
    for rounds in (1, 3, 6):
        model = mixture.fit(genes, vec, 2, rounds)
        scores = mixture.cluster_scores(vec, model, "gene_id", genes)
        total = scores.groupBy("gene_id").agg(F.log(F.sum(F.exp("score"))).alias("l")).agg(F.sum("l")).first()[0]
        assert last is None or total >= last - 1e-6
        last = total
    p = mixture.class_posteriors(mixture.cluster_scores(vec.withColumnRenamed("gene_id", "read_id"), model))
    assert p.agg(F.min("score")).first()[0] == pytest.approx(1.0)


def test_ancestors_reach_the_root_of_a_deep_chain(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(151)], "id int, parent_id int")
    up = taxonomy.ancestors(chain)
    assert up.count() == 151 * 152 // 2
    assert up.where("id = 150 and ancestor = 0 and distance = 150").count() == 1
    ring = spark.createDataFrame([(0, 2), (1, 0), (2, 1), (3, 2)], "id int, parent_id int")
    with pytest.raises(ValueError):
        taxonomy.ancestors(ring)


def test_mixture_restarts_leave_the_fixed_point_of_equal_ids(spark):
    genes = spark.createDataFrame([(i * 10, 0) for i in range(20)], "gene_id long, class_id int")
    vec = spark.createDataFrame([(i * 10, w, float(i % 2 * 5 + (i * 7 % 5) / 10)) for i in range(20) for w in range(2)], "gene_id long, word int, x double")
    means = lambda model: sorted(r.mean for r in model.where("word = 0").collect())
    a, b = means(mixture.fit(genes, vec, 2, restarts=6))
    assert a < 1 and b > 4.9
    a, b = means(mixture.fit(genes, vec, 2, 20, fixed=True))
    assert a == pytest.approx(b)


def test_training_finds_the_good_method(spark):
    rows = [(m, r, c, float(v)) for r in range(12) for c in range(3) for m, v in (("good", c == r % 3), ("bad", c == (r + 1) % 3))]
    s = spark.createDataFrame(rows, "method string, read_id int, class_id int, score double")
    right = spark.createDataFrame([(r, r % 3) for r in range(12)], "read_id int, class_id int")
    w = {(r.method, r.class_id): r.weight for r in training.train(s, right, rounds=6, rate=0.5).collect()}
    assert all(w["good", c] > w["bad", c] for c in range(3))
    acc = {r.method: (r.reads, r.hits) for r in training.method_accuracy(s, right).collect()}
    assert acc == {"good": (12, 12), "bad": (12, 0)}
