"""Class models against plain Python."""

import math
import random

import pytest

from seqloom.operators import models


def test_a_gene_is_weighed_in_its_own_class_alone(spark, monkeypatch):
    """Not against every class, of which all but one would be dropped; a gene without words and words that a class lacks count, too."""
    rng, domain, floor = random.Random(4), 6, 1e-8
    classes = {g: g % 3 for g in range(12)}
    cells = {g: {w: rng.random() for w in rng.sample(range(domain), 3)} for g in range(11)}
    model = {(c, w): (rng.random(), rng.choice([0.0, 0.3, 0.7])) for c in range(3) for w in range(domain - 2)}
    genes = spark.createDataFrame(list(classes.items()), "gene_id long, class_id int")
    vectors = spark.createDataFrame([(g, w, x) for g, row in cells.items() for w, x in row.items()], "gene_id long, word int, x double")
    table = spark.createDataFrame([(*k, *v) for k, v in model.items()], "class_id int, word int, mean double, variance double")

    def density(g, x_of):
        total = 0.0
        for w in range(domain):
            mean, variance = model.get((classes[g], w), (0.0, 0.0))
            v = variance if variance > 0 else floor
            total += -0.5 * math.log(2 * math.pi * v) - (x_of(w, mean) - mean) ** 2 / (2 * v)
        return total

    monkeypatch.setattr(models, "grid", None)
    got = dict(models.likelihood_weights(genes, vectors, table, domain).collect())
    want = {g: density(g, lambda w, mean: cells.get(g, {}).get(w, 0.0)) / density(g, lambda w, mean: mean) for g in classes}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-9) for g in want)


def test_vectors_do_not_move_to_few_words(spark, capsys):
    """A domain of few words would deal all vectors to as many tasks."""
    vectors = spark.createDataFrame([(r, w, 0.5) for r in range(9) for w in range(2)], "read_id long, word int, x double")
    model = spark.createDataFrame([(c, w, 0.1, 0.2) for c in range(2) for w in range(2)], "class_id int, word int, mean double, variance double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        models.bayes_scores(vectors, model, vectors.select("read_id").distinct(), 2).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(word" not in capsys.readouterr().out
