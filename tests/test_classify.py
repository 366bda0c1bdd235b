"""A whole run on made-up genomes: reads are found in the class they were cut from."""

import random

from pyspark.sql import functions as F

from seqloom import classify
from seqloom.operators import taxonomy
from seqloom.sources import profiles, scores


def test_reads_find_their_class(spark, tmp_path):
    rng = random.Random(7)
    weights = {c: [rng.random() ** 2 + 0.05 for _ in range(4)] for c in range(4)}
    genomes = {(c, g): "".join(rng.choices("ACGT", weights[c], k=260)) for c in range(4) for g in range(4)}
    genes = spark.createDataFrame([(4 * c + g, c, s) for (c, g), s in genomes.items()], "gene_id long, class_id int, seq string")
    cut = [(10 * c + g, c, genomes[c, g][40:160]) for c in range(4) for g in range(2)]
    complement = str.maketrans("ACGT", "TGCA")
    reads = spark.createDataFrame([(i, s if i % 2 else s[::-1].translate(complement)) for i, _, s in cut] + [(999, "A"), (998, None)], "read_id long, seq string")
    text = "prefix.nt.bayes 1\nprefix.nt.sparse 9\nprefix.aa.sparse 2\nweight.nt.bayes 0.001\nweight.nt.sparse 1\nweight.aa.sparse 0.1\npass1.nt.sparse 1\npass2.nt.sparse 1\npass2.nt.bayes 1\npass2.aa.sparse 1\npass1.quota 2\npass2.quota 1\n"
    config, unknown = profiles.configured(profiles.parse_config(text)[0])
    assert not unknown
    library = classify.fit(genes, config)
    assert library.methods == ["nt.bayes", "nt_rc.bayes", "nt.sparse", "aa.sparse", "nt_rc.sparse"]
    scores.write_scores(classify.score(reads, library), str(tmp_path / "scores"))
    recorded = scores.read_scores(spark, str(tmp_path / "scores"))
    lineage = spark.createDataFrame([(c, 100 + c, 200 + c // 2, 300, 400, 500, 600, 700) for c in range(4)], "class_id int, species int, genus int, family int, `order` int, class int, phylum int, superkingdom int")
    first, last = classify.decide(recorded, None, config)
    best = {r.read_id: r.class_id for r in last.where("place = 1").collect()}
    assert all(best[i] == c for i, c, _ in cut)
    assert first.count() >= last.count() and 998 not in best
    assert taxonomy.collapsed_hits(last, lineage).where(F.col("rank") == "strain").count() == last.count()


def test_every_family_scores(spark):
    rng = random.Random(3)
    genes = spark.createDataFrame([(i, i % 2, "".join(rng.choices("ACGT", [1, 2 + i % 2 * 3, 1, 1], k=90))) for i in range(6)], "gene_id long, class_id int, seq string")
    names = ["nt.bayes", "nt.1nn", "nt.codelta", "nt.gmm", "nt.sparse", "aa.bayes"]
    lines = [f"prefix.{n} 1\nweight.{n} 1\npass2.{n} 1" for n in names]
    config, _ = profiles.configured(profiles.parse_config("\n".join(lines))[0])
    out = classify.score(genes.select(F.col("gene_id").alias("read_id"), "seq"), classify.fit(genes, config))
    got = {r.method: r.n for r in out.where("not isnan(score) and score is not null").groupBy("method").agg(F.count("*").alias("n")).collect()}
    assert set(names) | {n.replace("nt.", "nt_rc.") for n in names if n.startswith("nt.")} == set(got)
    assert got["nt.codelta"] == got["nt.gmm"] == got["nt.bayes"] == 12
