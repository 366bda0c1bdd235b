"""Text formats, by round trips and small files."""

import pytest
from pyspark.sql import functions as F

from seqloom.operators import taxonomy
from seqloom.sources import fasta, lineages, profiles, reports, scores
from seqloom.streaming import reads as streaming


def put(folder, name, text):
    path = folder / name
    path.write_bytes(text.encode())
    return str(path)


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "NC_1.fa", ">NC_1.1|g1 de>sc\r\nACGT\r\nAC GT\r\n>r2\nTT\tAA\n>empty\n>last\nNRY")
    got = [(r.label, r.short_label, r.seq) for r in fasta.read_fasta(spark, path).collect()]
    assert got == [("NC_1.1|g1 de>sc", "NC_1.1|g1", "ACGTACGT"), ("r2", "r2", "TTAA"), ("empty", "empty", ""), ("last", "last", "NRY")]
    assert fasta.read_fasta(spark, path, labels_only=True).columns == ["path", "label", "short_label"]
    assert fasta.is_fasta(spark, path).first().fasta
    fasta.write_fasta(fasta.read_fasta(spark, path), str(tmp_path / "out"))
    assert fasta.read_fasta(spark, str(tmp_path / "out")).count() == 4


def test_class_files(spark):
    rows = spark.createDataFrame([(p,) for p in ("/c/a.fa", "/c/a.fa.gist", "/c/b.fa", "/c/b.fa.bwt", "/c/b.lin", "/c/readme")], "path string")
    got = sorted((r.path, r.class_key, r.profile) for r in fasta.class_files(rows).collect())
    assert got == [("/c/a.fa.gist", "a", True), ("/c/b.fa", "b", False), ("/c/readme", "readme", False)]


def test_lineages(spark, tmp_path):
    path = put(tmp_path, "k12.lin", "no rank: 511145 (E. coli K-12)\nspecies: 562 (Escherichia coli)\ngenus: 561 (Escherichia)\nphylum: 1224 (P)\n")
    rows = lineages.read_lineage_lines(spark, path)
    table = lineages.lineage_table(rows).withColumnRenamed("class_key", "class_id")
    row = taxonomy.propagated(table).first()
    assert (row.strain, row.species, row.genus, row.family, row.phylum, row.superkingdom) == (511145, 562, 561, 561, 1224, 1224)
    nodes = {r.id: r.parent_id for r in lineages.lineage_nodes(rows).collect()}
    assert nodes == {511145: 562, 562: 561, 561: 1224, 1224: None}


def test_dumps(spark, tmp_path):
    nodes = put(tmp_path, "nodes.dmp", "562\t|\t561\t|\tspecies\t|\n561\t|\t1\t|\tgenus\t|\n1\t|\t1\t|\tno rank\t|\n")
    names = put(tmp_path, "names.dmp", "562\t|\tEscherichia coli\t|\t\t|\tscientific name\t|\n562\t|\tbug\t|\t\t|\tsynonym\t|\n561\t|\tEscherichia\t|\t\t|\tscientific name\t|\n")
    n, s = lineages.read_nodes(spark, nodes), lineages.read_names(spark, names)
    ids = spark.createDataFrame([(562,)], "id long")
    got = [r.line for r in taxonomy.ancestry_lines(n, s, ids).orderBy("place").collect()]
    assert got == ["species: 562 (Escherichia coli)", "genus: 561 (Escherichia)"]
    lineages.write_lineages(taxonomy.ancestry_lines(n, s, ids), str(tmp_path / "lin"))
    again = lineages.read_lineage_lines(spark, str(tmp_path / "lin" / "id=562"))
    assert again.count() == 2
    gi = put(tmp_path, "gi.dmp", "123\t562\n124\t561\n")
    assert {r.gi: r.taxid for r in lineages.read_gi_taxids(spark, gi).collect()} == {"123": 562, "124": 561}


def test_label_map(spark, tmp_path):
    path = put(tmp_path, "map.txt", "r1 562\nr2 NC_1\nr3\n")
    classes = spark.createDataFrame([("NC_1", 9)], "class_key string, taxid long")
    assert {r.label: r.taxid for r in lineages.read_label_map(spark, path, classes).collect()} == {"r1": 562, "r2": 9, "r3": None}


def test_config():
    text = "pass1.threshold 0.5\n# comment\npass1.nt.bayes 2\nweight.nt.bayes 1\nprefix.nt.bayes 4\nodd\nno.such 3\npass2.quota 7\n"
    settings, odd = profiles.parse_config(text)
    config, unknown = profiles.configured(settings)
    assert odd == ["odd"] and unknown == ["no.such"]
    assert config.thresholds[0] == 0.5 and config.quotas[1] == 7 and config.prefixes["nt.bayes"] == 4
    assert config.weights["nt_rc.bayes"] == 1.0 and config.passes[0]["nt_rc.bayes"] == 2.0


def test_profiles(spark, tmp_path):
    path = put(tmp_path, "a.gist", "gene-count: 2\nnucleotide-prefix-length: 5\nmeans: 3 0.25 0.5 0.25\nprotein-row: null\n")
    fields, tables = profiles.read_profiles(spark, path, {"nucleotide": 5})
    assert {r.field: r.value for r in fields.collect()}["gene-count"] == "2"
    assert [r.x for r in tables.orderBy("place").collect()] == [0.25, 0.5, 0.25]
    with pytest.raises(Exception, match="Wrong nucleotide"):
        profiles.read_profiles(spark, path, {"nucleotide": 4})[0].collect()
    profiles.write_model(tables.withColumn("class_id", F.lit(1)), str(tmp_path / "m"))
    assert profiles.read_model(spark, str(tmp_path / "m")).where("class_id = 1").count() == 3


def test_scores_record_and_resume(spark, tmp_path):
    rows = spark.createDataFrame([("nt.bayes", 1, 0, 1.5), ("aa.bayes", 1, 1, None)], "method string, read_id int, class_id int, score double")
    scores.write_scores(rows, str(tmp_path / "s"))
    assert sorted(map(tuple, scores.read_scores(spark, str(tmp_path / "s")).fillna(-1).collect())) == sorted(map(tuple, rows.fillna(-1).collect()))
    assert scores.has_protein(rows).count() == 0


def test_weights_round_trip_with_repeated_taxa(spark):
    classes = spark.createDataFrame([(0, 562), (1, 562), (2, 7)], "class_id int, taxid long")
    weights = spark.createDataFrame([("nt.bayes", 0, 0.25), ("nt.bayes", 1, 0.5), ("nt.bayes", 2, 1.0), ("nt_rc.bayes", 2, 9.0)], "method string, class_id int, weight double")
    lines = scores.weight_lines(weights.orderBy("class_id").coalesce(1), classes.coalesce(1)).coalesce(1)
    got = {(r.method, r.class_id): r.class_weight for r in scores.parse_weight_lines(lines, classes).collect()}
    assert sorted(got) == [("nt.bayes", 0), ("nt.bayes", 1), ("nt.bayes", 2)] and got["nt.bayes", 2] == 1.0
    assert {got["nt.bayes", 0], got["nt.bayes", 1]} == {0.25, 0.5}


def test_priors_and_sam(spark, tmp_path):
    path = put(tmp_path, "counts.txt", "NC_1.fa\t7\nNC_2\t3\n")
    assert {r.strain: r["count"] for r in scores.read_counts(spark, path).collect()} == {"NC_1": 7, "NC_2": 3}
    sam = put(tmp_path, "NC_1.fa.sam", "@SQ\tx\nr1\t0\tAS:i:30\nr1\t0\tAS:i:41\nr2\t4\tno score\n")
    assert [(r.short_label, r.class_key, r.score) for r in scores.read_sam(spark, sam).collect()] == [("r1", "NC_1", 30), ("r1", "NC_1", 41)]


def test_reports(spark, tmp_path):
    hits = spark.createDataFrame([(1, "r1", "genus", 561, "Escherichia", 2.0), (1, "r1", "strain", 9, None, 3.0)], "read_id int, label string, rank string, taxid int, name string, score double")
    assert reports.readable(hits).first().value == '>r1\n  strain #9 ""\t3.0\n  genus #561 "Escherichia"\t2.0'
    genes = spark.createDataFrame([("g", 1, "ACGT"), ("g", 2, "AC")], "genome string, i int, seq string")
    assert [(r.gene, r.start, r.end) for r in reports.exons(genes, "i").orderBy("i").collect()] == [("gene_1", 1, 4), ("gene_2", 5, 6)]
    assert reports.condensed(genes, "i").first().seq == "ACGTAC"
    assert [(r.start, r.seq) for r in reports.laid_out(genes, "i").collect()] == [(1, "ACGT"), (5, "AC")]
    manifest = reports.read_manifest(spark, put(tmp_path, "m.tsv", "NC_1.ffn\t1000\n"))
    assert reports.filled_template("REF {genome}\nN {reads}", manifest).first().value == "REF NC_1.ffn\nN 1000"
    assert "gene_2" in reports.gtf_lines(reports.exons(genes, "i")).orderBy("value").collect()[1].value


def test_stream_of_vectors(spark, tmp_path):
    model = spark.createDataFrame([(c, w, float(c), 1.0) for c in (0, 5) for w in (0, 1)], "class_id int, word int, mean double, variance double")
    rows = spark.createDataFrame([(1, [0.1, 0.2]), (2, [4.0, 6.0])], "read_id long, embedding array<float>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = streaming.classify_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.read_id: r.class_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: 0, 2: 5}
