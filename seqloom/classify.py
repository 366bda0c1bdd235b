"""Classification from end to end: fit models of classes, score reads, vote in two passes, report.

    library = fit(genes, config)
    recorded = score(reads, library)            # may be written and read again
    first, last = decide(recorded, lineage, config)
    hits = collapsed_hits(last, lineage)
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.numeric import inverted_distance
from .functions.sequence import AMINO_ACIDS, NUCLEOTIDES, reverse_complement, translated
from .operators import mixture, models, taxonomy, votes, words
from .sources.profiles import Config


@dataclass
class Library:
    """Models by method, all DataFrames keyed by class; nothing is computed before scores are asked for."""

    config: Config
    methods: list[str]
    members: DataFrame
    models: dict[str, tuple] = field(default_factory=dict)


def proteins_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seq", translated(F.col("seq")))


def dense(rows: DataFrame, key: str, freq: DataFrame, symbols: str, prefix: int) -> DataFrame:
    """(key, word, x) of all words, absent ones as zero."""
    cells = models.full_vectors(rows, key, freq, symbols, prefix)
    return cells.select(key, F.posexplode("cells").alias("word", "x"))


def fit(genes: DataFrame, config: Config) -> Library:
    """Models of the classes for every method that has a weight; genes are (gene_id, class_id, seq)."""
    names = votes.enabled(config.weights, config.prefixes, list(config.passes))
    out = Library(config, names, genes.select("gene_id", "class_id"))
    for name in names:
        alphabet, _, family = name.partition(".")
        if alphabet not in ("nt", "aa") or not family:
            continue
        rows = genes if alphabet == "nt" else proteins_of(genes).where("seq <> ''")
        symbols, prefix = (NUCLEOTIDES, AMINO_ACIDS)[alphabet == "aa"], config.prefixes[name]
        domain, members = len(symbols) ** (prefix + 1), rows.select("gene_id", "class_id")
        protein = alphabet == "aa"
        if family == "sparse":
            out.models[name] = words.sparse_table(rows, ["class_id"], prefix, protein=protein)
            continue
        freq = words.word_frequencies(rows, ["gene_id"], prefix, protein=protein)
        if family == "1nn":
            out.models[name] = (members, freq)
        elif family == "bayes":
            out.models[name] = (models.bayes_model(members, freq), domain)
        elif family == "codelta":
            weights = models.likelihood_weights(members, freq, models.bayes_model(members, freq), domain)
            out.models[name] = (models.difference_model(members, models.full_vectors(members, "gene_id", freq, symbols, prefix), weights),)
        elif family == "gmm":
            out.models[name] = (mixture.fit(members, dense(members, "gene_id", freq, symbols, prefix), 2 if protein else 3),)
    return out


def score(reads: DataFrame, library: Library) -> DataFrame:
    """(method, read_id, class_id, score) of the reads (read_id, seq) by every method of the library, reverse complements included.

    Reads without a protein, or too short for a method, have no row in it.
    """
    out = None
    for name in library.methods:
        own = name.replace("_rc", "")
        if own not in library.models:
            continue
        alphabet, family = own.split(".")
        prefix, protein = library.config.prefixes[own], alphabet == "aa"
        rows = reads.withColumn("seq", reverse_complement(F.col("seq"))) if own != name else reads
        rows = (proteins_of(rows) if protein else rows).where(F.length("seq") > prefix)
        symbols, model = AMINO_ACIDS if protein else NUCLEOTIDES, library.models[own]
        if family == "sparse":
            w, n = words.sparse_table(rows, ["read_id"], prefix, protein=protein)
            found = models.sparse_scores(w, n, *model)
        else:
            freq = words.word_frequencies(rows, ["read_id"], prefix, protein=protein)
            if family == "bayes":
                found = models.bayes_scores(freq, model[0], rows, model[1])
            elif family == "1nn":
                found = models.nearest_gene(rows, freq, *model)
            elif family == "codelta":
                cells = models.full_vectors(rows, "read_id", freq, symbols, prefix)
                found = models.difference_scores(cells, model[0])
                found = found.withColumn("score", inverted_distance(F.col("score"), F.lit(float(len(symbols) ** prefix))))
            else:
                found = mixture.class_posteriors(mixture.cluster_scores(dense(rows, "read_id", freq, symbols, prefix), model[0]))
        found = found.select(F.lit(name).alias("method"), "read_id", "class_id", F.col("score").cast("double").alias("score"))
        out = found if out is None else out.unionByName(found)
    return out


def oriented(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Scores of the better strand of each read, under the names of the forward methods."""
    forward = F.regexp_replace("method", "_rc[.]", ".")
    nt = scores.where("method like 'nt%'").withColumns({"forward_method": forward, "reverse": F.col("method").contains("_rc.")})
    pick = votes.orientation(nt, weights).select("read_id", "use_reverse")
    kept = nt.join(pick, "read_id").where(F.col("reverse") == F.col("use_reverse"))
    kept = kept.select(F.col("forward_method").alias("method"), "read_id", "class_id", "score")
    return kept.unionByName(scores.where("method not like 'nt%'").select("method", "read_id", "class_id", "score"))


def weight_table(spark, config: Config, number: int) -> DataFrame:
    """(method, weight): console weight times that of the pass; alignments count with the console weight alone."""
    rows = [(m, float(w) * (1.0 if m == "bwa" else float(config.passes[number].get(m, 0.0)))) for m, w in config.weights.items() if "_rc." not in m]
    return spark.createDataFrame(rows, "method string, weight double")


def decide(scores: DataFrame, lineage: DataFrame | None, config: Config, class_weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Shortlists of the first and of the last pass; each pass votes with the methods that have a weight in it.

    With a lineage, whole taxa join a shortlist by the inclusion test: up to the
    family in the first pass, to the genus in the last.
    """
    spark, out = scores.sparkSession, []
    classes = scores.select("class_id").distinct().count()
    for i, top in enumerate(("family", "genus")):
        weights = weight_table(spark, config, i)
        found = votes.weighted_votes(oriented(scores, weights), weights, class_weights)
        short = votes.shortlist(found, config.thresholds[i], votes.clamped_quota(config.quotas[i], classes, final=i == 1))
        if lineage is not None:
            more, _ = taxonomy.include_taxa(found, short, lineage, config.blooms[i], top)
            short = more.join(short.select("read_id", "class_id", "place"), ["read_id", "class_id"], "left")
        out.append(short)
    return out[0], out[1]
