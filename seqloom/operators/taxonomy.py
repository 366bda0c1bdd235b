"""Lineages and trees: ancestors, common ancestors, means up the ranks, inclusion of whole taxa."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import right_tail
from .loops import cut

#: Ranks from the lowest up (fixed values).
RANKS = ["species", "genus", "family", "order", "class", "phylum", "superkingdom"]
ROOTS = (1, 131567)


def propagated(lineage: DataFrame) -> DataFrame:
    """Missing ranks (null or 0) take the id of the next lower rank; a missing species that of the strain."""
    below = F.col("strain")
    out = {}
    for rank in RANKS:
        below = F.coalesce(F.nullif(F.col(rank), F.lit(0)), below)
        out[rank] = below
    return lineage.select("class_id", "strain", *[c.alias(r) for r, c in out.items()])


def long_lineage(lineage: DataFrame) -> DataFrame:
    """(class_id, rank, level, taxid) of a lineage with a column for each rank."""
    cells = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(i).alias("level"), F.col(r).alias("taxid")) for i, r in enumerate(RANKS)])
    return lineage.select("class_id", F.explode(cells).alias("x")).select("class_id", "x.*")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, distance) of every node, itself included, up to the root.

    Each round doubles the distance covered, so a tree of depth d takes log2(d)
    joins; chains end at a node that is its own parent, at a parent that is no
    node, or at null. Raises ValueError if a node is its own ancestor further up.
    """
    edges = nodes.select("id", "parent_id").where("parent_id is not null and parent_id <> id").distinct()
    known = cut(edges.select("id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("distance")))
    reach = 1
    while not known.where(F.col("distance") == reach).isEmpty():
        # from every end of a longest chain, all that is known from there
        more = known.where(F.col("distance") == reach).alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.id"))
        more = more.select(F.col("a.id").alias("id"), F.col("b.ancestor").alias("ancestor"), (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        known = cut(known.unionByName(more))
        if not known.where("id = ancestor").isEmpty():
            raise ValueError("the parents of some nodes form a cycle")
        reach *= 2
    own = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    return own.distinct().unionByName(known)


def common_ancestor(pairs: DataFrame, closure: DataFrame, sensitive: bool = False) -> DataFrame:
    """(guess, reference, consensus): the deepest node that is ancestor-or-self of both; null if none.

    ``sensitive``: the reference itself, where the guess is its ancestor-or-self.
    """
    up = lambda key, name: closure.select(F.col("id").alias(key), "ancestor", F.col("distance").alias(name))
    met = pairs.join(up("guess", "dg"), "guess").join(up("reference", "dr"), ["reference", "ancestor"])
    best = met.groupBy("guess", "reference").agg(F.min_by(F.struct("ancestor", "dg"), F.col("dg")).alias("b"))
    rows = pairs.select("guess", "reference").join(best, ["guess", "reference"], "left")
    consensus = F.col("b.ancestor")
    if sensitive:
        consensus = F.when(F.col("b.dg") == 0, F.col("reference")).otherwise(consensus)
    return rows.select("guess", "reference", consensus.alias("consensus"))


def in_subtree(rows: DataFrame, key: str, closure: DataFrame, taxon: int) -> DataFrame:
    """Rows whose node is the taxon or lies below it."""
    below = closure.where(F.col("ancestor") == taxon).select(F.col("id").alias(key)).distinct()
    return rows.join(below, key, "left_semi")


def ancestry_lines(nodes: DataFrame, names: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, place, line): ``rank: taxid (name)`` from each id up to the root, or to cellular organisms."""
    up = ancestors(nodes).join(ids.select("id").distinct(), "id")
    stop = up.where(F.col("ancestor").isin(*ROOTS)).groupBy("id").agg(F.min("distance").alias("stop"))
    named = up.join(stop, "id", "left").where("stop is null or distance < stop")
    named = named.join(nodes.select(F.col("id").alias("ancestor"), "rank"), "ancestor")
    named = named.join(names.select(F.col("id").alias("ancestor"), "name"), "ancestor", "left")
    line = F.format_string("%s: %d (%s)", "rank", "ancestor", F.coalesce("name", F.lit("")))
    return named.select("id", F.col("distance").alias("place"), line.alias("line"))


def rank_means(votes: DataFrame, lineage: DataFrame) -> DataFrame:
    """(read_id, rank, taxid, score): genus: mean of its classes' votes; above: unweighted mean of the child taxa's scores; taxon 0 scores 0."""
    known = lambda rank, score: F.when(F.col(rank) == 0, 0.0).otherwise(score).alias("score")
    level = votes.join(lineage, "class_id").groupBy("read_id", *RANKS[1:]).agg(F.avg("vote").alias("mean")).select("read_id", *RANKS[1:], known("genus", F.col("mean")))
    out = level.select("read_id", F.lit("genus").alias("rank"), F.col("genus").alias("taxid"), "score")
    for rank in RANKS[2:]:
        upper = RANKS[RANKS.index(rank) :]
        level = level.groupBy("read_id", *upper).agg(F.avg("score").alias("mean")).select("read_id", *upper, known(rank, F.col("mean")))
        out = out.unionByName(level.select("read_id", F.lit(rank).alias("rank"), F.col(rank).alias("taxid"), "score"))
    return out


def sibling_test(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Adds the other members' mean, number and one-sample t statistic against each row's value.

    Sums over the group less the row's own value: no self-join. Fewer than two
    siblings, or siblings that are all equal, have a null statistic.
    """
    over = W.partitionBy(*group)
    v = F.col(value)
    n = F.count(v).over(over) - 1
    mean = (F.sum(v).over(over) - v) / F.nullif(n, F.lit(0))
    squares = F.sum(v * v).over(over) - v * v
    rows = rows.withColumns({"siblings": n, "sibling_mean": mean, "sibling_squares": squares})
    spread = (F.col("sibling_squares") - F.col("siblings") * F.col("sibling_mean") * F.col("sibling_mean")) / (F.col("siblings") - 1)
    rows = rows.withColumn("sibling_variance", F.when(F.col("siblings") > 1, F.greatest(spread, F.lit(0.0)))).drop("sibling_squares")
    t = (F.col("sibling_mean") - v) / F.sqrt(F.col("sibling_variance") / F.col("siblings"))
    return rows.withColumn("t", F.when(F.col("sibling_variance") > 1e-12, t))


def include_taxa(votes: DataFrame, shortlisted: DataFrame, lineage: DataFrame, bloom: float, top: str = "phylum") -> tuple[DataFrame, DataFrame]:
    """Shortlist with whole taxa added, and (read_id, taxid, score) of every tested taxon, taken or not.

    Taxa with a shortlisted member are tested, bottom up to ``top``. For each
    shortlisted class of a genus a right-tailed one-sample t-test compares its
    siblings' votes with its own; with p < ``bloom`` for one of them, and a
    positive mean vote of the whole genus, the genus is shortlisted whole. The
    same holds at each higher rank with its child taxa's scores, but never for
    taxon 0.

    A genus scores the mean of its votes. Above, a taxon without shortlisted
    members scores the mean of its children's scores, one with them the
    greatest of 0, that mean, and, if it was taken in, the scores of the
    children whose tests took it in (all of them, so that no order of classes
    matters). Taxon 0 scores 0. Scores of taxon 0 are not returned.
    """
    full = cut(votes.join(lineage, "class_id"))
    short = shortlisted.select("read_id", "class_id").distinct()
    first = full.join(short.withColumn("hit", F.lit(True)), ["read_id", "class_id"], "left")
    level = first.select("read_id", *RANKS[1:], F.col("vote").alias("value"), F.coalesce("hit", F.lit(False)).alias("hit"))
    scores, taken = None, None
    for rank in RANKS[1 : RANKS.index(top) + 1]:
        upper = RANKS[RANKS.index(rank) :]
        tested = sibling_test(level, ["read_id", *upper], "value")
        p = right_tail(F.when(F.col("hit"), F.col("t")), F.col("siblings").cast("double") - 1)
        tested = tested.withColumn("takes", F.coalesce(p < bloom, F.lit(False)))
        groups = tested.groupBy("read_id", *upper).agg(
            F.avg("value").alias("mean"), F.bool_or("hit").alias("hit"), F.bool_or("takes").alias("takes"), F.max(F.when(F.col("takes"), F.col("value"))).alias("most")
        )
        taking = F.col("takes") & (F.col("mean") > 0)
        if rank != "genus":
            taking = taking & (F.col(rank) != 0)
        raised = F.greatest(F.lit(0.0), "mean", F.when(taking, F.col("most"))) if rank != "genus" else F.col("mean")
        value = F.when(F.col(rank) == 0, 0.0).otherwise(F.when(F.col("hit"), raised).otherwise(F.col("mean")))
        level = cut(groups.select("read_id", *upper, value.alias("value"), "hit", taking.alias("taken")))
        here = level.where(F.col("hit") & (F.col(rank) != 0)).select("read_id", F.col(rank).alias("taxid"), F.col("value").alias("score"))
        whole = level.where("taken").select("read_id", F.lit(rank).alias("rank"), F.col(rank).alias("taxid"))
        scores, taken = (here, whole) if scores is None else (scores.unionByName(here), taken.unionByName(whole))
        level = level.drop("taken")
    for rank in RANKS[1 : RANKS.index(top) + 1]:
        own = taken.where(F.col("rank") == rank).select("read_id", F.col("taxid").alias(rank)).distinct()
        short = short.unionByName(full.join(own, ["read_id", rank], "left_semi").select("read_id", "class_id"))
    return cut(short.distinct().join(votes, ["read_id", "class_id"])), scores.groupBy("read_id", "taxid").agg(F.max("score").alias("score"))


def collapsed_hits(shortlisted: DataFrame, lineage: DataFrame) -> DataFrame:
    """(read_id, rank, taxid): taxa all of whose classes are shortlisted and that have more than one child, top rank first; the rest as strains.

    A taxon that is full takes all its members with it, and one that is not
    takes none, so counts over the whole shortlist serve all ranks at once; they
    are windows within a read, over one partitioning.
    """
    sized = lineage
    for rank in RANKS[1:]:
        child = RANKS[RANKS.index(rank) - 1] if rank != "genus" else "class_id"
        sizes = lineage.groupBy(rank).agg(F.count("*").alias(f"{rank}_members"), F.countDistinct(child).alias(f"{rank}_children"))
        sized = sized.join(sizes, rank)
    rows = shortlisted.select("read_id", "class_id").join(cut(sized), "class_id").repartition("read_id")
    hit = F.struct(F.lit("strain").alias("rank"), F.col("class_id").cast("long").alias("taxid"))
    for rank in RANKS[1:]:
        n = F.count("*").over(W.partitionBy("read_id", rank))
        full = (n == F.col(f"{rank}_members")) & (F.col(f"{rank}_children") > 1) & (F.col(rank) != 0)
        hit = F.when(full, F.struct(F.lit(rank).alias("rank"), F.col(rank).cast("long").alias("taxid"))).otherwise(hit)
    return rows.select("read_id", hit.alias("hit")).select("read_id", "hit.*").distinct()


def distinct_children(rows: DataFrame, taxon: str, order: str) -> DataFrame:
    """The first row, by ``order``, of each child taxon."""
    first = F.row_number().over(W.partitionBy(taxon).orderBy(order))
    return rows.withColumn("first_", first).where("first_ = 1").drop("first_")
