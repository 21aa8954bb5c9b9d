"""Graphs as edge tables: components, reduction, paths, ancestor propagation. Rounds are cut by reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder, so that lineage ends here.

    A session on this machine alone (master local) that names no folder gets one; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master or "").startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandframe-"))
    return df.checkpoint(eager=True)


def connected_components(edges: DataFrame) -> DataFrame:
    """node, cluster (least node of its component) for undirected edges (a, b).

    Nodes hook to their least neighbour, chains of hooks are shortened by jumping, and edges between the groups so
    found go on; the number of rounds grows with the logarithm of the component sizes.
    """
    left = cut(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    found = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("cluster", F.col("node"))
    while not left.isEmpty():
        parent = cut(left.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")))
        while True:
            top = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = cut(parent.join(top, "up").select("node", F.col("top"), (F.col("top") != F.col("up")).alias("moved")))
            parent = jumped.select("node", F.col("top").alias("up"))
            if jumped.where("moved").isEmpty():
                break
        found = cut(found.join(parent.select(F.col("node").alias("cluster"), "up"), "cluster", "left").select("node", F.coalesce("up", "cluster").alias("cluster")))
        a, b = (parent.select(F.col("node").alias(x), F.col("up").alias(f"{x}_")) for x in ("a", "b"))
        left = cut(left.join(a, "a").join(b, "b").where("a_ <> b_").select(F.col("a_").alias("a"), F.col("b_").alias("b")).distinct())
    return found


def reduced(edges: DataFrame) -> DataFrame:
    """Directed edges (u, v, ofs), the least offset of each pair, without those that two others span."""
    short = edges.groupBy("u", "v").agg(F.min("ofs").alias("ofs"))
    first, second = short.select("u", F.col("v").alias("m")), short.select(F.col("u").alias("m"), "v")
    return short.join(first.join(second, "m").select("u", "v").distinct(), ["u", "v"], "left_anti")


def unambiguous(edges: DataFrame) -> DataFrame:
    """Edges that are their source's only one out and their target's only one in."""
    one_out = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("u")
    one_in = edges.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("v")
    return edges.join(one_out, "u", "left_semi").join(one_in, "v", "left_semi")


def chains(edges: DataFrame) -> DataFrame:
    """node, head and place along the paths of unambiguous edges, by pointer doubling; cycles are left out."""
    links = unambiguous(edges).select("u", "v")
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    state = cut(nodes.join(links.select(F.col("v").alias("node"), F.col("u").alias("up")), "node", "left").select("node", F.coalesce("up", "node").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("place"), F.col("up").isNull().alias("done")))
    n, before = state.where("done").count(), 0
    # a path has nodes at every distance from its head: where a round leads none of them there, only cycles are left
    while n > before:
        far = state.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("place").alias("more"), F.col("done").alias("there"))
        state = cut(state.join(far, "up").select("node", F.col("top").alias("up"), (F.col("place") + F.col("more")).alias("place"), F.col("there").alias("done")))
        n, before = state.where("done").count(), n
    heads = links.select(F.col("u").alias("up")).join(links.select(F.col("v").alias("up")), "up", "left_anti").distinct()
    return state.join(heads, "up", "left_semi").select("node", F.col("up").alias("head"), "place")


def highest_scoring_paths(edges: DataFrame, score: str = "score") -> DataFrame:
    """For each node of an acyclic graph (u, v, score) the best sum of scores of a path that ends there.

    A round for each edge of the longest path; the edges are written once.
    """
    edges = cut(edges.select("u", "v", score))
    best = cut(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("best", F.lit(0.0)))
    for _ in range(best.count()):
        step = edges.join(best.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.max(F.col("best") + F.col(score)).alias("next"))
        new = cut(best.join(step, "node", "left").select("node", F.greatest("best", F.coalesce("next", F.lit(0.0))).alias("best"), (F.coalesce("next", F.lit(0.0)) > F.col("best")).alias("moved")))
        best, moved = new.drop("moved"), not new.where("moved").isEmpty()
        if not moved:
            break
    return best


def ancestors(parents: DataFrame) -> DataFrame:
    """term, ancestor (itself included) over the edges (term, parent), doubling the reach each round."""
    terms = parents.select(F.explode(F.array("term", "parent")).alias("term")).where("term is not null").distinct()
    reach = cut(parents.where("parent is not null").select("term", F.col("parent").alias("ancestor")).unionByName(terms.select("term", F.col("term").alias("ancestor"))).distinct())
    n = reach.count()
    while True:
        via = reach.select(F.col("term").alias("ancestor"), F.col("ancestor").alias("top"))
        reach = cut(reach.join(via, "ancestor").select("term", F.col("top").alias("ancestor")).distinct())
        n, before = reach.count(), n
        if n == before:
            return reach


def propagated_counts(genes: DataFrame, parents: DataFrame) -> DataFrame:
    """Different genes of every term or of any term below it."""
    return genes.join(ancestors(parents), "term").groupBy(F.col("ancestor").alias("term")).agg(F.count_distinct("gene").alias("genes"))


def pair_scaffolds(pairs: DataFrame, least: int) -> DataFrame:
    """contig, scaffold (its first contig), place and flipped of contigs that read pairs join.

    `pairs` has a row for each pair: c1, s1, c2, s2, the contigs of its mates and the strands they map to; c1 leads to
    c2. A link counts with at least `least` pairs and in the orientation (same strands or not) that most of them show,
    the same one on ties. Contigs with several links out or in end their scaffold there. A contig is flipped if an odd
    number of links from the scaffold's first contig to it joins opposite strands.
    """
    same = F.sum((F.col("s1") == F.col("s2")).cast("long"))
    links = pairs.where("c1 <> c2").groupBy(F.col("c1").alias("u"), F.col("c2").alias("v")).agg(F.count(F.lit(1)).alias("n"), same.alias("same")).where(F.col("n") >= least)
    kept = cut(unambiguous(links.select("u", "v", (F.col("same") * 2 < F.col("n")).cast("long").alias("turn"))))
    placed = cut(chains(kept).join(kept.select(F.col("v").alias("node"), "turn"), "node", "left"))
    before = Window.partitionBy("head").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    turned = F.sum(F.coalesce("turn", F.lit(0))).over(before) % 2 == 1
    return placed.select(F.col("node").alias("contig"), F.col("head").alias("scaffold"), "place", turned.alias("flipped"))
