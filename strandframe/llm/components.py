"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.session import cut_lineage


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of node and neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b")))


def _is_settled(edges: DataFrame) -> bool:
    """True when every edge leads straight to a root: no node has two targets, none is target and source."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``node, label`` for every node of ``links`` (a, b); the label is the smallest node reached.

    ``known`` are the components of earlier links, in the same form: new links are then
    edges between its labels, so work done before is not done again.
    Neighbours are never gathered: each step is a minimum per node and a join.
    The number of rounds grows with the logarithm of the longest chain.
    """
    if known is not None:
        side = lambda x: known.select(F.col("node").alias(x), F.col("label").alias(f"l_{x}"))
        links = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
        links = links.select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
    edges = cut_lineage(_ordered(links))
    while not _is_settled(edges):
        edges = cut_lineage(_ordered(_small_star(_ordered(_large_star(edges)))))
    roots = edges.select(F.col("b").alias("node")).distinct()
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
    if known is None:
        return found
    moved = known.join(found.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    moved = moved.select("node", F.coalesce("to", "label").alias("label"))
    return cut_lineage(moved.unionByName(found.join(known, "node", "left_anti")))
