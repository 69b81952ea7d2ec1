"""Connected components."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.session import maybe_broadcast, written


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest reachable id per node: ``(id, component)``.

    Every round joins each node to the one with the least hash among itself and its neighbours,
    and only links between different joined nodes go on.  The order is new in every round, so at
    least a third of the nodes that still have links is expected to go, and all rounds together
    cost about as much as the first.  Edges to ids that are not in ``nodes`` are left out.
    """
    edges = written(edges.select("a", "b").where("a <> b"))
    ids = nodes.select("id").where("id IS NOT NULL").distinct()
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    kind = ids.unionByName(ends).schema["id"].dataType
    ids, seed = _keyed(ids, kind)
    if not ends.join(ids, "id", "left_anti").isEmpty():
        for end in "ab":
            edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_semi")
        edges = written(edges)
    links = edges.select(*(F.xxhash64(F.lit(seed), F.col(end).cast(kind)).alias(end) for end in "ab"))
    joined = []
    while not links.isEmpty():
        number = F.lit(len(joined))  # xxhash64 of it and of one long is a bijection of that long
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("x")).agg(F.min(F.xxhash64(number, "b")).alias("m"))
        to = written(least.select("x", F.least(F.xxhash64(number, "x"), "m").alias("y")))
        for end in "ab":
            links = links.join(to.select(F.col("x").alias(end), F.col("y").alias(f"to_{end}")), end)
        links = links.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        links = written(links.distinct())
        joined.append(to)
    if not joined:
        return ids.select("id", F.col("id").alias("component"))
    root = joined.pop()
    while joined:  # from the few nodes of the last round back to all
        further = root.select(F.col("x").alias("y"), F.col("y").alias("z"))
        root = joined.pop().join(further, "y", "left").select("x", F.coalesce("z", "y").alias("y"))
        root = written(root) if joined and len(joined) % 4 == 0 else root  # no plan of all rounds
    root = written(ids.join(root.withColumnRenamed("x", "key"), "key", "left").select("id", "y"))
    first = maybe_broadcast(written(root.where("y IS NOT NULL").groupBy("y").agg(F.min("id").alias("component"))))
    return root.join(first, "y", "left").select("id", F.coalesce("component", "id").alias("component"))


def _keyed(ids: DataFrame, kind) -> tuple[DataFrame, int]:
    """``(id, key)`` with a hash of its own for each id, and the seed of the hash; another seed is tried if two ids have the same."""
    for seed in count():
        keyed = written(ids.withColumn("key", F.xxhash64(F.lit(seed), F.col("id").cast(kind))))
        if keyed.groupBy("key").count().where("count > 1").isEmpty():
            return keyed, seed
