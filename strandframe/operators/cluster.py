"""Clustering on distances: components, exact linkage inside them, medoids and assignment.

Pairs are found block by block, components by iterative joins, and trees by rounds of
merges (``linkage``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.operators.blocks import against_reference
from strandframe.operators.distance import block_pairs, distances, in_tiles, near_pairs, stack
from strandframe.operators.graph import connected_components
from strandframe.operators.linkage import LOCAL, keyed_name, leaf_positions, lowest_merges, merge_table, plain_name, spanning_forest
from strandframe.operators.matrix import signed_maxabs
from strandframe.session import cut_lineage


def medoids(points: DataFrame, metric: str = "euclidean", block: int = 2_000) -> DataFrame:
    """Member with the least summed distance and its largest distance per group of ``(grp, id, vec)``.

    A pair of blocks gives one sum and one maximum per point, never its pairs.
    """
    p = points.select(F.col("grp").cast("string").alias("grp"), F.col("id").cast("string").alias("id"), "vec")

    def sums(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame()
        d = distances(stack(a["vec"]), stack(b["rvec"]), metric)
        d[a["id"].to_numpy()[:, None] == b["rid"].to_numpy()[None, :]] = 0.0
        return pd.DataFrame({"grp": key[0], "id": a["id"].to_numpy(), "s": d.sum(1), "r": d.max(1)})

    part = block_pairs(p, block, True).applyInPandas(in_tiles(sums, block), "grp string, id string, s double, r double")
    total = part.groupBy("grp", "id").agg(F.sum("s").alias("s"), F.max("r").alias("r"))
    best = F.min_by(F.struct(F.col("id").alias("medoid"), F.col("r").alias("radius")), F.struct("s", "id"))
    return total.groupBy(F.col("grp").alias("cluster")).agg(best.alias("x")).select("cluster", "x.*")


# -------------------------------------------------------------------- linkage
def cluster_groups(
    points: DataFrame, metric: str = "correlation", linkage: str = "complete", threshold: float | None = None, n_clusters: int | None = None,
    local: int = LOCAL, block: int = 2_000,
) -> DataFrame:
    """Labels ``(grp, id, cluster)`` for ``(grp, id, vec)``; a cluster is named by its smallest member.

    With a threshold and single linkage the components of the graph ``distance < threshold`` are the
    clusters; the other linkages merge until no height is under it.  With a number of clusters the lowest
    merges of a group's whole tree are done until that many are left.
    """
    if (threshold is None) == (n_clusters is None):
        raise ValueError("give a threshold or a number of clusters")
    points = cut_lineage(points.select(F.col("grp").cast("string").alias("grp"), F.col("id").cast("string").alias("id"), "vec"))
    nodes = points.select(keyed_name("grp", "id").alias("id"))
    if threshold is not None:
        if linkage == "single":
            edges = near_pairs(points, metric, threshold, block)
        else:
            edges = merge_table(points, metric, linkage, threshold, local, block)
        comp = connected_components(nodes, edges.select(keyed_name("grp", "a").alias("a"), keyed_name("grp", "b").alias("b"))).withColumnRenamed("id", "key")
    else:
        if linkage == "single":  # the edges of the spanning tree have the heights of the merges
            merges = spanning_forest(points, metric, block).select("grp", "a", "b", F.col("dist").alias("height"), F.lit(0).alias("round"))
        else:
            merges = merge_table(points, metric, linkage, None, local, block)
        keep = points.groupBy("grp").agg((F.count(F.lit(1)) - n_clusters).alias("keep"))
        low = lowest_merges(merges, keep)
        comp = connected_components(nodes, low.select(keyed_name("grp", "a").alias("a"), keyed_name("grp", "b").alias("b"))).withColumnRenamed("id", "key")
    labelled = points.select("grp", "id", keyed_name("grp", "id").alias("key")).join(comp, "key")
    return labelled.select("grp", "id", plain_name("component").alias("cluster"))


def agglomerative_cluster(
    points: DataFrame, metric: str = "correlation", linkage: str = "complete", threshold: float | None = None, n_clusters: int | None = None,
    local: int = LOCAL,
) -> DataFrame:
    """``(id, cluster)`` for one set of points ``(id, vec)``."""
    p = points.select(F.lit("all").alias("grp"), "id", "vec")
    return cluster_groups(p, metric, linkage, threshold, n_clusters, local).drop("grp")


def number_clusters(labels: DataFrame) -> DataFrame:
    """Integer labels by size, largest first; -1 stays -1."""
    size = labels.filter("cluster <> '-1'").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    num = size.withColumn("number", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "cluster")) - 1)
    return labels.join(num.select("cluster", "number"), "cluster", "left").withColumn("cluster", F.coalesce("number", F.lit(-1))).drop("number")


# ----------------------------------------------------- medoids and assignment
def assign_to_centroid(points: DataFrame, centroids: DataFrame, metric: str = "euclidean", bound: int = 5_000) -> DataFrame:
    """Nearest centroid of the same group, -1 beyond its radius: ``(grp, id, cluster)``."""

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for grp, part in left.groupby("grp"):
            ref = right[right["grp"] == grp].sort_values("cluster")
            if not len(ref):
                continue
            d = distances(stack(part["vec"]), stack(ref["vec"]), metric)
            k = d.argmin(1)
            out.append(pd.DataFrame({
                "grp": grp, "id": part["id"].to_numpy(), "cluster": ref["cluster"].astype(str).to_numpy()[k],
                "dist": d[np.arange(len(k)), k], "radius": ref["radius"].to_numpy(float)[k],
            }))
        return pd.concat(out) if out else pd.DataFrame()

    near = against_reference(
        points.select("grp", "id", "vec"), centroids.select("grp", F.col("cluster").cast("string").alias("cluster"), "radius", "vec"), compare,
        "grp string, id string, cluster string, dist double, radius double", "id", "cluster", bound=bound,
    )
    best = near.groupBy("grp", "id").agg(F.min(F.struct("dist", "cluster", "radius")).alias("x"))
    got = best.select("grp", "id", F.when(F.col("x.dist") > F.col("x.radius"), "-1").otherwise(F.col("x.cluster")).alias("cluster"))
    # a group without any centroid keeps its points, unassigned
    return points.select("grp", "id").join(got, ["grp", "id"], "left").select("grp", "id", F.coalesce("cluster", F.lit("-1")).alias("cluster"))


def cluster_medoid(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Member with the least summed distance and its largest distance, from pairs ``(a, b, dist)`` both ways."""
    c = clusters.select(F.col("name").alias("a"), "cluster")
    d = clusters.select(F.col("name").alias("b"), F.col("cluster").alias("cb"))
    s = pairs.join(c, "a").join(d, "b").filter("cluster = cb").groupBy("cluster", "a").agg(F.sum("dist").alias("s"), F.max("dist").alias("r"))
    best = F.min_by(F.struct(F.col("a").alias("medoid"), F.col("r").alias("radius")), F.struct("s", "a"))
    return s.groupBy("cluster").agg(best.alias("x")).select("cluster", "x.*")


def cluster_representatives(pairs: DataFrame, clusters: DataFrame, consider: int = 60) -> DataFrame:
    """Three members far from each other per cluster: ``(cluster, rep1, rep2, rep3)``.

    The ``consider`` most distant pairs of a cluster each get the third member with the largest
    summed distance; the triplet with the largest total wins.
    """
    c = clusters.select(F.col("name").alias("a"), "cluster")
    d = clusters.select(F.col("name").alias("b"), F.col("cluster").alias("cb"))
    inside = pairs.join(c, "a").join(d, "b").filter("cluster = cb").select("cluster", "a", "b", "dist")
    w = W.partitionBy("cluster").orderBy(F.col("dist").desc(), "a", "b")
    top = inside.filter("a < b").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= consider).drop("r")
    x = top.join(inside.select("cluster", "a", F.col("b").alias("c"), F.col("dist").alias("dac")), ["cluster", "a"])
    x = x.join(inside.select("cluster", "b", F.col("a").alias("c"), F.col("dist").alias("dbc")), ["cluster", "b", "c"])
    x = x.filter("c <> a AND c <> b").withColumn("total", F.col("dist") + F.col("dac") + F.col("dbc"))
    trio = F.array_sort(F.array("a", "b", "c"))
    best = x.groupBy("cluster").agg(F.max_by(trio, F.struct("total", "a", "b", "c")).alias("x"))
    return best.select("cluster", *[F.col("x")[i].alias(f"rep{i + 1}") for i in range(3)])


def representatives(points: DataFrame, metric: str = "euclidean", consider: int = 60, block: int = 2_000) -> DataFrame:
    """As ``cluster_representatives`` from ``(grp, id, vec)``, without a pair table.

    A pair of blocks gives its ``consider`` most distant pairs; each of the group's best pairs then
    meets every block once and keeps its best third member there.
    """
    p = points.select(F.col("grp").cast("string").alias("grp"), F.col("id").cast("string").alias("id"), "vec")

    def far(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame()
        d = distances(stack(a["vec"]), stack(b["rvec"]), metric)
        ia, jb = a["id"].to_numpy(), b["rid"].to_numpy()
        d[(ia[:, None] >= jb[None, :]) if key[1] == key[2] else (ia[:, None] == jb[None, :])] = -np.inf
        k = min(consider, d.size)
        # every pair at least as far as the k-th, so that ties are settled by the names below
        flat = np.nonzero(d.ravel() >= np.partition(d.ravel(), d.size - k)[d.size - k])[0]
        flat = flat[np.isfinite(d.ravel()[flat])]
        if not len(flat):
            return pd.DataFrame()
        i, j = np.unravel_index(flat, d.shape)
        rows = sorted((-d[x, y], min(ia[x], jb[y]), max(ia[x], jb[y])) for x, y in zip(i, j))[:consider]
        return pd.DataFrame({"grp": [key[0]] * len(rows), "a": [r[1] for r in rows], "b": [r[2] for r in rows], "dist": [-r[0] for r in rows]})

    pairs = block_pairs(p, block, False).applyInPandas(in_tiles(far, block), "grp string, a string, b string, dist double")
    w = W.partitionBy("grp").orderBy(F.col("dist").desc(), "a", "b")
    top = cut_lineage(pairs.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= consider).drop("k"))
    va = p.select("grp", F.col("id").alias("a"), F.col("vec").alias("va"))
    vb = p.select("grp", F.col("id").alias("b"), F.col("vec").alias("vb"))
    top = top.join(va, ["grp", "a"]).join(vb, ["grp", "b"])
    n = p.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nb"))
    left = top.join(n, "grp").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nb")
    right = p.join(n, "grp").select(
        F.col("grp").alias("rgrp"), F.col("id").alias("rid"), F.col("vec").alias("rvec"), F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("rx")
    )

    def third(key, t: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(t) or not len(b):
            return pd.DataFrame()
        ids, vec = b["rid"].to_numpy(), stack(b["rvec"])
        d = distances(stack(t["va"]), vec, metric) + distances(stack(t["vb"]), vec, metric) + t["dist"].to_numpy()[:, None]
        d[(t["a"].to_numpy()[:, None] == ids[None, :]) | (t["b"].to_numpy()[:, None] == ids[None, :])] = -np.inf
        k = d.argmax(1)
        best = d[np.arange(len(t)), k]
        out = pd.DataFrame({"grp": key[0], "a": t["a"].to_numpy(), "b": t["b"].to_numpy(), "c": ids[k], "total": best})
        out = out[np.isfinite(best)]
        return out if len(out) else pd.DataFrame()

    x = left.groupBy("grp", "x").cogroup(right.groupBy("rgrp", "rx")).applyInPandas(third, "grp string, a string, b string, c string, total double")
    best = x.groupBy("grp").agg(F.max_by(F.array_sort(F.array("a", "b", "c")), F.struct(F.round("total", 9), "a", "b", "c")).alias("x"))
    return best.select(F.col("grp").alias("cluster"), *[F.col("x")[i].alias(f"rep{i + 1}") for i in range(3)])


def assign_leftout_to_cluster(pairs: DataFrame, representatives: DataFrame, linkage: str, threshold: float) -> DataFrame:
    """Attach left-out items to a cluster by their distances to three representatives.

    ``pairs`` is ``(a, b, dist)`` with ``a`` the item and ``b`` a representative;
    ``representatives`` is ``(b, cluster)``.
    """
    g = pairs.join(representatives, "b").groupBy("a", "cluster").agg(
        F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.avg("dist").alias("mean")
    )
    if linkage == "complete":
        ok, key = F.col("hi") < threshold, F.col("mean")
    elif linkage == "single":
        ok, key = F.col("lo") <= threshold, F.col("lo")
    else:
        ok, key = F.col("mean") <= threshold, F.col("mean")
    best = g.filter(ok).groupBy("a").agg(F.min_by("cluster", F.struct(key, F.col("cluster"))).alias("cluster"))
    return pairs.select("a").distinct().join(best, "a", "left").select("a", F.coalesce(F.col("cluster").cast("string"), F.lit("-1")).alias("cluster"))


# -------------------------------------------------------------------- reports
def cluster_size_histogram(clusters: DataFrame) -> DataFrame:
    """How many clusters have each size."""
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))


def cluster_reproducibility(clusters: DataFrame, matches: DataFrame | None = None, sep: str = "_") -> DataFrame:
    """Models and members per cluster of ``(name, cluster)``, with the best match ``(query, target, q)``."""
    model = F.substring_index("name", sep, -1)
    g = clusters.groupBy("cluster", model.alias("model")).agg(F.count(F.lit(1)).alias("n"))
    g = g.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("models"), F.count_if(F.col("n") > 1).alias("duplicated_models"), F.sum("n").alias("members")
    )
    if matches is None:
        return g
    best = matches.groupBy(F.col("query").alias("cluster")).agg(
        F.min_by("target", F.struct("q", "target")).alias("best_match"), F.min("q").alias("best_q")
    )
    return g.join(best, "cluster", "left")


def cluster_members(clusters: DataFrame) -> DataFrame:
    """Member list per cluster for reports on motif sets."""
    return clusters.groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


def subcluster_by_effect(effects: DataFrame, clusters: DataFrame, threshold: float, local: int = LOCAL) -> tuple[DataFrame, DataFrame]:
    """Complete linkage on correlation distance inside each cluster, and the mean effect row per new cluster.

    ``effects`` is ``(name, condition, effect)``; missing conditions are 0.
    """
    conds = effects.select("condition").distinct().agg(F.sort_array(F.collect_list("condition")).alias("conds"))
    packed = effects.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("condition", "effect"))).alias("m"))
    vec = F.transform("conds", lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0.0)))
    points = packed.join(F.broadcast(conds)).select("name", vec.alias("vec")).join(clusters, "name")
    labels = cluster_groups(
        points.select(F.col("cluster").alias("grp"), F.col("name").alias("id"), "vec"), "correlation", "complete", threshold, local=local
    ).select(F.col("id").alias("name"), F.col("grp").alias("cluster"), F.col("cluster").alias("subcluster"))
    n = labels.groupBy("cluster", "subcluster").agg(F.count(F.lit(1)).alias("n"))
    means = effects.join(labels, "name").groupBy("cluster", "subcluster", "condition").agg(F.sum("effect").alias("s")).join(
        n, ["cluster", "subcluster"]
    )
    return labels, means.select("cluster", "subcluster", "condition", (F.col("s") / F.col("n")).alias("effect"))


def merge_effects(effects: DataFrame, clusters: DataFrame, how: str = "mean") -> DataFrame:
    """Effect rows of merged motifs: mean or signed max-abs per (cluster, condition)."""
    agg = F.avg("effect") if how == "mean" else signed_maxabs("effect")
    return effects.join(clusters, "name").groupBy("cluster", "condition").agg(agg.alias("effect"))


def merge_similar_motifs(motifs: DataFrame, clusters: DataFrame, pairs: DataFrame, effects: DataFrame, how: str = "mean") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Consensus motifs, joined names and effect rows of motifs in one cluster."""
    from strandframe.operators.motifs import consensus_motif

    joined = consensus_motif(motifs, clusters.withColumnRenamed("name", "motif"), pairs)
    return joined, cluster_members(clusters), merge_effects(effects, clusters, how)


def order_by_hierarchy(points: DataFrame, metric: str = "correlation", linkage: str = "average", local: int = LOCAL) -> DataFrame:
    """Leaf order ``(id, leaf)`` of the whole tree for reports."""
    p = cut_lineage(points.select(F.lit("all").alias("grp"), F.col("id").cast("string").alias("id"), "vec"))
    merges = cut_lineage(merge_table(p, metric, linkage, None, local))
    return leaf_positions(p, merges).select("id", "leaf")
