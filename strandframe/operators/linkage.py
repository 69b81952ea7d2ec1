"""Hierarchical clustering as rounds of merges over tables.

Two clusters that are each other's nearest are merged; all such pairs of a round at once.
For single, complete and average linkage the merged cluster is never nearer to a third
one than both of its parts were, so rounds find the same tree as merging the closest
pair one after the other.  A cluster is named by its smallest member.  Distances between
clusters follow from their members (complete, average) or from the sums of unit
vectors (average of cosine and correlation distances); single linkage goes over a table
of the edges of a minimum spanning forest.  Groups up to ``local`` points run the same rounds on their own
matrix in one task, which bounds a task and changes no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.functions.ranking import ordinal_rank
from strandframe.operators import held
from strandframe.operators.distance import block_count, block_pairs, distances, in_tiles, stack, unit_rows
from strandframe.session import written

LOCAL = 5_000
TABLE = 2_000  # clusters of a group whose pairs come to one task as rows
MEMBERS = 40_000  # points that come to one task
HELD = 12_000_000  # numbers in vectors that every task holds at once
MERGES = "grp string, a string, b string, height double, round int"


# ------------------------------------------------------------- one matrix
def matrix_merges(d: np.ndarray, linkage: str, threshold: float | None = None, size: np.ndarray | None = None, step: int = 0) -> list[tuple[int, int, float, int]]:
    """Merges (i, j, height, round) of a distance matrix by rounds of mutual nearest neighbours; j joins the smaller i."""
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    names, size = np.arange(len(d)), np.ones(len(d)) if size is None else size.astype(float)
    out: list[tuple[int, int, float, int]] = []
    while len(d) > 1:
        near = d.argmin(1)
        height = d[np.arange(len(d)), near]
        i = np.flatnonzero((near[near] == np.arange(len(d))) & (np.arange(len(d)) < near) & (height < (np.inf if threshold is None else threshold)))
        if not len(i):
            break
        j = near[i]
        out += [(int(a), int(b), float(h), step) for a, b, h in zip(names[i], names[j], height[i])]
        for axis in (0, 1):
            x, y = np.take(d, i, axis), np.take(d, j, axis)
            if linkage == "single":
                new = np.minimum(x, y)
            elif linkage == "complete":
                new = np.where(np.isinf(x) | np.isinf(y), np.inf, np.maximum(x, y))
            else:
                si, sj = size[i], size[j]
                shape = (-1, 1) if axis == 0 else (1, -1)
                new = (si.reshape(shape) * x + sj.reshape(shape) * y) / (si + sj).reshape(shape)
            if axis == 0:
                d[i] = new
            else:
                d[:, i] = new
        size[i] += size[j]
        np.fill_diagonal(d, np.inf)
        keep = np.ones(len(d), bool)
        keep[j] = False
        d, names, size = d[keep][:, keep], names[keep], size[keep]
        step += 1
    return out


def local_merges(points: DataFrame, metric: str, linkage: str, threshold: float | None) -> DataFrame:
    """Merges of every group of ``(grp, id, vec)``, each in its own task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, vec = pdf["id"].to_numpy(), stack(pdf["vec"])
        d = distances(vec, vec, metric)
        found = matrix_merges((d + d.T) / 2, linkage, threshold)
        return pd.DataFrame([(pdf["grp"].iloc[0], ids[i], ids[j], h, r) for i, j, h, r in found], columns=["grp", "a", "b", "height", "round"])

    return points.groupBy("grp").applyInPandas(run, MERGES)


# ------------------------------------------------------------- tables
def _both(pairs: DataFrame) -> DataFrame:
    """Every pair from both of its ends."""
    return pairs.select("grp", "a", "b", "dist").unionByName(pairs.select("grp", F.col("b").alias("a"), F.col("a").alias("b"), "dist"))


def _mutual(near: DataFrame, threshold: float | None, step: int) -> DataFrame:
    """Merges of clusters that are each other's nearest, from ``(grp, a, dist, b)`` per cluster."""
    back = near.select("grp", F.col("a").alias("b"), F.col("b").alias("back"))
    pairs = near.join(back, ["grp", "b"]).where((F.col("back") == F.col("a")) & (F.col("a") < F.col("b")))
    pairs = pairs if threshold is None else pairs.where(F.col("dist") < threshold)
    return written(pairs.select("grp", "a", "b", F.col("dist").alias("height"), F.lit(step).alias("round")))


def _few(clusters: DataFrame, local: int) -> DataFrame:
    """Groups of ``(grp, id)`` with at most ``local`` clusters."""
    return written(clusters.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= local).select("grp"))


def _rest(linkage: str, threshold: float | None, at: int):
    """All further rounds of a group from its rows ``a, b, dist, na, nb``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf["a"], pdf["b"]]))
        i, j = np.searchsorted(ids, pdf["a"]), np.searchsorted(ids, pdf["b"])
        d, size = np.full((len(ids), len(ids)), np.inf), np.ones(len(ids))
        d[i, j] = d[j, i] = pdf["dist"]
        size[i], size[j] = pdf["na"], pdf["nb"]
        rows = [(pdf["grp"].iloc[0], ids[x], ids[y], h, r) for x, y, h, r in matrix_merges(d, linkage, threshold, size, at)]
        return pd.DataFrame(rows, columns=["grp", "a", "b", "height", "round"])

    return run


def table_merges(pairs: DataFrame, linkage: str, threshold: float | None = None, local: int = LOCAL) -> DataFrame:
    """``grp, a, b, height, round`` from cluster distances ``(grp, a, b, dist)`` with ``a < b``.

    A pair that is not in the table is too far to merge (single, complete); average
    linkage needs every pair of a group.  Each round joins the table to the new names and
    puts the rows of one pair of clusters together: the least, the largest (only where
    every part has a row) or the mean weighted by sizes.  The last ``local`` clusters of
    a group do their rounds in one task.
    """
    spark = pairs.sparkSession
    one = F.lit(1).cast("long")
    table = written(pairs.select("grp", "a", "b", "dist", one.alias("na"), one.alias("nb")))
    found, step = [], 0

    while not table.isEmpty():
        if local > 1:
            few = _few(_both(table).select("grp", "a").distinct(), local)
            if not few.isEmpty():
                found.append(written(table.join(few, "grp", "left_semi").groupBy("grp").applyInPandas(_rest(linkage, threshold, step), MERGES)))
                table = written(table.join(few, "grp", "left_anti"))
                continue
        near = _both(table).groupBy("grp", "a").agg(F.min(F.struct("dist", "b")).alias("x")).select("grp", "a", "x.dist", "x.b")
        merged = _mutual(near, threshold, step)
        if merged.isEmpty():
            break
        found.append(merged)
        # each part of a merged cluster brings its new name and the number of parts
        parts = merged.select("grp", F.col("b").alias("old"), F.col("a").alias("new")).unionByName(merged.select("grp", F.col("a").alias("old"), F.col("a").alias("new")))
        named = table
        for end in ("a", "b"):
            named = named.join(parts.select("grp", F.col("old").alias(end), F.col("new").alias(f"{end}_new")), ["grp", end], "left")
        parts_of = lambda end: F.when(F.col(f"{end}_new").isNull(), 1).otherwise(2)
        named = named.select(
            "grp", F.coalesce("a_new", "a").alias("x"), F.coalesce("b_new", "b").alias("y"), "dist", "na", "nb", parts_of("a").alias("pa"), parts_of("b").alias("pb")
        ).where("x <> y")
        turn = lambda one, two: F.when(F.col("x") > F.col("y"), F.col(two)).otherwise(F.col(one)).alias(one)
        named = named.select(
            "grp", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "dist", *(turn(*k) for k in (("na", "nb"), ("nb", "na"), ("pa", "pb"), ("pb", "pa")))
        )
        inside = F.col("na") * F.col("nb")
        value: Column = {"single": F.min("dist"), "complete": F.max("dist"), "average": F.sum(inside * F.col("dist")) / F.sum(inside)}[linkage]
        # a part of one side stands in as many rows as the other side has parts
        sizes = [(F.sum(n) / F.max(p)).cast("long").alias(n) for n, p in (("na", "pb"), ("nb", "pa"))]
        rows = named.groupBy("grp", "a", "b").agg(value.alias("dist"), *sizes, F.count(F.lit(1)).alias("rows"), F.max(F.col("pa") * F.col("pb")).alias("due"))
        rows = rows if linkage == "single" else rows.where("rows = due")
        table = written(rows.select("grp", "a", "b", "dist", "na", "nb"))
        step += 1
    return _all(spark, found, MERGES)


def _all(spark, frames: list[DataFrame], schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for f in frames:
        out = out.unionByName(f)
    return out


# ------------------------------------------------------------- sums of unit vectors
def mean_merges(points: DataFrame, metric: str, threshold: float | None = None, block: int = 2_000, local: int = LOCAL) -> DataFrame:
    """Average linkage of cosine or correlation distances without a pair table: ``grp, a, b, height, round``.

    The mean distance of two clusters is one less the product of their mean unit vectors, so a
    cluster is its sum and size.  A round compares blocks of clusters and only the nearest
    of each cluster leaves a task; the last ``local`` clusters of a group meet in one task.
    """
    spark = points.sparkSession

    def start(parts):
        for pdf in parts:
            yield pd.DataFrame({"grp": pdf["grp"], "id": pdf["id"], "vec": list(unit_rows(stack(pdf["vec"]), metric)), "n": np.ones(len(pdf), np.int64)})

    def nearest(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame()
        x, y = stack(a["vec"]) / a["n"].to_numpy(float)[:, None], stack(b["rvec"]) / b["rn"].to_numpy(float)[:, None]
        ia, ib = a["id"].to_numpy(), b["rid"].to_numpy()
        d = 1 - x @ y.T
        if key[1] == key[2]:
            d[ia[:, None] >= ib[None, :]] = np.inf
        rows = []
        for mine, other, m in ((ia, ib, d), (ib, ia, d.T)):
            order = np.argsort(other, kind="stable")  # of equal distances the smaller name
            k = m[:, order].argmin(1)
            h = m[np.arange(len(mine)), order[k]]
            ok = np.isfinite(h)
            rows.append(pd.DataFrame({"grp": key[0], "a": mine[ok], "dist": h[ok], "b": other[order[k]][ok]}))
        out = pd.concat(rows)
        return out if len(out) else pd.DataFrame()

    def rest(at: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            ids, n = pdf["id"].to_numpy(), pdf["n"].to_numpy(float)
            x = stack(pdf["vec"]) / n[:, None]
            rows = [(pdf["grp"].iloc[0], ids[i], ids[j], h, r) for i, j, h, r in matrix_merges(1 - x @ x.T, "average", threshold, n, at)]
            return pd.DataFrame(rows, columns=["grp", "a", "b", "height", "round"])

        return run

    state = written(points.select("grp", "id", "vec").mapInPandas(start, "grp string, id string, vec array<double>, n long"))
    found, step = [], 0
    while not state.isEmpty():
        few = _few(state.select("grp", "id"), max(local, 1))
        if not few.isEmpty():
            found.append(written(state.join(few, "grp", "left_semi").groupBy("grp").applyInPandas(rest(step), MERGES)))
            state = written(state.join(few, "grp", "left_anti"))
            continue
        best = block_pairs(state, block, False, extra=("n",)).applyInPandas(in_tiles(nearest, block), "grp string, a string, dist double, b string")
        near = best.groupBy("grp", "a").agg(F.min(F.struct("dist", "b")).alias("x")).select("grp", "a", "x.dist", "x.b")
        merged = _mutual(near, threshold, step)
        if merged.isEmpty():
            break
        found.append(merged)
        to = merged.select("grp", F.col("b").alias("id"), F.col("a").alias("to"))
        named = state.join(to, ["grp", "id"], "left").select("grp", F.coalesce("to", "id").alias("id"), "vec", "n")
        parts = named.groupBy("grp", "id").agg(F.collect_list("vec").alias("v"), F.sum("n").alias("n"))  # one vector or two
        plus = F.zip_with(F.col("v")[0], F.col("v")[1], lambda x, y: x + y)
        state = written(parts.select("grp", "id", F.when(F.size("v") == 2, plus).otherwise(F.col("v")[0]).alias("vec"), "n"))
        step += 1
    return _all(spark, found, MERGES)


# ------------------------------------------------------------- members of clusters
CELLS = 1 << 22  # numbers in a matrix of a task


def _between(a: pd.DataFrame, b: pd.DataFrame, metric: str, linkage: str):
    """Cluster distances from members ``c, vec`` to ``rc, rvec``: names and sizes of some clusters of ``a``, of all of ``b``, their matrix."""
    a, b = a.sort_values("c"), b.sort_values("rc")
    ca, begin, na = np.unique(a["c"].to_numpy(), return_index=True, return_counts=True)
    cb, cuts, nb = np.unique(b["rc"].to_numpy(), return_index=True, return_counts=True)
    x, y = stack(a["vec"]), stack(b["rvec"])
    put = np.maximum if linkage == "complete" else np.add
    rows = max(1, CELLS // (len(y) * (y.shape[1] if metric == "cityblock" else 1)))
    some = max(1, CELLS // len(cb))
    for lo in range(0, len(ca), some):
        hi = min(lo + some, len(ca))
        out = np.full((hi - lo, len(cb)), -np.inf if linkage == "complete" else 0.0)
        last = begin[hi - 1] + na[hi - 1]
        of = np.repeat(np.arange(hi - lo), na[lo:hi])
        for at in range(begin[lo], last, rows):
            to = min(at + rows, last)
            who = of[at - begin[lo] : to - begin[lo]]
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            part = put.reduceat(put.reduceat(distances(x[at:to], y, metric), cuts, axis=1), first, axis=0)
            out[who[first]] = put(out[who[first]], part)
        yield ca[lo:hi], na[lo:hi], cb, nb, out if linkage == "complete" else out / (na[lo:hi, None] * nb[None, :])


def member_merges(points: DataFrame, metric: str, linkage: str, threshold: float | None = None, block: int = 2_000, local: int = LOCAL) -> DataFrame:
    """Complete or average linkage of any distance without a pair table: ``grp, a, b, height, round``.

    A point carries the name of its cluster, and the distance of two clusters comes from their members,
    block by block.  A merged cluster is not nearer to a third one than its parts were, so a cluster
    keeps its nearest one until that or itself is merged; only the others are compared again.
    """
    spark = points.sparkSession

    def nearest(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame()
        found = []
        for ca, _, cb, _, d in _between(a, b, metric, linkage):
            own = np.minimum(np.searchsorted(cb, ca), len(cb) - 1)
            same = np.flatnonzero(cb[own] == ca)
            d[same, own[same]] = np.inf
            k = d.argmin(1)  # of equal distances the smaller name
            h = d[np.arange(len(ca)), k]
            ok = np.isfinite(h)
            found.append(pd.DataFrame({"grp": key[0], "a": ca[ok], "dist": h[ok], "b": cb[k[ok]]}))
        out = pd.concat(found)
        return out if len(out) else pd.DataFrame()

    def pairs(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame()
        found = []
        for ca, na, cb, nb, d in _between(a, b, metric, linkage):
            i, j = np.nonzero(ca[:, None] < cb[None, :])
            found.append(pd.DataFrame({"grp": key[0], "a": ca[i], "b": cb[j], "dist": d[i, j], "na": na[i], "nb": nb[j]}))
        out = pd.concat(found)
        return out if len(out) else pd.DataFrame()

    def rest(at: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            parts = list(_between(pdf, pdf.rename(columns={"c": "rc", "vec": "rvec"}), metric, linkage))
            ids, size, d = parts[0][2], parts[0][3], np.concatenate([x[4] for x in parts])
            rows = [(pdf["grp"].iloc[0], ids[x], ids[y], h, r) for x, y, h, r in matrix_merges((d + d.T) / 2, linkage, threshold, size, at)]
            return pd.DataFrame(rows, columns=["grp", "a", "b", "height", "round"])

        return run

    def meet(left: DataFrame, right: DataFrame):
        """Blocks of whole clusters of both sides, keyed for a co-group."""
        side = lambda df: df.groupBy("grp").agg(block_count(F.count(F.lit(1)), block).alias("n"))
        n = F.broadcast(side(left).withColumnRenamed("n", "nx").join(side(right).withColumnRenamed("n", "ny"), "grp"))
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        l = left.join(n, "grp").select("grp", "c", "vec", F.pmod(F.xxhash64("c"), F.col("nx")).cast("int").alias("x"), upto("ny").alias("y"))
        r = right.join(n, "grp").select(
            F.col("grp").alias("rgrp"), F.col("c").alias("rc"), F.col("vec").alias("rvec"), F.pmod(F.xxhash64("c"), F.col("ny")).cast("int").alias("ry"), upto("nx").alias("rx")
        )
        return l.groupBy("grp", "x", "y").cogroup(r.groupBy("rgrp", "rx", "ry"))

    state = written(points.select("grp", F.col("id").alias("c"), "vec"))
    todo = state.select("grp", "c").distinct()
    near, found, step = spark.createDataFrame([], "grp string, a string, dist double, b string"), [], 0
    while not state.isEmpty():
        counts = written(state.groupBy("grp", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")))
        few = counts.where((F.col("k") <= max(local, 1)) & ((F.col("n") <= MEMBERS) | (F.col("k") <= TABLE)))
        if not few.isEmpty():
            small = state.join(few.where(F.col("n") <= MEMBERS).select("grp"), "grp", "left_semi")
            found.append(written(small.groupBy("grp").applyInPandas(rest(step), MERGES)))
            last = state.join(few.where(F.col("n") > MEMBERS).select("grp"), "grp", "left_semi")
            table = meet(last, last).applyInPandas(pairs, "grp string, a string, b string, dist double, na long, nb long")
            found.append(written(table.groupBy("grp").applyInPandas(_rest(linkage, threshold, step), MERGES)))
            few = few.select("grp")
            state = written(state.join(few, "grp", "left_anti"))
            near, todo = near.join(few, "grp", "left_anti"), todo.join(few, "grp", "left_anti")
            continue
        new = meet(state.join(todo, ["grp", "c"], "left_semi"), state).applyInPandas(nearest, "grp string, a string, dist double, b string")
        new = new.groupBy("grp", "a").agg(F.min(F.struct("dist", "b")).alias("x")).select("grp", "a", "x.dist", "x.b")
        near = written(near.unionByName(new))
        merged = _mutual(near, threshold, step)
        if merged.isEmpty():
            # equal distances may differ in the last digit, so that no two clusters choose each other: the closest pair is right as well
            close = near.groupBy("grp").agg(F.min(F.struct("dist", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).alias("x"))
            close = close if threshold is None else close.where(F.col("x.dist") < threshold)
            merged = written(close.select("grp", "x.a", "x.b", F.col("x.dist").alias("height"), F.lit(step).alias("round")))
            if merged.isEmpty():
                break
        found.append(merged)
        to = merged.select("grp", F.col("b").alias("c"), F.col("a").alias("to"))
        state = written(state.join(to, ["grp", "c"], "left").select("grp", F.coalesce("to", "c").alias("c"), "vec"))
        gone = merged.select("grp", F.explode(F.array("a", "b")).alias("name"))
        kept = near.join(gone.withColumnRenamed("name", "a"), ["grp", "a"], "left_anti")
        still = kept.join(gone.withColumnRenamed("name", "b"), ["grp", "b"], "left_anti").select("grp", "a", "dist", "b")
        if threshold is not None:  # what has nothing under the threshold never merges
            still = still.where(F.col("dist") < threshold).unionByName(kept.where(F.col("dist") >= threshold))
        near = written(still)
        todo = written(state.select("grp", "c").distinct().join(near.select("grp", F.col("a").alias("c")), ["grp", "c"], "left_anti"))
        step += 1
    return _all(spark, found, MERGES)


# ------------------------------------------------------------- vectors held by every task
def held_merges(points: DataFrame, metric: str, linkage: str, threshold: float | None = None, local: int = LOCAL) -> DataFrame:
    """Complete or average linkage of groups whose vectors fit in every task: ``grp, a, b, height, round``.

    The driver keeps the nearest clusters of every cluster and the tasks search for them (``held``); the last
    clusters of a group, ``TABLE`` or ``local``, go on as one matrix.
    """
    spark = points.sparkSession
    table = points.where("id IS NOT NULL").select("grp", "id", "vec").toArrow()
    names = table.select(["grp", "id"]).to_pandas()
    vectors = table["vec"].combine_chunks()
    if vectors.null_count or vectors.flatten().null_count:
        raise ValueError("vectors must not be null")
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1)
    names = names.sort_values(["grp", "id"], kind="stable")
    x = [x[names.index.to_numpy()]]
    del table, vectors
    grp, ids = names["grp"].to_numpy(), names["id"].to_numpy()
    new = np.r_[True, grp[1:] != grp[:-1]]
    bounds = np.r_[np.flatnonzero(new), len(names)]
    first = np.flatnonzero(new | np.r_[True, ids[1:] != ids[:-1]])
    label = np.repeat(first, np.diff(np.r_[first, len(names)]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = held.merges(spark, x, bounds, label, metric, linkage, threshold, parts, min(local, TABLE))
    if not found:
        return spark.createDataFrame([], MERGES)
    i, j, height, step = (np.concatenate([f[k] for f in found]) for k in range(4))
    rows = pa.table({"grp": pa.array(grp[i], pa.string()), "a": pa.array(ids[i], pa.string()), "b": pa.array(ids[j], pa.string()), "height": height, "round": pa.array(step, pa.int32())})
    return written(spark.createDataFrame(rows, MERGES))


# ------------------------------------------------------------- spanning forest
def spanning_forest(points: DataFrame, metric: str, block: int = 2_000) -> DataFrame:
    """Edges ``(grp, a, b, dist)`` of a minimum spanning tree of every group.

    In each round every tree takes its shortest edge to another one, found block by
    block; of equal edges the one with the smaller names, so that no circle closes.
    """
    def shortest(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame()
        a, b = a.sort_values("id"), b.sort_values("rid")
        d = distances(stack(a["vec"]), stack(b["rvec"]), metric)
        ia, ib, ta, tb = a["id"].to_numpy(), b["rid"].to_numpy(), a["tree"].to_numpy(), b["rtree"].to_numpy()
        d[ta[:, None] == tb[None, :]] = np.inf
        if key[1] == key[2]:
            d[ia[:, None] >= ib[None, :]] = np.inf
        rows = []
        for mine, trees, other, others, m in ((ia, ta, ib, tb, d), (ib, tb, ia, ta, d.T)):
            k = m.argmin(1)
            h = m[np.arange(len(trees)), k]
            one = pd.DataFrame({"tree": trees, "dist": h, "a": np.where(mine < other[k], mine, other[k]), "b": np.where(mine < other[k], other[k], mine), "other": others[k]})
            rows.append(one[np.isfinite(h)])
        out = pd.concat(rows).sort_values(["tree", "dist", "a", "b"]).drop_duplicates("tree")
        out.insert(0, "grp", key[0])
        return out if len(out) else pd.DataFrame()

    spark = points.sparkSession
    state = written(points.select("grp", "id", "vec").withColumn("tree", F.col("id")))
    found = []
    while True:
        best = block_pairs(state, block, False, extra=("tree",)).applyInPandas(in_tiles(shortest, block), "grp string, tree string, dist double, a string, b string, other string")
        near = written(best.groupBy("grp", "tree").agg(F.min(F.struct("dist", "a", "b", "other")).alias("x")).select("grp", "tree", "x.*"))
        if near.isEmpty():
            return _all(spark, found, "grp string, a string, b string, dist double")
        found.append(near.select("grp", "a", "b", "dist").distinct())
        # every tree points at the one its edge leads to; of two that point at each other the smaller is the root
        back = near.select("grp", F.col("tree").alias("other"), F.col("other").alias("theirs"))
        up = near.join(back, ["grp", "other"]).select(
            "grp", "tree", F.when((F.col("theirs") == F.col("tree")) & (F.col("tree") < F.col("other")), F.col("tree")).otherwise(F.col("other")).alias("up")
        )
        up = written(up.withColumn("moved", F.lit(True)))
        while not up.where("moved").isEmpty():
            over = up.select("grp", F.col("tree").alias("up"), F.col("up").alias("next"))
            up = written(up.join(over, ["grp", "up"]).select("grp", "tree", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
        state = written(state.join(up, ["grp", "tree"], "left").select("grp", "id", "vec", F.coalesce("up", "tree").alias("tree")))


def keyed_name(grp: str, name: str) -> Column:
    """One string for a group and a name inside it."""
    return F.concat_ws("\u0001", grp, name)


def plain_name(key: str) -> Column:
    return F.substring_index(key, "\u0001", -1)


# ------------------------------------------------------------- all kinds
def merge_table(
    points: DataFrame, metric: str, linkage: str, threshold: float | None = None, local: int = LOCAL, block: int = 2_000, most: int = HELD
) -> DataFrame:
    """All merges ``(grp, a, b, height, round)`` of the points ``(grp, id, vec)`` of every group, under ``threshold`` if given.

    ``a`` and ``b`` are the smallest members of the clusters that merge, ``a < b``.  No linkage holds a
    row per pair of points.  While the vectors of all groups over ``local`` have up to ``most`` numbers, every task
    holds them; beyond that rounds go over tables, where complete linkage, and average linkage of distances that are
    not products, compare members again for the clusters whose nearest one was merged.
    """
    if linkage not in ("single", "complete", "average"):
        raise ValueError(linkage)
    n = points.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    sized = points.join(n, "grp")
    small = local_merges(sized.where((F.col("n") > 1) & (F.col("n") <= local)).drop("n"), metric, linkage, threshold)
    large = written(sized.where(F.col("n") > local).where("n > 1").drop("n"))
    if large.isEmpty():
        return small
    if linkage != "single" and large.agg(F.sum(F.size("vec").cast("long"))).first()[0] <= most:
        return small.unionByName(held_merges(large, metric, linkage, threshold, local))
    if linkage == "average" and metric in ("cosine", "correlation"):
        return small.unionByName(mean_merges(large, metric, threshold, block, local))
    if linkage != "single":
        return small.unionByName(member_merges(large, metric, linkage, threshold, block, local))
    pairs = spanning_forest(large, metric, block)
    pairs = pairs if threshold is None else pairs.where(F.col("dist") < threshold)
    return small.unionByName(table_merges(pairs, linkage, threshold, local))


def lowest_merges(merges: DataFrame, keep: DataFrame) -> DataFrame:
    """The ``keep`` (grp, keep) lowest merges of every group; of equal heights those of earlier rounds, then in hash order."""
    # a parent is never lower than its parts, and of equal height only in a later round
    order = F.shiftleft(F.col("round").cast("long"), 40) + F.shiftrightunsigned(F.xxhash64("a", "b"), 24)
    ordered = merges.select("grp", "a", "b", "height", order.alias("t"))
    ranked = ordinal_rank(ordered, ["grp"], "height", "t", "r")
    return ranked.join(keep, "grp").where("r < keep").select("grp", "a", "b", "height")


def leaf_positions(points: DataFrame, merges: DataFrame) -> DataFrame:
    """``grp, id, leaf``: places of the points when members of every merge stand side by side, the cluster with the smaller name first.

    Every cluster of the tree knows its parent and how far it begins after it (the size of
    its left sibling, or 0).  Distances to the root are added up by doubling: in each
    round a node adds what its present ancestor has and moves on to that one's ancestor.
    """
    side = lambda name, right: F.struct(F.col(name).alias("id"), F.lit(right).alias("right"))
    uses = merges.select("grp", "a", "round", F.explode(F.array(side("a", 0), side("b", 1))).alias("u")).select("grp", "a", "round", "u.*")
    # a node is a name and the round that made it (-1: a point); a name is used once a round at most
    made = F.coalesce(F.lag("round").over(W.partitionBy("grp", "id").orderBy("round")), F.lit(-1))
    node = F.struct("grp", "id", made.alias("at")).alias("node")
    tree = written(uses.select(node, F.struct("grp", F.col("a").alias("id"), F.col("round").alias("at")).alias("parent"), "right"))
    roots = points.select("grp", "id")
    size = _subtree_sizes(tree, roots)
    left = tree.where("right = 0").join(size, "node").select("parent", F.col("n").alias("before"))
    steps = tree.join(left, "parent").select("node", F.col("parent").alias("up"), F.when(F.col("right") == 1, F.col("before")).otherwise(0).cast("long").alias("add"))
    top = tree.select(F.col("parent").alias("node")).distinct().join(tree.select("node"), "node", "left_anti")
    alone = roots.select(F.struct("grp", "id", F.lit(-1).alias("at")).alias("node")).join(tree.select("node"), "node", "left_anti")
    ends = top.unionByName(alone).distinct()
    state = written(steps.unionByName(ends.select("node", F.lit(None).cast(steps.schema["up"].dataType).alias("up"), F.lit(0).cast("long").alias("add"))))
    while not state.where(F.col("up").isNotNull()).isEmpty():
        other = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("add").alias("more"))
        moved = state.join(other, "up", "left").select("node", F.col("next").alias("up"), (F.col("add") + F.coalesce("more", F.lit(0))).alias("add"))
        state = written(moved)
    return state.where("node.at = -1").select("node.grp", "node.id", F.col("add").alias("leaf"))


def _subtree_sizes(tree: DataFrame, points: DataFrame) -> DataFrame:
    """``node, n``: leaves under every node, by doubling the paths to the root from every leaf's count."""
    leaves = points.select(F.struct("grp", "id", F.lit(-1).alias("at")).alias("node"), F.lit(1).cast("long").alias("n"))
    inner = tree.select(F.col("parent").alias("node")).distinct().select("node", F.lit(0).cast("long").alias("n"))
    own = leaves.unionByName(inner)
    up = tree.select("node", F.col("parent").alias("to"))
    total, reach = written(own), written(up)
    # after round k a node holds the leaves at most 2^k - 1 steps below it
    while not reach.isEmpty():
        sent = reach.join(total, "node").select(F.col("to").alias("node"), "n")
        total = written(total.unionByName(sent).groupBy("node").agg(F.sum("n").alias("n")))
        next_up = reach.select(F.col("node").alias("to"), F.col("to").alias("far"))
        reach = written(reach.join(next_up, "to").select("node", F.col("far").alias("to")))
    return total
