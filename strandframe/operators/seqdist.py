"""Distances between sequences without comparing all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.operators.blocks import against_reference
from strandframe.operators.cells import nearest_in_cells
from strandframe.operators.cluster import distances
from strandframe.session import small_enough, written


def _segments(seq: Column, k: int) -> Column:
    """The ``k + 1`` near-equal parts of a string with their number and 0-based start."""
    n = F.length(seq)
    parts = []
    for i in range(k + 1):
        lo, hi = F.floor(n * i / (k + 1)).cast("int"), F.floor(n * (i + 1) / (k + 1)).cast("int")
        parts.append(F.struct(F.lit(i).alias("part"), F.substr(seq, lo + 1, hi - lo).alias("seg")))
    return F.array(*parts)


def _probes(k: int, slack: int) -> str:
    """Substrings of ``seq`` that could equal part i of a string with length ``len``: SQL expression."""
    n = k + 1
    return (
        f"flatten(transform(sequence(greatest(length(seq) - {slack}, 0), length(seq)), L -> flatten(transform(sequence(0, {k}), i -> "
        f"transform(array_distinct(transform(sequence(-{slack}, {slack}), d -> substring(seq, cast(floor(L * i / {n}) as int) + d + 1, "
        f"if(cast(floor(L * i / {n}) as int) + d < 0, 0, cast(floor(L * (i + 1) / {n}) as int) - cast(floor(L * i / {n}) as int))))), "
        "s -> struct(L as len, i as part, s as seg))))))"
    )


def pairwise_sequence_distance(seqs: DataFrame, max_distance: int, metric: str = "edit") -> DataFrame:
    """Pairs of distinct sequences within ``max_distance`` edits (``edit``) or mismatches at equal length (``identity``).

    Exact by the pigeonhole rule: a string cut into k + 1 parts keeps at least one part whole
    after k edits, shifted by at most k.  Copies are counted first: the result is
    ``(a, b, distance)`` on one name per distinct sequence; ``copies`` gives the others.
    """
    k = max_distance
    d = seqs.groupBy("seq").agg(F.min("name").alias("name")).withColumn("n", F.length("seq"))
    key = F.xxhash64("len", "part", "seg").alias("key")
    index = d.select("name", "n", F.col("n").alias("len"), F.inline(_segments(F.col("seq"), k))).select(F.col("name").alias("a"), F.col("n").alias("na"), key)
    if metric == "edit":
        probe = d.select("name", "n", F.explode(F.expr(_probes(k, k))).alias("x")).select("name", "n", "x.*")
        probe = probe.select(F.col("name").alias("b"), F.col("n").alias("nb"), key).distinct()
    elif metric == "identity":
        probe = index.toDF("b", "nb", "key")
    else:
        raise ValueError(metric)
    # each unordered pair once: the shorter string is indexed, equal lengths are ordered by name;
    # only names and part hashes are shuffled, the texts of candidate pairs are joined after
    cand = index.join(probe, "key").filter((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    cand = cand.select("a", "b").distinct()
    cand = cand.join(d.select(F.col("name").alias("a"), F.col("seq").alias("sa")), "a")
    cand = cand.join(d.select(F.col("name").alias("b"), F.col("seq").alias("sb")), "b")
    if metric == "edit":
        dist = F.levenshtein("sa", "sb", k)
    else:
        same = F.zip_with(F.split("sa", ""), F.split("sb", ""), lambda x, y: (x != y).cast("int"))
        dist = F.aggregate(same, F.lit(0), lambda s, x: s + x)
        cand = cand.filter(F.length("sa") == F.length("sb"))
    out = cand.select("a", "b", dist.alias("distance")).filter((F.col("distance") >= 0) & (F.col("distance") <= k))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("distance").cast("int").alias("distance"))


def copies(seqs: DataFrame) -> DataFrame:
    """Every name with the smallest name of the same sequence and the number of copies."""
    g = seqs.groupBy("seq").agg(F.min("name").alias("first"), F.count(F.lit(1)).alias("n"))
    return seqs.join(g, "seq").select("name", "first", "n")


def kmer_vectors(counts: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Dense vectors ``(name, vec)`` over a fixed k-mer list from ``(name, kmer, cnt)``."""
    m = counts.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("kmer", F.col("cnt").cast("double")))).alias("m"))
    vocab = F.array(*[F.lit(v) for v in vocabulary])
    return m.select("name", F.transform(vocab, lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0.0))).alias("vec"))


def nearest_distances(points: DataFrame, reference: DataFrame | None = None, metric: str = "euclidean", bound: int = 5_000) -> DataFrame:
    """Distance of each point ``(name, vec)`` to the nearest member of another set, or of its own set.

    In its own set equal vectors are counted first: a vector with a copy has distance 0, and only
    distinct vectors are compared; more than ``bound`` of them by cells (euclidean).
    """
    own, best = reference is None, None
    if own:
        points = written(points.select("name", "vec"))  # read twice or more below
        g = written(points.groupBy("vec").agg(F.count(F.lit(1)).alias("c"), F.min("name").alias("name")))
        if metric == "euclidean" and not small_enough(g, bound):
            best = nearest_in_cells(g.select("name", "vec"), min(bound, 2_000))
        left = g.select("name", "vec", "c")
        right = g.select(F.col("name").alias("rname"), F.col("vec").alias("rvec"))
    else:
        left = points.select("name", "vec", F.lit(1).alias("c"))
        right = reference.select(F.col("name").alias("rname"), F.col("vec").alias("rvec"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x = np.array([np.asarray(v, float) for v in a["vec"]])
        y = np.array([np.asarray(v, float) for v in b["rvec"]])
        d = distances(x, y, metric)
        if own:
            d[a["name"].to_numpy()[:, None] == b["rname"].to_numpy()[None, :]] = np.inf
        return pd.DataFrame({"name": a["name"].to_numpy(), "d": d.min(1)})

    if best is None:
        near = against_reference(left.select("name", "vec"), right, compare, "name string, d double", "name", "rname", bound=bound)
        best = near.groupBy("name").agg(F.min("d").alias("d"))
    if not own:
        return best.select("name", F.col("d").alias("distance"))
    scored = left.join(best, "name").select("vec", F.when(F.col("c") > 1, 0.0).otherwise(F.col("d")).alias("distance"))
    return points.join(scored, "vec").select("name", "distance")
