"""Distances between points: block by block, and pairs under a threshold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_rows(a: np.ndarray, metric: str) -> np.ndarray:
    """Rows whose products are one less the cosine or correlation distance; a row without direction is zero."""
    if metric == "correlation":
        a = a - a.mean(1, keepdims=True)
    n = np.linalg.norm(a, axis=1)
    return a / np.where(n == 0, 1, n)[:, None]


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distance matrix of two row blocks."""
    if metric in ("correlation", "cosine"):
        return 1 - unit_rows(a, metric) @ unit_rows(b, metric).T
    if metric == "euclidean":
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        return np.sqrt(np.maximum(d, 0))
    if metric == "cityblock":
        return np.abs(a[:, None, :] - b[None, :, :]).sum(-1)
    raise ValueError(metric)


def stack(col: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=float) for v in col])


# Blocks of a group up to which more points make more blocks, and tiles of a block beyond that.
BLOCKS, TILES = 8, 32


def block_count(n: Column, block: int) -> Column:
    """Number of blocks of ``n`` rows."""
    return F.greatest(F.least(F.ceil(n / block), F.lit(BLOCKS)), F.ceil(n / (TILES * block))).cast("int")


def block_pairs(points: DataFrame, block: int, both: bool, extra: tuple[str, ...] = ()):
    """Both sides of every pair of blocks of a group, keyed for a co-group; ``extra`` columns come along.

    Every point is sent once per block, so blocks are few: ``BLOCKS`` of a large group, until one holds ``TILES``
    times ``block`` points.  Work on them goes by ``in_tiles``.
    """
    n = points.groupBy("grp").agg(block_count(F.count(F.lit(1)), block).alias("nb"))
    p = points.join(n, "grp").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    first, last = (F.lit(0), F.col("nb") - 1) if both else (F.col("blk"), F.col("nb") - 1)
    left = p.select("grp", "id", "vec", *extra, F.col("blk").alias("x"), F.explode(F.sequence(first, last)).alias("y"))
    right = p.select(
        F.col("grp").alias("rgrp"), F.col("id").alias("rid"), F.col("vec").alias("rvec"), *(F.col(c).alias(f"r{c}") for c in extra), F.col("blk").alias("ry"),
        F.explode(F.sequence(F.lit(0), F.col("nb") - 1 if both else F.col("blk"))).alias("rx"),
    )
    return left.groupBy("grp", "x", "y").cogroup(right.groupBy("rgrp", "rx", "ry"))


def in_tiles(compare, block: int):
    """``compare(key, a, b)`` over tiles of ``block`` rows of both sides, so that no matrix is larger."""

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        cuts = [(x, y) for x in range(0, len(a), block) for y in range(0, len(b), block)]
        found = [compare(key, a.iloc[x : x + block], b.iloc[y : y + block]) for x, y in cuts]
        found = [x for x in found if len(x)]
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame()

    return run


def near_pairs(points: DataFrame, metric: str, threshold: float, block: int = 2_000) -> DataFrame:
    """Pairs ``(grp, a, b, dist)`` with ``a < b`` and distance under the threshold.

    ``points`` is ``(grp, id, vec)``.  Each pair of blocks of a group is one unit of work, so a
    large group is spread over many tasks and only close pairs leave them.
    """

    def pairs(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame()
        d = distances(stack(a["vec"]), stack(b["rvec"]), metric)
        i, j = np.nonzero(d < threshold)
        ia, jb = a["id"].to_numpy()[i], b["rid"].to_numpy()[j]
        if not len(ia):
            return pd.DataFrame()
        keep = ia < jb if key[1] == key[2] else ia != jb
        lo, hi = np.where(ia[keep] < jb[keep], ia[keep], jb[keep]), np.where(ia[keep] < jb[keep], jb[keep], ia[keep])
        out = pd.DataFrame({"grp": [key[0]] * len(lo), "a": lo, "b": hi, "dist": d[i, j][keep]})
        return out if len(out) else pd.DataFrame()

    return block_pairs(points, block, False).applyInPandas(in_tiles(pairs, block), "grp string, a string, b string, dist double")
