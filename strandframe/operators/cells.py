"""Nearest other point of every point of one set, by cells of a tree over the principal axes.

A point is compared with its own cell, and then with those cells only whose box, in the directions of the axes,
is not farther than the nearest point found so far.  The tree comes from some of the points, which decides how the
points are dealt out and no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators.blocks import spread
from strandframe.operators.distance import distances, stack
from strandframe.session import written

SAMPLE = 20_000  # points from which the tree is made
TILE = (512, 4_096)


def tree_of(x: np.ndarray, levels: int) -> tuple:
    """Halves of the points along the widest axis, ``levels`` times: centre, axes, and every node's axis and cut."""
    center = x.mean(0)
    axes = np.linalg.eigh((x - center).T @ (x - center))[1]
    z = (x - center) @ axes
    axis, cut = np.zeros(2**levels - 1, np.int64), np.full(2**levels - 1, np.inf)
    rows = {0: np.arange(len(x))}
    for node in range(2**levels - 1):
        mine = rows.pop(node)
        if len(mine):
            lo, hi = np.quantile(z[mine], [0.05, 0.95], axis=0)
            axis[node] = (hi - lo).argmax()
            cut[node] = np.median(z[mine, axis[node]])
        right = z[mine, axis[node]] > cut[node]
        rows[2 * node + 1], rows[2 * node + 2] = mine[~right], mine[right]
    return center, axes, axis, cut


def turned(tree: tuple, x: np.ndarray) -> np.ndarray:
    return (x - tree[0]) @ tree[1]


def cells_of(tree: tuple, x: np.ndarray) -> np.ndarray:
    z, node = turned(tree, x), np.zeros(len(x), np.int64)
    while len(node) and node[0] < len(tree[3]):  # all leaves are equally deep
        node = 2 * node + 1 + (z[np.arange(len(x)), tree[2][node]] > tree[3][node])
    return node - len(tree[3])


def _least(x: np.ndarray, y: np.ndarray, own: bool) -> np.ndarray:
    """Euclidean distance of each row to the nearest one of the other side; in its own set a row is not compared with itself."""
    out = np.full(len(x), np.inf)
    for a in range(0, len(x), TILE[0]):
        for b in range(0, len(y), TILE[1]):
            d = distances(x[a : a + TILE[0]], y[b : b + TILE[1]], "euclidean")
            if own:
                i = np.arange(max(a, b), min(a + len(d), b + d.shape[1]))
                d[i - a, i - b] = np.inf
            out[a : a + TILE[0]] = np.minimum(out[a : a + TILE[0]], d.min(1))
    return out


def nearest_in_cells(points: DataFrame, cell: int = 2_000, most: int = 32, queries: int = 20_000) -> DataFrame | None:
    """``(name, d)`` for ``(name, vec)`` with every name once; None where points reach ``most`` cells or more on average.

    A task holds one cell and up to about ``queries`` points that reach it.
    """
    n = points.count()
    some = stack(points.where(F.pmod(F.xxhash64("name", F.lit(1)), F.lit(max(1, n // SAMPLE))) == 0).select("vec").toPandas()["vec"])
    levels = min(math.ceil(math.log2(max(n / cell, 1))), int(math.log2(max(len(some) / 4, 1))))
    if not levels or some.ndim != 2 or not np.isfinite(some).all():
        return None
    tree = points.sparkSession.sparkContext.broadcast(tree_of(some, levels))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                yield pdf.assign(cell=cells_of(tree.value, stack(pdf["vec"])).astype(np.int32))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        x = stack(pdf["vec"])
        return pdf.assign(d=_least(x, x, True))

    def boxes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for c, mine in pdf.groupby("cell"):
                z = turned(tree.value, stack(mine["vec"]))
                yield pd.DataFrame({"cell": [c], "lo": [z.min(0)], "hi": [z.max(0)]})

    placed = points.select("name", "vec").mapInPandas(place, "name string, vec array<double>, cell int")
    own = written(spread(placed, "cell").groupBy("cell").applyInPandas(inside, "name string, vec array<double>, cell int, d double"))
    got = own.mapInPandas(boxes, "cell int, lo array<double>, hi array<double>").toPandas()
    lo, hi = np.full((2**levels, some.shape[1]), np.inf), np.full((2**levels, some.shape[1]), -np.inf)
    np.minimum.at(lo, got["cell"].to_numpy(), stack(got["lo"]))
    np.maximum.at(hi, got["cell"].to_numpy(), stack(got["hi"]))
    shared = points.sparkSession.sparkContext.broadcast((lo, hi))

    def reach(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lo, hi = shared.value
        used = np.flatnonzero(np.isfinite(lo).all(1))
        slack = 1e-9 * max(np.abs(lo[used]).max(), np.abs(hi[used]).max())  # of the turned coordinates
        for pdf in parts:
            if not len(pdf):
                continue
            z, d, at = turned(tree.value, stack(pdf["vec"])), pdf["d"].to_numpy() * (1 + 1e-9) + slack, pdf["cell"].to_numpy()
            to: list[list[int]] = [[] for _ in range(len(pdf))]
            for c in np.unique(at):
                mine = np.flatnonzero(at == c)
                apart = np.maximum(0, np.maximum(lo[used] - hi[c], lo[c] - hi[used]))
                for other in used[(np.sqrt((apart * apart).sum(1)) <= d[mine].max()) & (used != c)]:
                    gap = np.maximum(0, np.maximum(lo[other] - z[mine], z[mine] - hi[other]))
                    for row in mine[np.sqrt((gap * gap).sum(1)) <= d[mine]].tolist():
                        to[row].append(int(other))
            yield pdf.assign(to=to)

    found = written(own.mapInPandas(reach, "name string, vec array<double>, cell int, d double, to array<int>"))
    load = found.select(F.explode("to").alias("to")).groupBy("to").agg(F.count(F.lit(1)).alias("n"))
    load = written(load.select("to", "n", F.ceil(F.col("n") / queries).cast("int").alias("parts")))
    if (load.agg(F.sum("n")).first()[0] or 0) > most * n:
        return None

    def across(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame()
        return pd.DataFrame({"name": a["name"].to_numpy(), "d": _least(stack(a["vec"]), stack(b["rvec"]), False)})

    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = F.broadcast(load.select("to", "parts"))  # a row for each cell
    asks = found.select("name", "vec", F.explode("to").alias("to")).join(small, "to").select("name", "vec", "to", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"))
    cells = found.select(F.col("vec").alias("rvec"), F.col("cell").alias("to")).join(small, "to").select(
        "rvec", F.col("to").alias("rto"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("rpart")
    )
    pairs = asks.repartition(tasks, "to", "part").groupBy("to", "part").cogroup(cells.repartition(tasks, "rto", "rpart").groupBy("rto", "rpart"))
    return found.select("name", "d").unionByName(pairs.applyInPandas(across, "name string, d double")).groupBy("name").agg(F.min("d").alias("d"))
