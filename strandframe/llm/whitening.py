"""Whitening of vectors on an integer grid.

Sums are exact integers.  Every task reduces its centred rows to a triangular factor by
QR, factors are combined sixteen at a time until one is left, and its singular values and
vectors (``bidiagonal``) give the directions and their scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.bidiagonal import EPS, leading_vectors
from strandframe.llm.common import stored

FAN_IN = 16  # factors combined by one task


def on_grid(rows: DataFrame, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, x``: floor(scale * entry) + offset per entry.

    Rows whose vector is null, empty or holds a null or non-finite entry are left out, and
    so are vectors of another length than most have (of equally many the longer).
    """
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    fit = rows.where(v.isNotNull() & (F.size(v) > 0) & ~bad)
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long"))
    sized = fit.select(F.col(id_col).alias("id"), x.alias("x"))
    usual = sized.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return sized.where(F.size("x") == (usual[0]["d"] if usual else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(parts: DataFrame) -> list:
    """Sums by place of an array column ``v``, one entry per place."""
    placed = parts.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    return [r["v"] for r in placed.orderBy("i").collect()]  # as many rows as an array has entries


def grid_sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sum per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                yield pa.RecordBatch.from_arrays([pa.array([[len(x), *x.sum(axis=0).tolist()]], pa.list_(pa.int64()))], names=["v"])

    sums = summed(fit.mapInArrow(run, "v array<long>"))
    return (int(sums[0]), np.array(sums[1:], np.int64)) if sums else (0, np.empty(0, np.int64))


def triangular(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """Square triangular factor R with R'R = sum of outer products of the centred rows."""
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            centred = (matrix(batch.column("x")) * n - sums) / n
            r = np.linalg.qr(np.concatenate([r, centred]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel()], pa.list_(pa.float64()))], names=["r"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([np.asarray(r).reshape(-1, d) for r in group["r"]])
        return pd.DataFrame({"r": [np.linalg.qr(rows, mode="r").ravel()]})

    factors = stored(fit.mapInArrow(run, "r array<double>").withColumn("part", F.spark_partition_id()), "factors")
    while (left := factors.count()) > 1:
        groups = -(-left // FAN_IN)
        factors = factors.groupBy(F.pmod("part", F.lit(groups)).alias("part")).applyInPandas(join, "r array<double>")
        factors = stored(factors.withColumn("part", F.monotonically_increasing_id()), "factors")
    last = np.array(factors.first()["r"]).reshape(-1, d)  # d by d, whatever the number of rows
    out = np.zeros((d, d))
    out[: len(last)] = last
    return out


def whiten(grid: DataFrame, components: int = 16, id_col: str = "vec_id") -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error`` per row of ``grid`` (id, x) and component.

    The covariance is that of the distinct vectors, each once; components are its unit
    eigenvectors by falling eigenvalue, as many as asked for or as there are dimensions.
    ``whitened`` is null for a component without variance, ``explained`` where nothing
    varies; ``deviation`` is null beyond the range of a long; ``identity_error`` leaves
    components without variance out and is null where none is left.  Repeated rows give
    rows each, null ids stay, an empty table gives an empty result.
    """
    kind = grid.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = stored(grid.select("x").distinct(), "grid-vectors")
    n, sums = grid_sums(fit)
    if n == 0:
        return grid.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    values, vectors = leading_vectors(triangular(fit, n, sums), components)
    live = values[: vectors.shape[1]] > len(sums) * EPS * values[0]
    scale = np.where(live, np.sqrt(n) / np.where(live, values[: len(live)], 1.0), np.nan)
    total = float((values**2).sum())
    explained = [float(v * v / total) if total else None for v in values[: len(live)]]

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x * n - sums) / n) @ vectors * scale

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = projected(matrix(batch.column("x")))[:, live]
                yield pa.RecordBatch.from_arrays([pa.array([np.append(w.sum(axis=0), (w.T @ w).ravel())], pa.list_(pa.float64()))], names=["v"])

    error, k = None, int(live.sum())
    if k:
        got = np.array(summed(fit.mapInArrow(moments, "v array<double>"))) / n
        mean, square = got[:k], got[k:].reshape(k, k)
        error = float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            apart = x * n - sums
            deviation = (apart * apart).sum(axis=1)
            far = (apart.astype(float) ** 2).sum(axis=1) > 9e18
            whole = [None if sum(a * a for a in apart[i].tolist()) >= 1 << 63 else int(deviation[i]) for i in np.flatnonzero(far)]
            length = pa.array(deviation)
            if far.any():
                exact = deviation.tolist()
                for i, v in zip(np.flatnonzero(far).tolist(), whole):
                    exact[i] = v
                length = pa.array(exact, pa.int64())
            m, c = len(x), len(live)
            at = pa.array(np.repeat(np.arange(m), c))
            w = projected(x).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(at), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)), pa.array(np.full(m * c, n)),
                    length.take(at), pa.array(w, mask=np.isnan(w)), pa.array(explained * m, pa.float64()), pa.array([error] * (m * c), pa.float64()),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return grid.select("id", "x").mapInArrow(run, schema).withColumnRenamed("id", id_col)
