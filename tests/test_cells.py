import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators import cells, seqdist


def test_nearest_distances_by_cells(spark, monkeypatch):
    def blocks(*args, **kwargs):
        raise AssertionError("all pairs")

    rng = np.random.default_rng(12)
    x = np.vstack([rng.integers(0, 40, (6, 3))[rng.integers(0, 6, 500)] + rng.integers(0, 9, (500, 3)), [[500, 0, 0]]]).astype(float)
    df = spark.createDataFrame([(f"n{i:03d}", row) for i, row in enumerate(x.tolist())], "name string, vec array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {f"n{i:03d}": v for i, v in enumerate(d.min(1))}
    with monkeypatch.context() as m:
        m.setattr(seqdist, "against_reference", blocks)
        got = {r["name"]: r["distance"] for r in seqdist.nearest_distances(df, bound=20).collect()}
    assert got == pytest.approx(want)
    distinct = df.groupBy("vec").agg(F.min("name").alias("name")).select("name", "vec")
    assert cells.nearest_in_cells(distinct, 20, most=0) is None  # too many cells reached: left to the blocks
    parts = cells.nearest_in_cells(distinct, 20, queries=3)  # the points that reach a cell in several tasks
    assert {r["name"] for r in parts.collect()} <= set(want) and parts.count() == distinct.count()
