import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.functions import ranking as R
from strandframe.operators import matrix as M


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    vals = np.concatenate([np.zeros(200), rng.normal(size=150), rng.exponential(size=100) * 1e6, [-np.inf, np.inf, 1e-300, -1e-300]])
    rows = [("g1" if i % 3 else "g2", float(v), int(i)) for i, v in enumerate(rng.permutation(vals))]
    return rows, spark.createDataFrame(rows, "k string, v double, i long")


def test_bucket_is_monotone(spark, data):
    rows, df = data
    got = df.select("v", R.value_bucket(F.col("v")).alias("b")).collect()
    got.sort(key=lambda r: r["v"])
    b = [r["b"] for r in got]
    assert b == sorted(b)


def test_ordinal_rank_with_hot_ties(data):
    rows, df = data
    got = {(r["k"], r["i"]): r["rank"] for r in R.ordinal_rank(df, ["k"], "v", "i").collect()}
    for k in ("g1", "g2"):
        ordered = sorted((v, i) for kk, v, i in rows if kk == k)
        assert {(k, i): n for n, (_, i) in enumerate(ordered)} == {x: y for x, y in got.items() if x[0] == k}


def test_rank_does_not_depend_on_partitions(data):
    _, df = data
    a = R.ordinal_rank(df.repartition(1), ["k"], "v", "i").select("i", "rank").orderBy("i").collect()
    b = R.ordinal_rank(df.repartition(7), ["k"], "v", "i").select("i", "rank").orderBy("i").collect()
    assert a == b


def test_percentiles_match_numpy(data):
    rows, df = data
    fin = df.filter("v > double('-Infinity') and v < double('Infinity')")
    qs = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {r["k"]: r for r in R.exact_percentiles(fin, ["k"], "v", qs, list("abcde")).collect()}
    for k in ("g1", "g2"):
        v = np.array([v for kk, v, _ in rows if kk == k and np.isfinite(v)])
        assert np.allclose([got[k][c] for c in "abcde"], np.quantile(v, qs))


def test_running_totals_descending(spark):
    df = spark.createDataFrame([("a", float(v), 1) for v in (3, 1, 2, 0, -4)], "k string, v double, n long")
    got = {r["v"]: r["n_before"] for r in R.running_totals(df, ["k"], "v", ["n"], descending=True).collect()}
    assert got == {3.0: 0, 2.0: 1, 1.0: 2, 0.0: 3, -4.0: 4}


def test_gini(spark):
    df = spark.createDataFrame([("r", "c%d" % i, float(v)) for i, v in enumerate([1, 1, 2, 5])], "row string, col string, value double")
    x = np.sort(np.array([1, 1, 2, 5.0]) - 1 + 1e-16)
    i = np.arange(1, 5)
    want = ((2 * i - 5) * x).sum() / (4 * x.sum())
    assert M.gini(df, ["row"]).first()["gini"] == pytest.approx(want)


def test_quantile_normalize_gives_one_profile(spark):
    rng = np.random.default_rng(1)
    rows = [(f"r{i}", c, float(rng.integers(0, 6)), i) for i in range(30) for c in ("x", "y", "z")]
    df = spark.createDataFrame(rows, "row string, col string, value double, tie long")
    out = M.quantile_normalize(df, "tie").toPandas()
    profiles = [np.sort(out[out.col == c]["value"].to_numpy()) for c in ("x", "y", "z")]
    assert np.allclose(profiles[0], profiles[1]) and np.allclose(profiles[0], profiles[2])


def test_size_factors_zero_over_zero_is_one(spark):
    rows = [("a", "x", 0.0), ("a", "y", 0.0), ("b", "x", 4.0), ("b", "y", 1.0), ("c", "x", 8.0), ("c", "y", 2.0)]
    df = spark.createDataFrame(rows, "row string, col string, value double")
    got = {r["col"]: r["size_factor"] for r in M.size_factors(df).collect()}
    assert got == {"x": pytest.approx(2.0), "y": pytest.approx(0.5)}
