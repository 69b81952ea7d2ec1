import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.functions import special as SP
from strandframe.operators import stats as S


def test_tails(spark):
    df = spark.createDataFrame([(1.96, 2.0, 10.0, 0.5, 20.0)], "z double, t double, nu double, r double, n double")
    r = df.select(
        SP.normal_sf("z").alias("z"), SP.t_two_sided("t", "nu").alias("t"), SP.correlation_tail("r", "n").alias("r"),
        SP.t_isf(SP.t_two_sided("t", "nu"), F.col("nu")).alias("back"), SP.log_factorial("nu").alias("lf"),
    ).first()
    assert r["z"] == pytest.approx(0.024997895148220435)
    assert r["t"] == pytest.approx(0.07338803477074037)
    # exact beta form equals t with n - 2 degrees of freedom
    t = 0.5 * math.sqrt(18) / math.sqrt(0.75)
    assert r["r"] == pytest.approx(float(SP.t_two_sided_np(np.array(t), np.array(18.0))))
    assert r["back"] == pytest.approx(2.0)
    assert r["lf"] == pytest.approx(math.log(math.factorial(10)))


def test_fisher_tails(spark):
    df = spark.createDataFrame([(3, 1, 1, 3)], "a long, b long, c long, d long")
    r = df.select(SP.fisher_tails("a", "b", "c", "d").alias("t")).first()["t"]
    assert r["p_more"] == pytest.approx(17 / 70)
    assert r["p_less"] == pytest.approx(69 / 70)


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    rows = [("g", int(rng.integers(0, 2)), float(rng.integers(0, 12))) for _ in range(200)]
    return rows, spark.createDataFrame(rows, "k string, label int, score double")


def test_auroc_and_auprc_against_pairs(scored):
    rows, df = scored
    pos = [s for _, y, s in rows if y]
    neg = [s for _, y, s in rows if not y]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert S.auroc(df, ["k"]).first()["auroc"] == pytest.approx(want)
    ap, last = 0.0, 0.0
    for t in sorted({s for _, _, s in rows}, reverse=True):
        chosen = [y for _, y, s in rows if s >= t]
        recall, precision = sum(chosen) / len(pos), sum(chosen) / len(chosen)
        ap += (recall - last) * precision
        last = recall
    assert S.auprc(df, ["k"]).first()["auprc"] == pytest.approx(ap)


def test_one_class_has_no_auroc(spark):
    df = spark.createDataFrame([("g", 1, 0.1), ("g", 1, 0.4)], "k string, label int, score double")
    assert S.auroc(df, ["k"]).first()["auroc"] is None


def test_bh_against_direct(spark):
    p = [0.01, 0.01, 0.02, 0.5, 1.0, 0.0, 0.04, 0.04, 0.9]
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(p)], "c string, i int, p double")
    got = {r["i"]: r["q"] for r in S.bh_adjust(df, ["c"]).collect()}
    m = len(p)
    for i, v in enumerate(p):
        want = min(1.0, min(x * m / sum(y <= x for y in p) for x in p if x >= v))
        assert got[i] == pytest.approx(want)
    q = [got[i] for i in np.argsort(p)]
    assert q == sorted(q)


def test_correlation_edges(spark):
    rows = [("one", 1.0, float(i)) for i in range(4)] + [("both", 2.0, 3.0)] * 3 + [("ok", float(i), 2.0 * i) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    got = {r["k"]: r["correlation"] for r in S.correlation(df, ["k"]).collect()}
    assert got == {"one": 2.0, "both": None, "ok": 0.0}


def test_wilcoxon_drops_zero_differences(spark):
    d = [1.0, -2.0, 3.0, 0.0, 4.0, 4.0]
    df = spark.createDataFrame([("k", v, 0.0) for v in d], "k string, a double, b double")
    r = S.wilcoxon_signed_rank(df, ["k"]).first()
    assert r["w"] == pytest.approx(1 + 3 + 4.5 + 4.5)


def test_permutation_ring_has_no_fixed_row(spark):
    rows = [(f"r{i}", f"c{j}", float(i * j % 7), float(i + j)) for i in range(40) for j in range(5)]
    df = spark.createDataFrame(rows, "row string, col string, a double, b double")
    assert S.permutation_baseline(df).count() == 40


def test_permutation_ring_has_no_fixed_point(spark):
    from strandframe.operators.stats import permutation_baseline, permutation_test

    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(9, 6)), rng.normal(size=(9, 6))
    rows = [(f"r{i}", j, float(a[i, j]), float(b[i, j])) for i in range(9) for j in range(6)]
    df = spark.createDataFrame(rows, "row string, col int, a double, b double")
    got = {int(r["row"][1:]): (r["observed"], r["shuffled"]) for r in permutation_baseline(df).collect()}
    assert set(got) == set(range(9))
    others = []
    apart = lambda i, k: 1 - np.corrcoef(a[i], b[k])[0, 1]
    for i, (seen, null) in got.items():
        assert seen == pytest.approx(apart(i, i), abs=1e-4)
        match = min(range(9), key=lambda k: abs(apart(i, k) - null))
        assert match != i and abs(apart(i, match) - null) < 1e-4
        others.append(match)
    assert sorted(others) == list(range(9))
    two = {r["row"]: r["shuffled"] for r in permutation_baseline(df.where("row IN ('r0', 'r1')")).collect()}
    assert two["r0"] == pytest.approx(apart(0, 1), abs=1e-4) and two["r1"] == pytest.approx(apart(1, 0), abs=1e-4)
    assert [r["shuffled"] for r in permutation_baseline(df.where("row = 'r0'")).collect()] == [None]
    assert permutation_test(df).count() == 1
