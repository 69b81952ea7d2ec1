import numpy as np
import pytest

from strandframe.operators import models as MD


@pytest.fixture(scope="module")
def problem(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(120, 5))
    y = np.column_stack([x @ [1, 0, -2, 0, 0.5] + 3, x @ [0, 1, 0, 0, 0]]) + rng.normal(size=(120, 2)) * 0.1
    rows = [(f"n{i}", [float(v) for v in x[i]], [float(v) for v in y[i]]) for i in range(120)]
    return x, y, spark.createDataFrame(rows, "name string, vec array<double>, y array<double>").repartition(5)


F5, T2 = ["f0", "f1", "f2", "f3", "f4"], ["t0", "t1"]


def table(df):
    p = df.toPandas().pivot(index="feature", columns="track", values="value")
    return p.loc[["(intercept)"] + F5, T2].to_numpy()


@pytest.mark.parametrize("alpha", [0.0, 7.0])
def test_ridge_is_closed_form(problem, alpha):
    x, y, df = problem
    z = np.hstack([np.ones((120, 1)), x])
    reg = np.eye(6) * alpha
    reg[0, 0] = 0
    want = np.linalg.solve(z.T @ z + reg, z.T @ y)
    assert np.allclose(table(MD.linear_models(df, F5, T2, "l2", alpha)), want)


def test_spark_ml_agrees(problem):
    x, y, df = problem
    model = MD.spark_linear_model(df, 0)
    want = table(MD.linear_models(df, F5, T2))[:, 0]
    assert np.allclose([model.intercept, *model.coefficients], want, atol=1e-6)


def test_lasso_optimality(problem):
    x, y, df = problem
    b = table(MD.linear_models(df, F5, T2, "l1", 0.2))
    r = y - b[0] - x @ b[1:]
    grad = (x - x.mean(0)).T @ r / 120
    on = np.abs(b[1:]) > 1e-9
    assert np.allclose(grad[on], 0.2 * np.sign(b[1:][on]), atol=1e-6) and (np.abs(grad[~on]) <= 0.2 + 1e-6).all()


def test_predictions_and_ablation(problem):
    x, y, df = problem
    coef = MD.linear_models(df, F5, T2)
    b = table(coef)
    p = MD.predict_linear(df, coef, F5).toPandas()
    got = p[(p.name == "n7") & (p.track == "t0")]["value"].iloc[0]
    assert got == pytest.approx(float(b[0, 0] + x[7] @ b[1:, 0]))
    ab = MD.feature_ablation(df, F5, T2).toPandas()
    t0 = ab[ab.track == "t0"].set_index("feature")["mse_change"]
    assert t0.idxmax() == "f2" and (ab["mse_change"] > -1e-9).all()


def test_coefficient_statistics(problem):
    x, y, df = problem
    got = MD.coefficient_statistics(df, F5, T2).toPandas()
    z = np.hstack([np.ones((120, 1)), x])
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    s2 = ((y - z @ b) ** 2).sum(0) / (120 - 6)
    sd = np.sqrt(np.linalg.inv(z.T @ z).diagonal()[1:, None] * s2)
    want = b[1:] / sd
    for i, f in enumerate(F5):
        for j, t in enumerate(T2):
            row = got[(got.feature == f) & (got.track == t)].iloc[0]
            assert row["z"] == pytest.approx(want[i, j])


def test_multitask_without_penalty_is_least_squares(problem):
    x, y, df = problem
    assert np.allclose(table(MD.multi_task_regression(df, F5, T2, 0.0)), table(MD.linear_models(df, F5, T2)))


def test_alpha_search_shrinks_noise(problem):
    _, _, df = problem
    out = MD.alpha_search(df.filter("name < 'n5'"), df.filter("name >= 'n5'"), F5, T2).collect()
    assert {r["track"] for r in out} == set(T2) and all(r["correlation"] > 0.9 for r in out)


def test_hotstart_and_forest(problem, spark):
    _, _, df = problem
    k = ["AAA", "CCC", "GGG", "TTT", "ACG"]
    m = MD.kmer_hotstart(df, k, T2, 2, 5).toPandas()
    assert set(m["motif"]) == {"GGG", "AAA"} or set(m["motif"]) == {"GGG", "CCC"}
    imp = MD.random_forest(df, F5).toPandas().set_index("feature")["importance"]
    assert imp.idxmax() == "f2"


def test_svd(problem):
    x, _, df = problem
    got = MD.svd_reduce(df.select("name", "vec"), 2).toPandas().set_index("name")
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    mine = np.array([got.loc[f"n{i}", "dims"] for i in range(120)])
    assert np.allclose(np.abs(mine), np.abs(u[:, :2] * s[:2]), atol=1e-8)
    _, emb = MD.linear_embedding(df.select("name", "vec"), 2)
    pc = emb.toPandas().set_index("name")
    assert np.allclose(np.abs(np.array([pc.loc[f"n{i}", "dims"] for i in range(120)])), np.abs(mine), atol=1e-6)


@pytest.mark.parametrize("alpha", [0.0, 3.0])
def test_ablation_equals_fitting_again(spark, alpha):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 6))
    x[:, 5] = x[:, 0] + x[:, 1] if alpha == 0 else x[:, 5]  # a feature that others make up for
    y = np.column_stack([x[:, :4] @ [1, 0, -2, 0.3], x[:, 1]]) + rng.normal(size=(80, 2)) * 0.2
    names = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame([(f"n{i}", x[i].tolist(), y[i].tolist()) for i in range(80)], "name string, vec array<double>, y array<double>")
    got = {(r.feature, r.track): r.mse_change for r in MD.feature_ablation(df, names, T2, alpha).collect()}

    def mse(keep):
        z = np.hstack([np.ones((80, 1)), x[:, keep]])
        reg = np.eye(len(keep) + 1) * alpha
        reg[0, 0] = 0
        b = np.linalg.lstsq(z.T @ z + reg, z.T @ y, rcond=1e-12)[0]
        return ((y - z @ b) ** 2).mean(0)

    full = mse(list(range(6)))
    for j in range(6):
        want = mse([k for k in range(6) if k != j]) - full
        assert np.allclose([got[f"f{j}", t] for t in T2], want, atol=1e-9)


def wide_table(df, names, tracks):
    p = df.toPandas().pivot(index="feature", columns="track", values="value")
    return p.loc[["(intercept)", *names], tracks].to_numpy()


def test_wide_models_equal_the_small_ones(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 30))
    y = np.column_stack([x[:, :3] @ [2, -1, 1] + 1, x[:, 5] - x[:, 7]]) + rng.normal(size=(150, 2)) * 0.3
    names = [f"f{i:02d}" for i in range(30)]
    df = spark.createDataFrame([(f"n{i}", x[i].tolist(), y[i].tolist()) for i in range(150)], "name string, vec array<double>, y array<double>").repartition(3)
    kinds = [("l2", 5.0, False), ("l1", 0.3, True), ("elastic", 0.5, False)]
    small = [wide_table(MD.linear_models(df, names, T2, k, a, refit=r), names, T2) for k, a, r in kinds]
    monkeypatch.setattr(MD, "MAX_FEATURES", 29)
    for (k, a, r), want in zip(kinds, small):
        assert np.allclose(wide_table(MD.linear_models(df, names, T2, k, a, refit=r), names, T2), want, atol=1e-6)


def test_logistic_closed_forms(spark):
    # one binary feature: intercept and slope are log odds; no feature that matters: the log odds of the target
    rows = [(f"a{i}", [float(i % 2), 0.0], [float(i % 3 == 0 if i % 2 else i % 5 == 0), float(i % 4 == 0)]) for i in range(120)]
    df = spark.createDataFrame(rows, "name string, vec array<double>, y array<double>")
    got = {(r.track, r.feature): r.value for r in MD.logistic_models(df, ["g", "h"], ["s", "u"]).collect()}
    odds = lambda hit: np.log(hit / (1 - hit))
    y = np.array([r[2][0] for r in rows])
    even, odd = y[::2].mean(), y[1::2].mean()
    assert got["s", "(intercept)"] == pytest.approx(odds(even), abs=1e-7) and got["s", "g"] == pytest.approx(odds(odd) - odds(even), abs=1e-7)
    assert got["s", "h"] == 0.0


@pytest.mark.parametrize("reg, elastic", [(0.05, 0.0), (0.03, 0.5)])
def test_logistic_optimality(spark, reg, elastic):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 4))
    y = (rng.random((200, 2)) < 1 / (1 + np.exp(-np.column_stack([x[:, 0] * 2 - 1, x[:, 1] - x[:, 2]])))).astype(float)
    df = spark.createDataFrame([(f"n{i}", x[i].tolist(), y[i].tolist()) for i in range(200)], "name string, vec array<double>, y array<double>").repartition(3)
    b = wide_table(MD.logistic_models(df, ["a", "b", "c", "d"], T2, reg, elastic), ["a", "b", "c", "d"], T2)
    mu = 1 / (1 + np.exp(-(b[0] + x @ b[1:])))
    assert np.abs((y - mu).mean(0)).max() < 1e-7
    grad = x.T @ (y - mu) / 200 - reg * (1 - elastic) * b[1:]
    on = np.abs(b[1:]) > 1e-9
    assert np.allclose(grad[on], reg * elastic * np.sign(b[1:][on]), atol=1e-7) and (np.abs(grad[~on]) <= reg * elastic + 1e-7).all()


def test_reductions(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    df = spark.createDataFrame([(f"n{i:02d}", x[i].tolist()) for i in range(60)], "name string, vec array<double>")
    c = x - x.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    got = np.array([r.dims for r in MD.svd_reduce(df, 5).orderBy("name").collect()])
    assert np.allclose(np.abs(got), np.abs(u * s), atol=1e-8)
    assert len(MD.svd_reduce(df, 0.9).first().dims) == int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.9) + 1)
    flat = np.array([r.dims for r in MD.linear_embedding(df, 2)[1].orderBy("name").collect()])
    assert np.allclose(np.abs(flat), np.abs((u * s)[:, :2]), atol=1e-8)


def test_factors_follow_the_updates(spark):
    rng = np.random.default_rng(13)
    x = (rng.random((12, 2)) @ rng.random((2, 9))) * (rng.random((12, 9)) < 0.7)
    cells = [(f"r{i:02d}", f"c{j}", float(x[i, j])) for i in range(12) for j in range(9) if x[i, j] > 0]
    df = spark.createDataFrame([*cells, ("r00", "c0", None), ("r01", "c1", -5.0)], "row string, col string, value double")

    def factors(n):
        rows, cols = MD.nonnegative_factorization(df, 2, iterations=n)
        return [np.array([r.features for r in f.orderBy(f.columns[0]).collect()]) for f in (rows, cols)]

    w, h = factors(0)
    errors = []
    for _ in range(4):
        w = w * (x @ h) / (w @ (h.T @ h))
        h = h * (x.T @ w) / (h @ (w.T @ w))
        errors.append(np.linalg.norm(x - w @ h.T))
    got_w, got_h = factors(4)
    assert np.allclose(got_w, w) and np.allclose(got_h, h) and errors == sorted(errors, reverse=True)
    assert MD.nonnegative_factorization(df.limit(0), 2, iterations=1)[0].count() == 0
