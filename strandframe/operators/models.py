"""Linear, logistic and forest models per track, and reductions.

Linear fits only need sums over rows: every task adds up its part of X'X, X'Y and
Y'Y, the parts are added by a grouped sum, and the small matrix is solved once.  A
penalty path, an ablation over features or coefficient statistics then cost no
further pass over the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.special import t_two_sided_np
from strandframe.session import written

MAX_FEATURES = 4_096


def feature_vectors(x: DataFrame, features: list[str]) -> DataFrame:
    """``(name, feature, value)`` to ``(name, vec array<double>)`` over an explicit feature list."""
    m = x.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.col("value").cast("double")))).alias("m"))
    names = F.array(*[F.lit(f) for f in features])
    return m.select("name", F.transform(names, lambda f: F.coalesce(F.try_element_at("m", f), F.lit(0.0))).alias("vec"))


def target_vectors(y: DataFrame, tracks: list[str]) -> DataFrame:
    """``(name, track, value)`` to ``(name, y array<double>)``; names without every track are dropped."""
    m = y.filter(F.col("track").isin(tracks)).groupBy("name").agg(
        F.map_from_entries(F.collect_list(F.struct("track", F.col("value").cast("double")))).alias("m")
    )
    m = m.filter(F.size("m") == len(tracks))
    return m.select("name", F.transform(F.array(*[F.lit(t) for t in tracks]), lambda t: F.element_at("m", t)).alias("y"))


# ------------------------------------------------------------- sums over rows
@dataclass
class Moments:
    """Sums of [1, X]'[1, X], [1, X]'Y and Y'Y (diagonal), with names."""

    features: list[str]
    tracks: list[str]
    n: float
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray


def moments(data: DataFrame, features: list[str], tracks: list[str], weight: str | None = None, columns: np.ndarray | None = None) -> Moments:
    """One pass over ``(name, vec, y)``; the result has (features + tracks + 1) squared numbers.

    ``columns`` are the places of the features in ``vec`` where these are not all of it.
    """
    p, t = len(features), len(tracks)
    if p > MAX_FEATURES:
        raise ValueError(f"at most {MAX_FEATURES} features; select features first")
    width = 1 + p + t

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for part in parts:
            if not len(part):
                continue
            x, y = np.array(part["vec"].to_list(), float), np.array(part["y"].to_list(), float)
            x = x if columns is None else x[:, columns]
            z = np.hstack([np.ones((len(part), 1)), x, y])
            w = part["w"].to_numpy(float)[:, None]
            total += (z * w).T @ z
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    sums = data.select("vec", "y", w.alias("w")).mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    table = sums.toPandas()
    m = np.zeros((width, width))
    m[table["i"], table["j"]] = table["v"]
    return Moments(features, tracks, m[0, 0], m[: 1 + p, : 1 + p], m[: 1 + p, 1 + p :], np.diag(m)[1 + p :].copy())


# ------------------------------------------------- without a table of feature pairs
def _passed(data: DataFrame, rows: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``rows(z, y, w)`` (an array of one shape) over Arrow batches of ``(vec, y, w)``; z has a leading one."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in parts:
            if not len(part):
                continue
            x, y = np.array(part["vec"].to_list(), float), np.array(part["y"].to_list(), float)
            one = rows(np.hstack([np.ones((len(part), 1)), x]), y, part["w"].to_numpy(float)[:, None])
            total = one if total is None else total + one
        if total is not None:
            yield pd.DataFrame({"v": [total.ravel()]})

    sums = data.mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    table = sums.toPandas().sort_values("i")  # as many numbers as one result has
    return table["v"].to_numpy()


def wide_ridge(data: DataFrame, n_features: int, n_tracks: int, alpha: float, rounds: int = 1_000, tol: float = 1e-11) -> np.ndarray:
    """Ridge coefficients by conjugate gradients with a diagonal preconditioner.

    A round is one pass that multiplies the present directions (features * tracks numbers) by
    X and by its transpose; no table of feature pairs exists anywhere.
    """
    shape = (1 + n_features, n_tracks)
    first = _passed(data, lambda z, y, w: np.hstack([(z * w).T @ y, (z * z * w).sum(0)[:, None]])).reshape(shape[0], n_tracks + 1)
    c, reg = first[:, :n_tracks], np.r_[0.0, np.full(n_features, alpha)][:, None]
    scale = first[:, [n_tracks]] + reg
    scale[scale == 0] = 1.0
    b, r = np.zeros(shape), c.copy()
    z = r / scale
    d, rz, goal = z.copy(), (r * z).sum(0), tol**2 * (c * c / scale).sum(0)
    for _ in range(rounds):
        open_ = rz > goal
        if not open_.any():
            break
        ad = _passed(data, lambda z, y, w, d=d: (z * w).T @ (z @ d)).reshape(shape) + reg * d
        curve = (d * ad).sum(0)
        step = np.where(open_ & (curve > 0), rz / np.where(curve > 0, curve, 1.0), 0.0)
        b, r = b + step * d, r - step * ad
        z = r / scale
        new = (r * z).sum(0)
        d = z + np.where(rz > 0, new / np.where(rz > 0, rz, 1.0), 0.0) * d
        rz = new
    return b


def wide_elastic_net(data: DataFrame, features: list[str], tracks: list[str], alpha: float, l1_ratio: float) -> np.ndarray:
    """Coordinate descent on the features that can be other than zero, until no feature left out would move.

    The first features are those whose product with the centred targets passes the penalty; after
    each fit one pass gives the gradient of all, and the ones above the penalty join.
    """
    if alpha * l1_ratio <= 0:
        raise ValueError("without an l1 penalty every feature stays; use l2")
    p, t = len(features), len(tracks)
    start = _passed(data, lambda z, y, w: np.hstack([(z * w).T @ y, (z * w).sum(0)[:, None]])).reshape(1 + p, t + 1)
    n, c = start[0, t], start[:, :t]
    b = np.vstack([c[:1] / n, np.zeros((p, t))])
    used = np.zeros(p, bool)
    while True:
        fit = _passed(data, lambda z, y, w: (z * w).T @ (z @ b)).reshape(1 + p, t)
        gradient = np.abs(c - fit)[1:].max(1) / n
        more = (gradient > alpha * l1_ratio * (1 + 1e-7)) & ~used
        if not more.any():
            return b
        used |= more
        at = np.flatnonzero(used)
        m = moments(data, [features[i] for i in at], tracks, "w", at)
        found = elastic_net(m, alpha, l1_ratio, rounds=5_000, tol=1e-11)
        b = np.zeros((1 + p, t))
        b[0], b[1 + at] = found[0], found[1:]


def ridge(m: Moments, alpha: float = 0.0, keep: np.ndarray | None = None) -> np.ndarray:
    """(1 + features, tracks) coefficients of squared error + alpha * squared norm; the intercept is free."""
    keep = np.ones(len(m.features), bool) if keep is None else keep
    idx = np.concatenate([[0], 1 + np.nonzero(keep)[0]])
    reg = np.eye(len(idx)) * alpha
    reg[0, 0] = 0
    a = m.xx[np.ix_(idx, idx)] + reg
    sol = np.linalg.lstsq(a, m.xy[idx], rcond=1e-12)[0]
    out = np.zeros((len(m.features) + 1, len(m.tracks)))
    out[idx] = sol
    return out


def elastic_net(m: Moments, alpha: float, l1_ratio: float = 1.0, rounds: int = 500, tol: float = 1e-9) -> np.ndarray:
    """Coordinate descent on the sums: error / (2n) + alpha * (l1_ratio * |b| + (1 - l1_ratio) / 2 * b^2)."""
    n = m.n
    mu = m.xx[0, 1:] / n
    my = m.xy[0] / n
    g = m.xx[1:, 1:] / n - np.outer(mu, mu)
    c = m.xy[1:] / n - np.outer(mu, my)
    b = np.zeros((len(m.features), len(m.tracks)))
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    diag = np.diag(g)
    for _ in range(rounds):
        worst = 0.0
        for j in range(len(b)):
            if diag[j] <= 1e-15:
                continue
            r = c[j] - g[j] @ b + diag[j] * b[j]
            new = np.sign(r) * np.maximum(np.abs(r) - l1, 0) / (diag[j] + l2)
            worst = max(worst, float(np.abs(new - b[j]).max()))
            b[j] = new
        if worst < tol:
            break
    return np.vstack([my - mu @ b, b])


def errors(m: Moments, b: np.ndarray) -> np.ndarray:
    """Sum of squared errors per track from the sums."""
    return m.yy - 2 * (b * m.xy).sum(0) + (b * (m.xx @ b)).sum(0)


def correlations(m: Moments, b: np.ndarray) -> np.ndarray:
    """Pearson correlation of prediction and target per track from the sums."""
    n = m.n
    sp, sy = m.xx[0] @ b, m.xy[0]
    pp, py = (b * (m.xx @ b)).sum(0), (b * m.xy).sum(0)
    den = np.sqrt(np.maximum(pp - sp * sp / n, 0) * np.maximum(m.yy - sy * sy / n, 0))
    return np.where(den > 0, (py - sp * sy / n) / np.where(den > 0, den, 1), 0.0)


def coefficient_table(spark: SparkSession, m: Moments, b: np.ndarray) -> DataFrame:
    names = ["(intercept)"] + m.features
    rows = pd.DataFrame({
        "track": np.repeat(m.tracks, len(names)), "feature": names * len(m.tracks), "value": b.T.ravel(),
    })
    return spark.createDataFrame(rows, "track string, feature string, value double")


# ----------------------------------------------------------------- regression
def linear_models(data: DataFrame, features: list[str], tracks: list[str], penalty: str = "none", alpha: float = 0.0, l1_ratio: float = 0.5, weight: str | None = None, refit: bool = False) -> DataFrame:
    """One linear model per track: ``(track, feature, value)``.

    ``none``, ``l2`` (alpha * squared norm), ``l1`` or ``elastic``; ``refit`` fits the features that
    stay after l1 again without a penalty.  More than ``MAX_FEATURES`` features are fitted to the same
    optimum without their pairs: conjugate gradients, or coordinate descent on screened ones.
    """
    if len(features) > MAX_FEATURES:
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        rows = written(data.select("vec", "y", w.alias("w")))
        if penalty in ("none", "l2"):
            b = wide_ridge(rows, len(features), len(tracks), alpha if penalty == "l2" else 0.0)
        else:
            b = wide_elastic_net(rows, features, tracks, alpha, 1.0 if penalty == "l1" else l1_ratio)
            for t in range(len(tracks) if refit else 0):
                at = np.flatnonzero(b[1:, t])
                one = moments(rows.withColumn("y", F.array(F.col("y")[t])), [features[i] for i in at], [tracks[t]], "w", at)
                again = ridge(one, 0.0)
                b[:, t] = 0.0
                b[0, t], b[1 + at, t] = again[0, 0], again[1:, 0]
        return coefficient_table(data.sparkSession, Moments(features, tracks, 0, None, None, None), b)
    m = moments(data, features, tracks, weight)
    if penalty in ("none", "l2"):
        b = ridge(m, alpha if penalty == "l2" else 0.0)
    else:
        b = elastic_net(m, alpha, 1.0 if penalty == "l1" else l1_ratio)
        if refit:
            for t in range(len(tracks)):
                one = Moments(features, [tracks[t]], m.n, m.xx, m.xy[:, [t]], m.yy[[t]])
                b[:, [t]] = ridge(one, 0.0, np.abs(b[1:, t]) > 0)
    return coefficient_table(data.sparkSession, m, b)


def predict_linear(data: DataFrame, coefficients: DataFrame, features: list[str]) -> DataFrame:
    """Predictions ``(name, track, value)``; the coefficients (features * tracks numbers) are broadcast."""
    c = coefficients.toPandas()
    tracks = sorted(c["track"].unique())
    wide = c.pivot(index="feature", columns="track", values="value")
    out = None
    arr = F.col("vec")
    for t in tracks:
        w = F.array(*[F.lit(float(wide.loc[f, t])) for f in features])
        dot = F.aggregate(F.zip_with(arr, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        one = data.select("name", F.lit(t).alias("track"), (dot + float(wide.loc["(intercept)", t])).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def spark_linear_model(data: DataFrame, track_index: int, reg: float = 0.0, elastic: float = 0.0, weight: str | None = None):
    """The same fit by Spark ML for one track (iterative solver for wide features)."""
    d = data.select(array_to_vector("vec").alias("features"), F.get("y", F.lit(track_index)).alias("label"), *([weight] if weight else []))
    lr = LinearRegression(regParam=reg, elasticNetParam=elastic, standardization=False, **({"weightCol": weight} if weight else {}))
    return lr.fit(d)


def multi_task_regression(data: DataFrame, features: list[str], tracks: list[str], alpha: float = 1.0, l1_ratio: float | None = None) -> DataFrame:
    """Joint fit on standardised features; coefficients are given on the original scale."""
    m = moments(data, features, tracks)
    mu = m.xx[0, 1:] / m.n
    sd = np.sqrt(np.maximum(np.diag(m.xx)[1:] / m.n - mu * mu, 0))
    ok = sd > 1e-12
    s = np.where(ok, sd, 1.0)
    # [1, Z] = [1, X] T
    t = np.eye(len(features) + 1)
    t[0, 1:] = -mu / s
    t[1:, 1:] = np.diag(np.where(ok, 1 / s, 0.0))
    z = Moments(features, tracks, m.n, t.T @ m.xx @ t, t.T @ m.xy, m.yy)
    b = ridge(z, alpha, ok) if l1_ratio is None else elastic_net(z, alpha, l1_ratio)
    return coefficient_table(data.sparkSession, m, t @ b)


def alpha_search(train: DataFrame, valid: DataFrame, features: list[str], tracks: list[str], start: float = 1.0, factor: float = 3.0, steps: int = 20, jointly: bool = False) -> DataFrame:
    """Grow or shrink the l2 penalty until the validation correlation stops improving, per track or jointly.

    ``(track, alpha, correlation, mse)``; two passes over the data in all.
    """
    mt, mv = moments(train, features, tracks), moments(valid, features, tracks)

    def score(alpha: float, pick: list[int]) -> float:
        return float(correlations(mv, ridge(mt, alpha))[pick].mean())

    rows = []
    for pick in ([list(range(len(tracks)))] if jointly else [[i] for i in range(len(tracks))]):
        best, top = start, score(start, pick)
        for direction in (factor, 1 / factor):
            a = start
            for _ in range(steps):
                a *= direction
                s = score(a, pick)
                if s <= top:
                    break
                best, top = a, s
        b = ridge(mt, best)
        for i in pick:
            rows.append((tracks[i], float(best), float(correlations(mv, b)[i]), float(errors(mv, b)[i] / mv.n)))
    return train.sparkSession.createDataFrame(rows, "track string, alpha double, correlation double, mse double")


def coefficient_statistics(data: DataFrame, features: list[str], tracks: list[str], alpha: float = 0.0) -> DataFrame:
    """z = coefficient / sd, two-sided p, signed -log10 p and rank of |z| per track."""
    m = moments(data, features, tracks)
    b = ridge(m, alpha)
    reg = np.eye(len(features) + 1) * alpha
    inv = np.linalg.pinv(m.xx + reg, rcond=1e-10, hermitian=True).diagonal()
    dof = abs(m.n - len(features) - 1)
    var = np.maximum(errors(m, b), 0) / dof
    sd = np.sqrt(np.maximum(inv[1:, None] * var[None, :], 0))
    z = np.where(sd > 0, b[1:] / np.where(sd > 0, sd, 1), 0.0)
    p = t_two_sided_np(z, np.full(z.shape, float(dof)))
    rows = pd.DataFrame({
        "track": np.tile(tracks, len(features)), "feature": np.repeat(features, len(tracks)), "value": b[1:].ravel(), "z": z.ravel(),
        "p": p.ravel(), "logp": (np.sign(z) * -np.log10(np.maximum(p, 1e-300))).ravel(),
        "rank": np.argsort(np.argsort(-np.abs(z), axis=0, kind="stable"), axis=0).ravel(),
    })
    return data.sparkSession.createDataFrame(rows, "track string, feature string, value double, z double, p double, logp double, rank long")


def feature_ablation(data: DataFrame, features: list[str], tracks: list[str], alpha: float = 0.0) -> DataFrame:
    """Change of mean squared error per track when one feature is left out and the model fitted again.

    Leaving feature j out moves the solution b by -b_j / V_jj times column j of V, the inverse of the
    normal matrix, so one factorisation serves all features.  A feature that the others make
    up for (its unit vector is not in the range of a singular matrix) changes nothing.
    """
    m = moments(data, features, tracks)
    reg = np.eye(len(features) + 1) * alpha
    reg[0, 0] = 0
    normal = m.xx + reg
    inverse = np.linalg.pinv(normal, rcond=1e-12, hermitian=True)
    b = (inverse @ m.xy)[1:]
    v = inverse[1:, 1:]
    diagonal = np.diag(v)
    needed = (np.einsum("ij,ij->i", normal[1:], inverse[:, 1:].T) > 1 - 1e-6) & (diagonal > 0)
    step = np.where(needed[:, None], b / np.where(needed, diagonal, 1.0)[:, None], 0.0)
    # the penalised sum grows by b_j * step_j; the penalty's own change is taken out again
    change = b * step + alpha * (2 * step * (v.T @ b) - step**2 * (v * v).sum(0)[:, None])
    change = np.where(needed[:, None], change, 0.0) / m.n
    rows = [(t, f, float(change[j, i])) for j, f in enumerate(features) for i, t in enumerate(tracks)]
    return data.sparkSession.createDataFrame(rows, "track string, feature string, mse_change double")


def logistic_models(data: DataFrame, features: list[str], tracks: list[str], reg: float = 0.0, elastic: float = 0.0, rounds: int = 60, tol: float = 1e-9) -> DataFrame:
    """One binary model per track: ``(track, feature, value)``.

    Mean loss + reg * (elastic * |b| + (1 - elastic) / 2 * b^2), the intercept free, by reweighted
    least squares.  One pass a round gathers the weighted sums of all tracks, so the number of
    jobs does not depend on the number of tracks.  A step that raises the loss is halved; without
    a penalty, separable data go on to larger coefficients for ``rounds`` rounds.
    """
    p, t = len(features), len(tracks)
    if p > MAX_FEATURES:
        raise ValueError(f"at most {MAX_FEATURES} features; select features first")
    rows = written(data.select("vec", "y", F.lit(1.0).alias("w")))
    l1, l2 = reg * elastic, reg * (1 - elastic)
    free = np.r_[0.0, np.ones(p)]
    b, old, last = np.zeros((1 + p, t)), np.zeros((1 + p, t)), np.full(t, np.inf)
    done = np.zeros(t, bool)
    for _ in range(rounds):

        def sums(z, y, w, b=b):
            out = []
            for k in range(t):
                s = z @ b[:, k]
                mu = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
                loss = np.logaddexp(0, s) - y[:, k] * s
                out.append(np.concatenate([[loss.sum(), len(z)], z.T @ (y[:, k] - mu), ((z * (mu * (1 - mu))[:, None]).T @ z).ravel()]))
            return np.array(out)

        got = _passed(rows, sums).reshape(t, -1)
        if not got.size:
            break
        n = got[0, 1]
        for k in range(t):
            if done[k]:
                continue
            size = np.abs(b[1:, k])
            loss = got[k, 0] / n + l1 * size.sum() + l2 / 2 * (size**2).sum()
            if loss > last[k] + 1e-13 * abs(last[k]):
                b[:, k] = (b[:, k] + old[:, k]) / 2
                done[k] = np.abs(b[:, k] - old[:, k]).max() < tol
                continue
            g, h = got[k, 2 : 3 + p] / n, got[k, 3 + p :].reshape(1 + p, 1 + p) / n
            if l1 == 0:
                new = b[:, k] + np.linalg.lstsq(h + np.diag(free * l2), g - l2 * free * b[:, k], rcond=1e-12)[0]
            else:
                new = _quadratic_lasso(h, h @ b[:, k] + g, l1 * free, l2 * free, b[:, k])
            done[k] = np.abs(new - b[:, k]).max() < tol
            old[:, k], last[k], b[:, k] = b[:, k], loss, new
        if done.all():
            break
    names = ["(intercept)", *features]
    out = [(track, f, float(b[i, k])) for k, track in enumerate(tracks) for i, f in enumerate(names)]
    return data.sparkSession.createDataFrame(out, "track string, feature string, value double")


def _quadratic_lasso(a: np.ndarray, c: np.ndarray, l1: np.ndarray, l2: np.ndarray, b: np.ndarray, rounds: int = 2_000) -> np.ndarray:
    """Least b'ab / 2 - c'b + l1 |b| + l2 / 2 b^2 by coordinate descent."""
    b = b.copy()
    for _ in range(rounds):
        worst = 0.0
        for j in np.flatnonzero(np.diag(a) > 1e-15):
            r = c[j] - a[j] @ b + a[j, j] * b[j]
            new = np.sign(r) * max(abs(r) - l1[j], 0) / (a[j, j] + l2[j])
            worst = max(worst, abs(new - b[j]))
            b[j] = new
        if worst < 1e-12:
            break
    return b


def random_forest(data: DataFrame, features: list[str], track_index: int = 0, trees: int = 20, depth: int = 5, seed: int = 0) -> DataFrame:
    """Importance and rank per feature of a regression forest."""
    d = data.select(array_to_vector("vec").alias("features"), F.get("y", F.lit(track_index)).alias("label"))
    model = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed).fit(d)
    imp = model.featureImportances.toArray()
    rank = np.argsort(np.argsort(-imp, kind="stable"))
    rows = [(f, float(v), int(r)) for f, v, r in zip(features, imp, rank)]
    return data.sparkSession.createDataFrame(rows, "feature string, importance double, rank long")


def kmer_hotstart(data: DataFrame, features: list[str], tracks: list[str], n_kernels: int, length: int, alphas: tuple[float, ...] = (1.0, 0.3, 0.1, 0.03, 0.01, 0.003)) -> DataFrame:
    """Lasso-selected k-mers as start motifs ``(motif, pos, base, w)``: the first penalty that keeps enough k-mers."""
    from strandframe.operators.motifs import kmer_to_motif

    m = moments(data, features, tracks)
    for a in alphas:
        b = elastic_net(m, a)[1:]
        size = np.abs(b).max(1)
        if (size > 0).sum() >= n_kernels:
            break
    order = np.lexsort((np.array(features), -size))[:n_kernels]
    kmers = data.sparkSession.createDataFrame([(features[i],) for i in order if size[i] > 0], "kmer string")
    return kmer_to_motif(kmers, length)


# ----------------------------------------------------------------- reductions
def _ml(points: DataFrame) -> DataFrame:
    return points.select("name", array_to_vector("vec").alias("features"))


def linear_embedding(points: DataFrame, k: int = 2, standardize: bool = False):
    """PCA model and coordinates ``(name, dims array<double>)``; the model transforms new points."""
    x = _ml(points)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=standardize).fit(x)
    x = scaler.transform(x)
    model = PCA(k=k, inputCol="scaled", outputCol="pcs").fit(x)
    return model, model.transform(x).select("name", vector_to_array("pcs").alias("dims"))


def svd_reduce(points: DataFrame, reduce_to: float, center: bool = True, scores: str = "US") -> DataFrame:
    """Singular vectors of the points: a number of components, or the smallest number that reaches a
    share of variance below 1.  ``US`` or ``U``; columns' signs make the largest loading positive."""
    sums = points.select(F.transform("vec", lambda v: v).alias("vec"), F.array().cast("array<double>").alias("y"))
    p = points.select(F.size("vec")).first()[0]
    m = moments(sums, [str(i) for i in range(p)], [])
    mu = m.xx[0, 1:] / m.n if center else np.zeros(p)
    g = m.xx[1:, 1:] - m.n * np.outer(mu, mu)
    val, vec = np.linalg.eigh(g)
    order = np.argsort(-val)
    val, vec = np.maximum(val[order], 0), vec[:, order]
    k = int(reduce_to) if reduce_to >= 1 else int(np.searchsorted(np.cumsum(val) / val.sum(), reduce_to - 1e-12) + 1)
    vec = vec[:, :k] * np.sign(vec[np.abs(vec[:, :k]).argmax(0), np.arange(k)])
    s = np.sqrt(val[:k])
    if scores == "U":
        vec = vec / np.where(s > 0, s, 1)
    dims = []
    for j in range(k):
        w = F.array(*[F.lit(float(v)) for v in vec[:, j]])
        dot = F.aggregate(F.zip_with("vec", w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        dims.append((dot - float(mu @ vec[:, j])).alias(f"d{j}"))
    return points.select("name", F.array(*dims).alias("dims"))


def nonnegative_factorization(df: DataFrame, k: int, seed: int = 0, iterations: int = 10) -> tuple[DataFrame, DataFrame]:
    """Nonnegative row and column factors ``features`` of ``(row, col, value)``; absent cells are zeros.

    Multiplicative updates: a factor is multiplied by X times the other factor and divided by itself
    times the other's k by k products.  Only cells that are there are joined, and zeros
    count through these products.  Negative, null and NaN cells count as zero, repeated ones add up.
    """
    value = F.when(F.col("value") > 0, F.when(~F.isnan(F.col("value").cast("double")), F.col("value").cast("double"))).otherwise(0.0)
    cells = written(df.groupBy("row", "col").agg(F.sum(F.coalesce(value, F.lit(0.0))).alias("value")))

    def start(key: str, salt: int) -> DataFrame:
        draws = [F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(salt + 2 * i)), F.lit(1_000_003)) / 1_000_003 + 0.1 for i in range(k)]
        return written(cells.select(key).distinct().select(key, F.array(*draws).alias("features")))

    def updated(key: str, mine: DataFrame, other_key: str, other: DataFrame) -> DataFrame:
        sums = other.agg(*[F.sum(F.col("features")[i] * F.col("features")[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        gram = [[float(sums[f"g{min(i, j)}_{max(i, j)}"] or 0.0) for j in range(k)] for i in range(k)]  # k by k numbers
        product = cells.join(other, other_key).groupBy(key).agg(F.array(*[F.sum(F.col("value") * F.col("features")[i]) for i in range(k)]).alias("xf"))
        below = [sum((F.col("features")[j] * gram[j][i] for j in range(1, k)), F.col("features")[0] * gram[0][i]) for i in range(k)]
        new = [F.when(b > 1e-300, F.col("features")[i] * F.col("xf")[i] / b).otherwise(0.0) for i, b in enumerate(below)]
        return written(mine.join(product, key).select(key, F.array(*new).alias("features")))

    rows, cols = start("row", 0), start("col", 1)
    for _ in range(iterations):
        rows = updated("row", rows, "col", cols)
        cols = updated("col", cols, "row", rows)
    return rows, cols

