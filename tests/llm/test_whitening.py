"""The bidiagonal solver and whitening against the definitions."""

import math

import numpy as np
import pytest

from strandframe.llm.bidiagonal import bidiagonalise, dqds, leading_vectors
from strandframe.llm.queries import QUERIES
from strandframe.llm.whitening import on_grid, whiten

rng = np.random.default_rng(1)
Q = np.linalg.qr(rng.standard_normal((40, 40)))[0]


def with_values(values):
    return np.linalg.qr(Q @ np.diag(values) @ Q.T)[1]


CASES = {
    **{f"random {n}": np.triu(rng.standard_normal((n, n))) for n in (1, 2, 3, 16, 64, 150)},
    "equal": with_values(np.r_[np.ones(20) * 5, np.ones(20) * 2]),
    "close": with_values(np.r_[5 + 1e-9 * np.arange(20), np.ones(20) * 2]),
    "graded": with_values(10.0 ** -np.arange(40)),
    "rank 5": np.linalg.qr(rng.standard_normal((40, 5)) @ rng.standard_normal((5, 40)))[1],
    "zero": np.zeros((6, 6)), "one": np.eye(20), "gaps": np.diag(np.r_[np.zeros(5), np.arange(5.0)]), "small": np.triu(np.full((8, 8), 1e-200)),
}


@pytest.mark.parametrize("name", CASES)
def test_solver(name):
    r = CASES[name]
    top = max(np.abs(r).max(), 1e-300)
    d, e, v = bidiagonalise(r / top)
    want = np.linalg.svd(r / top, compute_uv=False)
    assert np.abs(v.T @ v - np.eye(len(r))).max() < 1e-13
    assert np.abs(dqds(d, e) - want).max() <= 1e-14 * len(r) * max(want[0], 1e-300)
    values, vectors = leading_vectors(r, 16)
    k = vectors.shape[1]
    assert k == min(16, len(r)) and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    left = (r / top).T @ ((r / top) @ vectors) - vectors * (values[:k] / top) ** 2
    assert np.abs(left).max() <= 1e-13 * max(want[0] ** 2, 1e-300)


def test_graded_values_are_accurate_one_by_one():
    d = 10.0 ** -np.arange(12.0)
    got = dqds(d, 0.5 * d[:-1])
    b = np.diag(d) + np.diag(0.5 * d[:-1], 1)
    inverse = np.sort(1 / np.linalg.svd(np.linalg.inv(b), compute_uv=False))  # small values as large ones of the inverse
    assert np.allclose(got[-3:], inverse[:3][::-1], rtol=1e-10)


def check(rows, got, components=16):
    x = {i: tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for i, v in rows}
    fit = sorted(set(x.values()))
    n, a = len(fit), np.array(fit, np.int64)
    sums = a.sum(axis=0)
    centred = (a * n - sums) / n
    cov = centred.T @ centred / n
    e = np.linalg.eigvalsh(cov)[::-1]
    k = min(components, a.shape[1])
    table = {}
    for r in got:
        table.setdefault(r.vec_id, {})[r.component] = r
    assert set(table) == set(x) and all(set(t) == set(range(1, k + 1)) for t in table.values())
    one = next(iter(table.values()))
    for c in range(1, k + 1):
        assert math.isclose(one[c].explained, e[c - 1] / np.trace(cov), rel_tol=1e-8, abs_tol=1e-15)
    live = [c for c in range(1, k + 1) if one[c].whitened is not None]
    # rows of one vector each once: the covariance of what came out is one
    by_x = {v: [table[i][c].whitened for c in live] for i, v in x.items()}
    w = np.array([by_x[v] for v in fit])
    w0 = w - w.mean(axis=0)
    assert np.abs(w0.T @ w0 / n - np.eye(len(live))).max() < 1e-8
    assert all(r.identity_error < 1e-8 and r.n == n for r in got)
    # projecting back: cov @ direction = e * direction, the direction recovered from rows and results
    direction = centred.T @ w / n / np.sqrt(e[: len(live)])
    assert np.abs(cov @ direction - direction * e[: len(live)]).max() <= 1e-9 * e[0]
    assert np.abs(np.linalg.norm(direction, axis=0) - 1).max() < 1e-9
    for i, v in x.items():
        assert {r.deviation for r in table[i].values()} == {sum((n * c - int(s)) ** 2 for c, s in zip(v, sums))}


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    df = QUERIES["op13_embedding_whitening"](spark, sf)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check([(r.vec_id, r.embedding) for r in rows if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)], df.collect())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [math.sin(i * 1.7), math.cos(i * i), 0.5, 0.01 * i, math.sin(i * 1.7)]) for i in range(40)] + [(90, [math.sin(0.0), 1.0, 0.5, 0.0, 0.0])]
    bad = [(50, None), (51, []), (52, [1.0, None, 1.0, 1.0, 1.0]), (53, [nan] * 5), (54, [1.0, inf, 1.0, 1.0, 1.0]), (55, [1.0, 2.0])]
    make = lambda rows: spark.createDataFrame([(i, v, "x", 7, 8) for i, v in rows], "vec_id long, embedding array<double>, id string, x int, n int").repartition(5)
    got = whiten(on_grid(make(good + bad))).collect()
    check(good, got)
    assert {r.component for r in got if r.whitened is None} == {4, 5}  # one dimension constant, one copied
    assert whiten(on_grid(make(good).limit(0))).count() == 0
    assert whiten(on_grid(make(bad[:5]))).count() == 0
    alone = whiten(on_grid(make([(None, [1.0, 2.0]), (None, [1.0, 2.0])]))).collect()
    assert [(r.vec_id, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(None, 1, 0, None, None, None)] * 4


def test_deviation_beyond_a_long_is_null(spark):
    rows = spark.createDataFrame([(i, [float(10**7 * i)]) for i in range(4)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whiten(on_grid(rows)).collect()}
    apart = {i: (4 * 64 * 10**7 * i - 64 * 10**7 * 6) ** 2 for i in range(4)}
    assert got == {i: v if v < 1 << 63 else None for i, v in apart.items()}
