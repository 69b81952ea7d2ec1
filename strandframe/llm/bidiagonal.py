"""Singular values and right singular vectors of a triangular factor.

Householder reflections make the factor bidiagonal, the differential quotient-difference
iteration with shifts (dqds) finds its singular values, and twisted factorisations of
the shifted normal matrix, written with the same quotients and differences, give their
vectors.  Matrices here have the size of a vector's dimension, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
TINY = 1e-290


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and orthogonal V of ``r = U B V'`` for a square matrix."""
    a = np.array(r, float)
    n = len(a)
    v = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
        size = float(np.linalg.norm(x))
        if size == 0.0:
            return x, 0.0, 0.0
        u = x.copy()
        alpha = -np.copysign(size, x[0])
        u[0] -= alpha
        return u, 2.0 / float(u @ u), alpha

    for k in range(n):
        u, scale, alpha = reflector(a[k:, k])
        if scale:
            a[k:, k:] -= scale * np.outer(u, u @ a[k:, k:])
            a[k, k] = alpha
        if k < n - 1:
            u, scale, alpha = reflector(a[k, k + 1 :])
            if scale:
                a[k:, k + 1 :] -= scale * np.outer(a[k:, k + 1 :] @ u, u)
                a[k, k + 1] = alpha
                v[:, k + 1 :] -= scale * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _swept(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """One dqds transform; False if the shift was above the smallest value."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    for k in range(n - 1):
        if d < 0:
            return q, e, False
        new_q[k] = d + e[k]
        if new_q[k] <= TINY:
            new_e[k], d = 0.0, q[k + 1] - shift
            continue
        ratio = q[k + 1] / new_q[k]
        new_e[k] = e[k] * ratio
        d = d * ratio - shift
    new_q[-1] = d
    return new_q, new_e, d >= 0


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of an upper bidiagonal matrix, falling."""
    scale = float(max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0)))
    if scale == 0.0:
        return np.zeros(len(diagonal))
    blocks = [((diagonal / scale) ** 2, (above / scale) ** 2, 0.0)]
    found = []
    while blocks:
        q, e, moved = blocks.pop()
        failed = 0
        for _ in range(100 * len(q) + 100):
            # a difference that changes no value by more than rounding splits the matrix
            cut = np.flatnonzero(e <= EPS * EPS * (np.minimum(q[:-1], q[1:]) + moved) + TINY) if len(q) > 1 else []
            if len(q) == 1 or len(cut):
                break
            if q[0] * 1.5 < q[-1]:
                q, e = q[::-1].copy(), e[::-1].copy()
            # smaller value of the last two by two, from below
            t, p = q[-1] + e[-1], q[-2] + (e[-2] if len(e) > 1 else 0.0)
            half = (p - t) / 2
            guess = t - q[-2] * e[-1] / (abs(half) + np.hypot(half, np.sqrt(q[-2] * e[-1])) + TINY) if half >= 0 else min(q[-1], p)
            shift = max(0.0, guess) * (1 - 4 * EPS) * 0.25**failed if failed < 6 else 0.0
            new_q, new_e, ok = _swept(q, e, shift)
            if not ok:
                failed += 1
                continue
            q, e, moved, failed = new_q, new_e, moved + shift, 0
        else:
            raise ArithmeticError("dqds did not end")
        if len(q) == 1:
            found.append(q[0] + moved)
            continue
        at = 0
        for c in [*cut.tolist(), len(q) - 1]:
            blocks.append((q[at : c + 1], e[at:c], moved))
            at = c + 1
    return scale * np.sqrt(np.sort(np.maximum(found, 0.0))[::-1])


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B'B near ``value`` from its factorisations from above and from below, joined where they fit best."""
    q, e, off = diagonal**2, above**2, diagonal[:-1] * above
    n = len(q)
    floor = EPS * EPS * max(float(q.max() + e.max(initial=0.0)), TINY)
    down, s = np.empty(n), np.empty(n)
    up, p = np.empty(n), np.empty(n)
    s[0] = -value
    for k in range(n):
        down[k] = s[k] + q[k]
        if abs(down[k]) < floor:
            down[k] = -floor
        if k < n - 1:
            s[k + 1] = s[k] * (e[k] / down[k]) - value
    p[-1] = q[-1] - value
    for k in range(n - 2, -1, -1):
        up[k + 1] = e[k] + p[k + 1]
        if abs(up[k + 1]) < floor:
            up[k + 1] = -floor
        p[k] = p[k + 1] * (q[k] / up[k + 1]) - value
    r = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        z[k] = -off[k] / down[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] = -off[k] / up[k + 1] * z[k]
        if abs(z[k + 1]) > 1e100:
            z /= abs(z[k + 1])
    return z / np.linalg.norm(z)


def _solved(main: np.ndarray, off: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of a symmetric tridiagonal system with entries of about 1 at most, with row exchanges."""
    n = len(main)
    d, u, w, low, x = main.copy(), np.append(off, 0.0), np.zeros(n), off.copy(), b.copy()
    floor = EPS
    for k in range(n - 1):
        if abs(low[k]) > abs(d[k]):
            row = (low[k], d[k + 1], u[k + 1])
            d[k + 1], u[k + 1], low_k = u[k], w[k], d[k]
            d[k], u[k], w[k] = row
            x[k], x[k + 1] = x[k + 1], x[k]
        else:
            low_k = low[k]
        if abs(d[k]) < floor:
            d[k] = floor
        f = low_k / d[k]
        d[k + 1] -= f * u[k]
        u[k + 1] -= f * w[k]
        x[k + 1] -= f * x[k]
    if abs(d[-1]) < floor:
        d[-1] = floor
    for k in range(n - 1, -1, -1):
        x[k] = (x[k] - (u[k] * x[k + 1] if k + 1 < n else 0.0) - (w[k] * x[k + 2] if k + 2 < n else 0.0)) / d[k]
    return x


def leading_vectors(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """All singular values of a square matrix, falling, and the right singular vectors of the first ``count`` as columns."""
    scale = float(np.abs(r).max(initial=0.0)) or 1.0
    diagonal, above, v = bidiagonalise(r / scale)
    values = dqds(diagonal, above)
    count = min(count, len(values))
    top = float(values[0]) if len(values) else 0.0
    if top == 0.0:
        return values * scale, v[:, :count]
    a, b, lam = diagonal / top, above / top, (values / top) ** 2
    main, off = a * a, a[:-1] * b
    main[1:] += b * b
    out: list[np.ndarray] = []
    rng = np.random.default_rng(0)
    begin = 0
    for k in range(count):
        if k and lam[k - 1] - lam[k] > 1e-3:
            begin = k  # well apart: its vector is orthogonal by itself
        near = np.array(out[begin:]).T if k > begin else np.zeros((len(a), 0))
        z = twisted_vector(a, b, lam[k])
        fresh = z - near @ (near.T @ z)
        wrong = np.linalg.norm(main * fresh + np.append(off * fresh[1:], 0) + np.append(0, off * fresh[:-1]) - lam[k] * fresh)
        if near.shape[1] and (np.linalg.norm(fresh) < 0.5 or wrong > 1e-13):
            fresh = rng.standard_normal(len(a))
            for _ in range(5):
                fresh -= near @ (near.T @ fresh)
                fresh = _solved(main - lam[k], off, fresh / np.linalg.norm(fresh))
        for _ in range(2):
            fresh = fresh / np.linalg.norm(fresh)
            fresh -= near @ (near.T @ fresh)
        out.append(fresh / np.linalg.norm(fresh))
    return values * scale, v @ np.array(out).T
