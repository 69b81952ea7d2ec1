"""Tail probabilities as vectorised Arrow functions (no SciPy needed).

They only run on aggregated test statistics, never per input row of a big table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _erfc(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    return np.array([math.erfc(v) for v in x.ravel()]).reshape(x.shape)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma with one evaluation per distinct argument."""
    u, back = np.unique(np.asarray(x, float), return_inverse=True)
    return np.array([math.lgamma(v) if v > 0 else math.inf for v in u])[back].reshape(np.shape(x))


@F.pandas_udf(T.DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    """Upper tail of the standard normal."""
    return pd.Series(0.5 * _erfc(z.to_numpy(float) / math.sqrt(2.0))) if len(z) else pd.Series([], dtype=float)


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    with np.errstate(all="ignore"):
        front = np.exp(
            aa * np.log(np.maximum(xx, tiny)) + bb * np.log1p(-np.minimum(xx, 1 - 1e-16))
            - (_lgamma(aa) + _lgamma(bb) - _lgamma(aa + bb)) - np.log(aa)
        )
        c = np.ones_like(xx)
        d = 1 - (aa + bb) * xx / (aa + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            num = m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m))
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
            num = -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h *= step
            if np.all(np.abs(step - 1) < 1e-15):
                break
        out = front * h
    out = np.where(xx <= 0, 0.0, out)
    return np.where(flip, 1 - out, out)


def t_two_sided_np(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    return beta_inc(dof / 2, np.full_like(dof, 0.5), dof / (dof + t * t))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p value of a t statistic."""
    if not len(t):
        return pd.Series([], dtype=float)
    return pd.Series(t_two_sided_np(t.to_numpy(float), dof.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def t_isf(p: pd.Series, dof: pd.Series) -> pd.Series:
    """t with two-sided tail ``p`` (bisection on the tail)."""
    if not len(p):
        return pd.Series([], dtype=float)
    pv, nu = p.to_numpy(float), dof.to_numpy(float)
    lo, hi = np.zeros_like(pv), np.full_like(pv, 1e8)
    for _ in range(200):
        mid = (lo + hi) / 2
        big = t_two_sided_np(mid, nu) > pv
        lo, hi = np.where(big, mid, lo), np.where(big, hi, mid)
    return pd.Series((lo + hi) / 2)


@F.pandas_udf(T.DoubleType())
def correlation_tail(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a Pearson r from n points (exact beta form)."""
    if not len(r):
        return pd.Series([], dtype=float)
    ab = n.to_numpy(float) / 2 - 1
    return pd.Series(2 * beta_inc(ab, ab, 0.5 * (1 - np.abs(r.to_numpy(float)))))


@F.pandas_udf(T.DoubleType())
def log_factorial(n: pd.Series) -> pd.Series:
    return pd.Series(_lgamma(n.to_numpy(float) + 1)) if len(n) else pd.Series([], dtype=float)


@F.pandas_udf(T.StructType([T.StructField("p_more", T.DoubleType()), T.StructField("p_less", T.DoubleType())]))
def fisher_tails(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    """One-sided Fisher tails of a 2x2 table [[a,b],[c,d]]: more and fewer in cell a."""
    more, less = [], []
    for w, x, y, z in zip(a, b, c, d):
        w, x, y, z = int(w), int(x), int(y), int(z)
        rows, cols, total = w + x, w + y, w + x + y + z
        ks = np.arange(max(0, cols - (total - rows)), min(rows, cols) + 1)
        logp = (
            _lgamma(rows + 1.0) - _lgamma(ks + 1.0) - _lgamma(rows - ks + 1.0)
            + _lgamma(total - rows + 1.0) - _lgamma(cols - ks + 1.0) - _lgamma(total - rows - cols + ks + 1.0)
            - (_lgamma(total + 1.0) - _lgamma(cols + 1.0) - _lgamma(total - cols + 1.0))
        )
        p = np.exp(logp)
        more.append(min(1.0, float(p[ks >= w].sum())))
        less.append(min(1.0, float(p[ks <= w].sum())))
    return pd.DataFrame({"p_more": more, "p_less": less})
