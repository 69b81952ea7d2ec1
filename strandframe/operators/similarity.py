"""Motif alignment by offset and orientation, with padded overhangs.

With values measured from the padding value the padded cells are 0, so all sums
over the union of two motifs come from the overlap product and from totals of
each motif.  A batch of queries is compared with a block of references by one
matrix product per offset.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.special import t_two_sided_np
from strandframe.operators.blocks import against_reference
from strandframe.sources.sinks import motif_rows

METRICS = ("correlation", "cosine", "mse", "correlation_pvalue")
SCHEMA = "a string, b string, dist double, offset int, revcomp boolean, n int, logp double"


def _by_length(pdf: pd.DataFrame) -> dict[int, tuple[list[str], np.ndarray]]:
    groups: dict[int, tuple[list[str], list[np.ndarray]]] = {}
    for name, rows in zip(pdf["motif"], pdf["m"]):
        m = np.array([list(r) for r in rows], dtype=float)
        ids, mats = groups.setdefault(len(m), ([], []))
        ids.append(name)
        mats.append(m)
    return {n: (ids, np.stack(mats)) for n, (ids, mats) in groups.items()}


def _logp(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Signed -log10 p of a Pearson r over n cells (t with n-1 degrees of freedom, small eps)."""
    t = r * np.sqrt(n - 2) / np.sqrt(np.maximum(1 - (r - 1e-7) ** 2, 1e-16))
    p = t_two_sided_np(t, n - 1.0) + 1e-20
    return np.sign(r) * -np.log10(p)


def align_block(a: np.ndarray, b: np.ndarray, metric: str, min_overlap: int, pad: float) -> tuple[np.ndarray, ...]:
    """Best distance, offset, cells and log p of motifs ``a`` (A,la,4) to ``b`` (B,lb,4), one orientation."""
    la, lb = a.shape[1], b.shape[1]
    x, y = a - pad, b - pad
    sx, sy = x.sum((1, 2))[:, None], y.sum((1, 2))[None, :]
    sxx, syy = (x * x).sum((1, 2))[:, None], (y * y).sum((1, 2))[None, :]
    best = np.full((len(a), len(b)), -np.inf)
    off = np.zeros(best.shape, dtype=int)
    cells = np.zeros(best.shape, dtype=int)
    for o in range(-(la - min_overlap), lb - min_overlap + 1):
        lo, hi = max(0, o), min(lb, la + o)
        if hi <= lo:
            continue
        n = (max(la + o, lb) - min(0, o)) * 4
        cross = x[:, lo - o : hi - o].reshape(len(a), -1) @ y[:, lo:hi].reshape(len(b), -1).T
        if metric == "mse":
            s = -(sxx + syy - 2 * cross) / n
        else:
            if metric == "cosine":
                num = cross + pad * (sx + sy) + pad * pad * n
                va, vb = sxx + 2 * pad * sx + pad * pad * n, syy + 2 * pad * sy + pad * pad * n
            else:
                num, va, vb = cross - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
            den = np.sqrt(np.maximum(va, 0) * np.maximum(vb, 0))
            s = np.where(den > 1e-16, num / np.where(den > 1e-16, den, 1), 0.0)
        if metric == "logp":
            s = _logp(s, np.full(s.shape, float(n)))
        better = s > best + 1e-12
        best = np.where(better, s, best)
        off = np.where(better, o, off)
        cells = np.where(better, n, cells)
    return best, off, cells


def _compare(metric: str, min_overlap: int, pad: float, both: bool, select_p: bool, max_dist: float | None):
    core = "logp" if select_p else ("correlation" if metric == "correlation_pvalue" else metric)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        refs = _by_length(right)
        for _, (ids_a, a) in _by_length(left).items():
            for _, (ids_b, b) in refs.items():
                k = min(min_overlap, a.shape[1], b.shape[1])
                s, off, n = align_block(a, b, core, k, pad)
                rc = np.zeros(s.shape, dtype=bool)
                if both:
                    s2, off2, n2 = align_block(a[:, ::-1, ::-1], b, core, k, pad)
                    rc = s2 > s + 1e-12
                    s, off, n = np.where(rc, s2, s), np.where(rc, off2, off), np.where(rc, n2, n)
                if select_p:
                    dist, logp = 10.0 ** (-s), s
                elif metric == "correlation_pvalue":
                    logp = _logp(s, n.astype(float))
                    dist = 10.0 ** (-logp)
                elif metric == "mse":
                    dist, logp = -s, np.full(s.shape, np.nan)
                else:
                    dist, logp = 1 - s, np.full(s.shape, np.nan)
                i, j = np.nonzero(dist < max_dist) if max_dist is not None else np.indices(s.shape).reshape(2, -1)
                out.append(pd.DataFrame({
                    "a": np.asarray(ids_a, object)[i], "b": np.asarray(ids_b, object)[j], "dist": dist[i, j], "offset": off[i, j],
                    "revcomp": rc[i, j], "n": n[i, j], "logp": logp[i, j],
                }))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame()

    return run


def _prepare(motifs: DataFrame, infocont: bool, background: float) -> DataFrame:
    if infocont:
        motifs = motifs.withColumn("w", F.greatest(F.log2((F.col("w") + 1e-8) / background), F.lit(0.0)))
    return motif_rows(motifs)


def motif_similarity(
    motifs: DataFrame, reference: DataFrame, metric: str = "correlation", min_overlap: int = 4, pad: float = 0.25,
    infocont: bool = False, background: float = 0.25, reverse_complement: bool = True, max_dist: float | None = None,
    bound: int = 5_000,
) -> DataFrame:
    """Best offset and orientation of every motif to every reference motif: ``(a, b, dist, offset, revcomp, n, logp)``.

    ``dist`` is 1 - correlation, 1 - cosine, mse or 10^(-signed log p).  ``offset`` is the start of
    ``a`` (reverse-complemented when ``revcomp``) relative to ``b``.  With ``max_dist`` only closer
    pairs leave the task.
    """
    if metric not in METRICS:
        raise ValueError(metric)
    p = np.log2(pad / background) if infocont else pad
    fn = _compare(metric, min_overlap, float(p), reverse_complement, False, max_dist)
    left, right = _prepare(motifs, infocont, background), _prepare(reference, infocont, background)
    return against_reference(left, right, fn, SCHEMA, "motif", "motif", bound=bound)


def motif_similarity_pvalue(
    motifs: DataFrame, reference: DataFrame, min_overlap: int = 4, pad: float = 0.25, reverse_complement: bool = True, bound: int = 5_000
) -> DataFrame:
    """As ``motif_similarity``, with the alignment chosen by the largest signed -log10 p."""
    fn = _compare("correlation_pvalue", min_overlap, pad, reverse_complement, True, None)
    return against_reference(motif_rows(motifs), motif_rows(reference), fn, SCHEMA, "motif", "motif", bound=bound)


def best_reference(pairs: DataFrame) -> DataFrame:
    """Closest reference per motif, also over reference blocks."""
    best = F.min_by(F.struct("b", "dist", "offset", "revcomp"), F.struct("dist", "b"))
    return pairs.groupBy("a").agg(best.alias("x")).select("a", "x.*")


def mirror_pairs(pairs: DataFrame, lengths: DataFrame) -> DataFrame:
    """Add (b, a) for each (a, b): offset -o, or len(a) - len(b) + o when reverse-complemented."""
    la = lengths.select(F.col("motif").alias("a"), F.col("len").alias("la"))
    lb = lengths.select(F.col("motif").alias("b"), F.col("len").alias("lb"))
    j = pairs.join(la, "a").join(lb, "b")
    o = F.when(F.col("revcomp"), F.col("la") - F.col("lb") + F.col("offset")).otherwise(-F.col("offset"))
    flip = j.filter("a <> b").select(
        F.col("b").alias("a"), F.col("a").alias("b"), "dist", o.cast("int").alias("offset"), "revcomp", "n", "logp"
    )
    return pairs.select("a", "b", "dist", "offset", "revcomp", "n", "logp").unionByName(flip)
