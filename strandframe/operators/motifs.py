"""Motif tables in long form ``(motif, pos, base, w)``: transforms, scans and consensus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.functions import sequence as S
from strandframe.operators.blocks import against_reference, spread
from strandframe.operators.matrix import attach, attach_small
from strandframe.session import maybe_broadcast, written
from strandframe.sources.sinks import motif_rows

KEY = ["motif"]
# fixed values: the standard degenerate letter of each set of bases
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "AG": "R", "CT": "Y", "CG": "S", "AT": "W", "GT": "K", "AC": "M",
    "CGT": "B", "AGT": "D", "ACT": "H", "ACG": "V", "ACGT": "N", "": "N",
}


def _complement(base: Column) -> Column:
    return F.translate(base, "ACGT", "TGCA")


def reverse_motif(motifs: DataFrame) -> DataFrame:
    """Reverse complement of every motif."""
    m = attach_small(motifs, KEY, __n=F.max("pos"))
    return m.select("motif", (F.col("__n") - F.col("pos")).alias("pos"), _complement(F.col("base")).alias("base"), "w")


def motif_to_kmer(motifs: DataFrame) -> DataFrame:
    """Best base per non-empty position; the first letter in A, C, G, T order wins a tie."""
    order = -F.instr(F.lit("ACGT"), F.col("base"))
    best = motifs.groupBy("motif", "pos").agg(
        F.max_by("base", F.struct("w", order)).alias("b"), F.sum(F.abs("w")).alias("s")
    )
    ordered = F.sort_array(F.collect_list(F.struct("pos", "b")))
    return best.filter("s > 0").groupBy("motif").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "").alias("kmer"))


def kmer_to_motif(kmers: DataFrame, length: int | None = None) -> DataFrame:
    """One-hot motif of total 1, centred into ``length`` positions."""
    size = F.length("kmer")
    letters = kmers.select("kmer", size.alias("n"), F.posexplode(F.split("kmer", "")).alias("i", "letter")).filter("letter <> ''")
    left = F.floor((F.lit(length) - F.col("n")) / 2).cast("int") if length else F.lit(0)
    cells = letters.select(
        F.col("kmer").alias("motif"), (F.col("i") + left).cast("int").alias("pos"), F.col("letter").alias("base"), (1 / F.col("n")).alias("w")
    )
    total = F.lit(length) if length else size
    grid = kmers.select(
        F.col("kmer").alias("motif"), F.explode(F.sequence(F.lit(0), (total - 1).cast("int"))).alias("pos")
    ).select("motif", "pos", F.explode(F.array(*[F.lit(b) for b in "ACGT"])).alias("base"))
    return grid.join(cells, ["motif", "pos", "base"], "left").select("motif", "pos", "base", F.coalesce("w", F.lit(0.0)).alias("w"))


def pad_motifs(motifs: DataFrame, length: int, all_shifts: bool = False) -> DataFrame:
    """Move each motif to the centre of ``length`` positions, or give one copy per shift.

    The padding stays implicit (absent cells are 0).
    """
    m = attach_small(motifs, KEY, __n=F.max("pos")).withColumn("__n", F.col("__n") + 1)
    if all_shifts:
        shifts = F.explode(F.sequence(F.lit(0), (F.lit(length) - F.col("__n")).cast("int"))).alias("shift")
        return m.select("*", shifts).select("motif", "shift", (F.col("pos") + F.col("shift")).alias("pos"), "base", "w")
    return m.select("motif", (F.col("pos") + F.floor((F.lit(length) - F.col("__n")) / 2).cast("int")).alias("pos"), "base", "w")


def rescale_motif(motifs: DataFrame, infocont: bool = False, psam: bool = False, norm: bool = False) -> DataFrame:
    """log2((p+0.001)*4) floored at -2, divide by the position's max-abs, divide by length*std."""
    m = motifs
    if infocont:
        m = m.withColumn("w", F.greatest(F.log2((F.col("w") + 0.001) * 4.0), F.lit(-2.0)))
    if psam:
        m = attach_small(m, ["motif", "pos"], __t=F.max(F.abs("w")))
        m = m.withColumn("w", F.col("w") / F.when(F.col("__t") == 0, 1.0).otherwise(F.col("__t"))).drop("__t")
    if norm:
        m = attach_small(m, KEY, __n=F.max("pos"), __s=F.stddev_pop("w"))
        m = m.withColumn("w", F.try_divide(F.col("w"), (F.col("__n") + 1) * F.col("__s"))).drop("__n", "__s")
    return m.select("motif", "pos", "base", "w")


_NORMS = {
    "sumpos": (["motif", "pos"], lambda w: F.sum(w)),
    "absumpos": (["motif", "pos"], lambda w: F.sum(F.abs(w))),
    "maxpos": (["motif", "pos"], lambda w: F.max(w)),
    "absmaxpos": (["motif", "pos"], lambda w: F.max(F.abs(w))),
    "sum": (KEY, lambda w: F.sum(w)),
    "absum": (KEY, lambda w: F.sum(F.abs(w))),
    "max": (KEY, lambda w: F.max(w)),
    "absmax": (KEY, lambda w: F.max(F.abs(w))),
    "zscore": (KEY, lambda w: F.sqrt(F.sum(w * w))),
}
_EDGE = {
    "sum": lambda w: F.sum(w), "absum": lambda w: F.sum(F.abs(w)), "max": lambda w: F.max(w), "absmax": lambda w: F.max(F.abs(w)),
}


def strip_motif(motifs: DataFrame, cut: float, metric: str = "absum", relative: bool = True) -> DataFrame:
    """Keep the stretch from the first to the last position over the cut-off; positions restart at 0."""
    per = motifs.groupBy("motif", "pos").agg(_EDGE[metric](F.col("w")).alias("v"))
    if relative:
        per = attach_small(per, KEY, top=F.max("v")).filter(F.col("v") >= cut * F.col("top"))
    else:
        per = per.filter(F.col("v") >= cut)
    lim = per.groupBy("motif").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    m = motifs.join(lim, "motif").filter(F.col("pos").between(F.col("lo"), F.col("hi")))
    return m.select("motif", (F.col("pos") - F.col("lo")).alias("pos"), "base", "w")


def transform_motif(motifs: DataFrame, steps: list[str]) -> DataFrame:
    """Ordered chain: ``exp``, ``negate``, ``pseudo=X``, ``strip=X``, ``norm=NAME``, ``standard``, ``sign``, ``infocont``."""
    m = motifs.select("motif", "pos", "base", "w")
    for s in steps:
        name, _, arg = s.partition("=")
        if name == "exp":
            m = m.withColumn("w", F.exp("w"))
        elif name == "negate":
            m = m.withColumn("w", -F.col("w"))
        elif name == "pseudo":
            m = m.withColumn("w", F.col("w") + float(arg))
        elif name == "strip":
            m = strip_motif(m, float(arg))
        elif name == "norm":
            keys, agg = _NORMS[arg]
            m = attach(m, keys, __t=agg(F.col("w"))).select("motif", "pos", "base", F.try_divide(F.col("w"), F.col("__t")).alias("w"))
        elif name == "standard":
            per = m.groupBy("motif", "pos").agg(F.sum("w").alias("s")).groupBy("motif").agg(F.max("s").alias("__t"))
            m = m.join(per, "motif").select("motif", "pos", "base", (F.col("w") / F.col("__t")).alias("w"))
        elif name == "sign":
            m = attach_small(m, KEY, __t=F.sum("w")).select("motif", "pos", "base", (F.col("w") * F.signum("__t")).alias("w"))
        elif name == "infocont":
            m = m.withColumn("w", F.greatest(F.log2((F.col("w") + 1e-16) / 0.25), F.lit(0.0)))
        else:
            raise ValueError(s)
    return m


def motif_to_iupac(motifs: DataFrame, background: float = 0.25) -> DataFrame:
    """Degenerate letter per position from the bases above background."""
    over = F.collect_set(F.when(F.col("w") > background, F.col("base")))
    score = motifs.groupBy("motif", "pos").agg(F.array_join(F.sort_array(over), "").alias("s"))
    table = F.create_map(*[x for k, v in IUPAC.items() for x in (F.lit(k), F.lit(v))])
    ordered = F.sort_array(F.collect_list(F.struct("pos", F.element_at(table, F.col("s")).alias("c"))))
    return score.groupBy("motif").agg(F.array_join(F.transform(ordered, lambda x: x["c"]), "").alias("iupac"))


def kernel_to_ppm(kernels: DataFrame, bias: DataFrame | None = None, background: float = 0.25) -> DataFrame:
    """Spread the bias, divide by the std, add log2 of 1/background (log2 of 1/4 by default), 2^x, scale to the largest position sum."""
    k = attach(kernels, KEY, __n=F.count(F.lit(1)), __s=F.stddev_pop("w"))
    w = F.col("w")
    if bias is not None:
        k = k.join(bias, "motif")
        w = w + F.col("bias") / F.col("__n")
    x = k.select("motif", "pos", "base", F.pow(F.lit(2.0), w / F.col("__s") + F.log2(F.lit(background))).alias("w"))
    top = x.groupBy("motif", "pos").agg(F.sum("w").alias("s")).groupBy("motif").agg(F.max("s").alias("__t"))
    return x.join(top, "motif").select("motif", "pos", "base", (F.col("w") / F.col("__t")).alias("w"))


def info_content(motifs: DataFrame, background: float = 0.25) -> DataFrame:
    """Mean over positions of sum -p*log2(p/background) (kept sign) and its positive form."""
    term = F.when(F.col("w") > 0, -F.col("w") * F.log2(F.col("w") / background)).otherwise(0.0)
    per = motifs.groupBy("motif", "pos").agg(F.sum(term).alias("t")).groupBy("motif").agg(F.avg("t").alias("info_content"))
    return per.withColumn("information", -F.col("info_content"))


def reduce_by_name(motifs: DataFrame, sep: str = "_") -> DataFrame:
    """Mean of equal-length motifs that share the name before the last separator."""
    stem = F.regexp_replace("motif", f"{sep}[^{sep}]*$", "")
    return motifs.groupBy(stem.alias("motif"), "pos", "base").agg(F.avg("w").alias("w"))


# ------------------------------------------------------------------- scanning
_CODE = np.full(256, 4, dtype=np.int64)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _i


def _kernel_bank(ref: pd.DataFrame, target: int) -> tuple[list[str], np.ndarray]:
    """Motifs centred in ``target`` positions as one (motif, target, 5) bank; code 4 (unknown base) scores 0."""
    bank = np.zeros((len(ref), target, 5))
    for i, rows in enumerate(ref["m"]):
        m = np.array([list(r) for r in rows], dtype=float)
        at = (target - len(m)) // 2
        bank[i, at : at + len(m), :4] = m
    return list(ref["motif"]), bank


def _scores(seq: str, bank: np.ndarray) -> np.ndarray:
    """(motif, start) scores of one sequence."""
    codes = _CODE[np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8)]
    n = len(codes) - bank.shape[1] + 1
    out = np.zeros((bank.shape[0], n))
    for j in range(bank.shape[1]):
        out += bank[:, j, codes[j : j + n]]
    return out


def pwm_scan(
    seqs: DataFrame, motifs: DataFrame, pooling: str = "Max", pool_size: int | None = None, pool_step: int | None = None,
    cutoff: float | None = None, set_to: float = 0.0, maxscale: bool = False,
) -> DataFrame:
    """Motif score at every start, pooled by window: ``(name, motif, window, score)``.

    Every motif is scored at its own length, at all starts where it fits; a sequence has no row
    for a motif longer than itself.  The last partial window is scored.  ``maxscale`` divides by the motif's largest pooled score.
    """
    ref = motif_rows(motifs)
    mean = pooling == "Mean"

    def compare(part: pd.DataFrame, bank_rows: pd.DataFrame) -> pd.DataFrame:
        banks = [_kernel_bank(rows, k) for k, rows in bank_rows.groupby(bank_rows["m"].map(len)) if k]
        out_n, out_m, out_w, out_s = [], [], [], []
        for name, seq in zip(part["name"], part["seq"]):
            for names, bank in banks:
                if len(seq) < bank.shape[1]:
                    continue
                sc = _scores(seq, bank)
                n = sc.shape[1]
                size = min(pool_size or n, n)
                step = pool_step or size
                starts = list(range(0, max(n - size, 0) + 1, step))
                if starts[-1] + size < n:
                    starts.append(starts[-1] + step)
                for w, lo in enumerate(starts):
                    block = sc[:, lo : lo + size]
                    out_s.append(block.mean(axis=1) if mean else block.max(axis=1))
                    out_n.extend([name] * len(names))
                    out_m.extend(names)
                    out_w.extend([w] * len(names))
        if not out_s:
            return pd.DataFrame({"name": [], "motif": [], "window": [], "score": []})
        return pd.DataFrame({"name": out_n, "motif": out_m, "window": out_w, "score": np.concatenate(out_s)})

    out = against_reference(
        seqs.select("name", "seq"), ref, compare, "name string, motif string, window int, score double", "name", "motif", bound=4_000
    )
    if maxscale:
        out = attach(out, ["motif"], __t=F.max("score"))
        out = out.withColumn("score", F.try_divide(F.col("score"), F.col("__t"))).drop("__t")
    if cutoff is not None:
        out = out.withColumn("score", F.when(F.col("score") < cutoff, F.lit(set_to)).otherwise(F.col("score")))
    return out


ACTIVATIONS = {
    "none": lambda x: x,
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "exp": lambda x: F.exp(x),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "log": lambda x: F.log(F.greatest(x, F.lit(0.0)) + 1),
}


def kernel_activation(seqlets: DataFrame, kernels: DataFrame, bias: DataFrame | None = None, activation: str = "none") -> DataFrame:
    """Dot product of kernel and seqlet plus bias, then the activation: ``(seqlet, motif, act)``.

    Kernel and seqlet of different lengths are laid centre on centre; what lies outside of either
    adds nothing.  The products run on letter codes in
    Arrow batches, so a seqlet is never exploded into one row per base and kernel.
    """
    ref = motif_rows(kernels)
    target = ref.agg(F.max(F.size("m"))).first()[0] or 1

    def compare(part: pd.DataFrame, bank_rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for length, same in part.groupby(part["seqlet"].str.len()):
            width = max(int(length), target)
            names, bank = _kernel_bank(bank_rows, width)
            text = "".join(same["seqlet"]).encode("ascii", "replace")
            codes = np.full((len(same), width), 4)
            at = (width - int(length)) // 2
            codes[:, at : at + int(length)] = _CODE[np.frombuffer(text, dtype=np.uint8)].reshape(len(same), int(length))
            act = np.zeros((len(names), len(same)))
            for j in range(width):
                act += bank[:, j, codes[:, j]]
            out.append(pd.DataFrame({"seqlet": np.repeat(same["seqlet"].to_numpy(), len(names)), "motif": names * len(same), "act": act.T.ravel()}))
        return pd.concat(out) if out else pd.DataFrame()

    act = against_reference(
        seqlets.select("seqlet"), ref, compare, "seqlet string, motif string, act double", "seqlet", "motif", bound=4_000, batch=4_096
    )
    if bias is not None:
        act = act.join(bias, "motif").withColumn("act", F.col("act") + F.col("bias")).drop("bias")
    return act.select("seqlet", "motif", ACTIVATIONS[activation](F.col("act")).alias("act"))


def _with_totals(df: DataFrame, **aggs: Column) -> DataFrame:
    """As ``attach`` per motif; the totals are stored, and few of them go to the rows, which then stay where they are."""
    totals = written(df.groupBy(*KEY).agg(*[c.alias(n) for n, c in aggs.items()]))
    return df.join(maybe_broadcast(totals), KEY)


def pwm_from_activations(activations: DataFrame, cut: float, z_score: bool = True, pseudo: float = 0.025) -> DataFrame:
    """Activation-weighted base frequencies of the seqlets that pass.

    Activations are scaled to 0-1 per kernel; the cut is on them, or mean + cut * std.
    The pseudo count is spread over the passing seqlets and adds up to ``pseudo`` per cell.
    """
    a = _with_totals(activations, lo=F.min("act"), hi=F.max("act"))
    a = a.select("seqlet", "motif", F.try_divide(F.col("act") - F.col("lo"), F.col("hi") - F.col("lo")).alias("act"))
    if z_score:
        a = _with_totals(a, mu=F.avg("act"), sd=F.stddev_pop("act"))
        a = a.filter(F.col("act") >= F.col("mu") + cut * F.col("sd"))
    else:
        a = a.filter(F.col("act") >= cut)
    cells = a.select("motif", "act", F.posexplode(F.split("seqlet", "")).alias("pos", "base")).filter(F.col("base").isin(*S.ALPHABET))
    s = cells.groupBy("motif", "pos", "base").agg(F.sum("act").alias("s"))
    grid = s.select("motif", "pos").distinct().select("motif", "pos", F.explode(F.array(*[F.lit(b) for b in "ACGT"])).alias("base"))
    full = grid.join(s, ["motif", "pos", "base"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)) + pseudo)
    full = attach_small(full, ["motif", "pos"], __t=F.sum("s"))
    return full.select("motif", "pos", "base", (F.col("s") / F.col("__t")).alias("w"))


# ------------------------------------------------------------------ consensus
def consensus_motif(
    motifs: DataFrame, clusters: DataFrame, pairs: DataFrame, norm: str = "max", remove_low: float = 0.075, min_length: int = 3
) -> DataFrame:
    """Join the motifs of a cluster on its most similar member.

    ``clusters`` is ``(motif, cluster)``; ``pairs`` is ``(a, b, dist, offset, revcomp)`` with the
    alignment of ``a`` to ``b``.  Cells are shifted, reverse-complemented where asked, summed,
    normalised (``max``: largest coverage, ``mean``: coverage per position, ``sum``: position total)
    and cut to the stretch over ``remove_low`` of the largest position.
    """
    c = clusters.filter("cluster >= 0")
    inside = (
        pairs.join(c.select(F.col("motif").alias("a"), "cluster"), "a")
        .join(c.select(F.col("motif").alias("b"), F.col("cluster").alias("cb")), "b")
        .filter("cluster = cb")
        .drop("cb")
    )
    total = inside.groupBy("cluster", "a").agg(F.sum(1 - F.col("dist")).alias("s"))
    centre = total.groupBy("cluster").agg(F.max_by("a", F.struct("s", "a")).alias("centre"))
    to_centre = inside.join(centre, "cluster").filter("b = centre AND a <> centre").select("cluster", F.col("a").alias("motif"), "offset", "revcomp")
    own = c.join(centre, "cluster", "left").filter("centre IS NULL OR motif = centre").select(
        "cluster", "motif", F.lit(0).alias("offset"), F.lit(False).alias("revcomp")
    )
    al = to_centre.unionByName(own)
    m = attach_small(motifs.select("motif", "pos", "base", "w"), KEY, __n=F.max("pos"))
    cells = m.join(al, "motif").select(
        "cluster", "motif",
        (F.when(F.col("revcomp"), F.col("__n") - F.col("pos")).otherwise(F.col("pos")) + F.col("offset")).alias("pos"),
        F.when(F.col("revcomp"), _complement(F.col("base"))).otherwise(F.col("base")).alias("base"), "w",
    )
    s = cells.groupBy("cluster", "pos", "base").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("cover"))
    if norm == "max":
        s = attach(s, ["cluster"], __t=F.max("cover")).withColumn("w", F.col("w") / F.col("__t")).drop("__t")
    elif norm == "mean":
        s = s.withColumn("w", F.col("w") / F.col("cover"))
    elif norm == "sum":
        s = attach_small(s, ["cluster", "pos"], __t=F.sum(F.abs("w"))).withColumn("w", F.try_divide(F.col("w"), F.col("__t"))).drop("__t")
    per = s.groupBy("cluster", "pos").agg(F.sum(F.abs("w")).alias("v"))
    per = attach(per, ["cluster"], top=F.max("v")).filter(F.col("v") > remove_low * F.col("top"))
    lim = per.groupBy("cluster").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    lim = lim.filter(F.col("hi") - F.col("lo") + 1 >= min_length)
    out = s.join(lim, "cluster").filter(F.col("pos").between(F.col("lo"), F.col("hi")))
    return out.select("cluster", (F.col("pos") - F.col("lo")).alias("pos"), "base", "w")


# ------------------------------------------------------- scoring and mutations
def linear_score(seqs: DataFrame, motifs: DataFrame) -> DataFrame:
    """Sum over motifs of the best match score, a linear scorer for ``mutation_scan``: ``(name, score)``."""
    return pwm_scan(seqs, motifs).groupBy("name").agg(F.sum("score").alias("score"))


def mutation_scan(seqs: DataFrame, scorer, zero_mean: bool = True) -> DataFrame:
    """Score change for every single-base substitution: ``(name, pos, base, effect)``.

    ``scorer`` takes ``(name, seq)`` and gives ``(name, track, score)``.  Mutants and references
    are scored in one pass.  With ``zero_mean`` the effects of a position add up to 0.
    """
    base = seqs.select("name", "seq", F.length("seq").alias("n")).filter("n > 0")
    pos = base.select("name", "seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    letter = F.expr("substring(seq, pos + 1, 1)")
    mut = pos.select("name", "seq", "pos", letter.alias("ref"), F.explode(F.array(*[F.lit(b) for b in "ACGT"])).alias("base"))
    copy = F.expr("concat(substring(seq, 1, pos), base, substring(seq, pos + 2, length(seq)))")
    key = F.concat_ws("|", F.col("name"), F.col("pos").cast("string"), F.col("base"))
    mutants = mut.filter("base <> ref").select(key.alias("name"), copy.alias("seq"))
    refs = base.select(F.concat(F.col("name"), F.lit("|-1|")).alias("name"), "seq")
    scored = scorer(mutants.unionByName(refs))
    parts = scored.select(
        F.regexp_extract("name", r"^(.*)\|(-?\d+)\|([ACGT]?)$", 1).alias("name"),
        F.regexp_extract("name", r"^(.*)\|(-?\d+)\|([ACGT]?)$", 2).cast("int").alias("pos"),
        F.regexp_extract("name", r"^(.*)\|(-?\d+)\|([ACGT]?)$", 3).alias("base"), "track", "score",
    )
    wild = parts.filter("pos < 0").select("name", "track", F.col("score").alias("s0"))
    eff = parts.filter("pos >= 0").join(wild, ["name", "track"]).select(
        "name", "track", "pos", "base", (F.col("score") - F.col("s0")).alias("effect")
    )
    zero = mut.filter("base = ref").select("name", "pos", "base").join(wild.select("name", "track"), "name")
    eff = eff.unionByName(zero.select("name", "track", "pos", "base", F.lit(0.0).alias("effect")))
    if zero_mean:
        eff = attach_small(eff, ["name", "track", "pos"], __t=F.avg("effect")).withColumn("effect", F.col("effect") - F.col("__t")).drop("__t")
    return eff


def batch_predict(seqs: DataFrame, predict, tracks: list[str], shifts: list[int] | None = None, fill: str = "N") -> DataFrame:
    """Predictions ``(name, track, value)`` in Arrow batches; mean over shifted copies when given.

    ``predict`` takes a list of sequences and gives an array (sequence, track).
    """
    copies = F.array(*[S.shift(F.col("seq"), F.lit(s), fill) for s in (shifts or [0])])
    x = seqs.select("name", F.explode(copies).alias("seq"))
    names = list(tracks)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            y = np.asarray(predict(list(part["seq"])), dtype=float).reshape(len(part), len(names))
            yield pd.DataFrame({"name": np.repeat(part["name"].to_numpy(), len(names)), "track": names * len(part), "value": y.ravel()})

    out = x.mapInPandas(run, "name string, track string, value double")
    return out.groupBy("name", "track").agg(F.avg("value").alias("value"))


def masked_prediction_average(seqs: DataFrame, predict_positions, width: int, n_masks: int, seed: int = 0) -> DataFrame:
    """Per-position prediction from masked copies ``(name, pos, value)``.

    ``n_masks`` window starts per sequence are chosen by hash.  A position takes the mean over the
    copies in which it was masked, or over all copies when it never was.
    ``predict_positions`` takes a list of sequences and gives one array per sequence.  The copies of a
    sequence are added up where they are made, so one row per position is shuffled.
    """
    n = F.length("seq")
    draw = F.transform(
        F.sequence(F.lit(0), F.lit(n_masks - 1)),
        lambda i: F.pmod(F.xxhash64(F.col("name"), i, F.lit(seed)), F.greatest(n - width + 1, F.lit(1))).cast("int"),
    )
    x = spread(seqs.filter(n > 0).select("name", "seq", draw.alias("starts")), "name")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = max(1, 256 // n_masks)
        for part in parts:
            for lo in range(0, len(part), size):
                p = part.iloc[lo : lo + size]
                ys = iter(predict_positions([_masked(seq, s, width) for seq, starts in zip(p["seq"], p["starts"]) for s in starts]))
                sums = [_masked_sums(starts, [np.asarray(next(ys), dtype=float) for _ in starts], width) for starts in p["starts"]]
                cells = {c: np.concatenate([s[c] for s in sums]) for c in sums[0]}
                yield pd.DataFrame({"name": np.repeat(p["name"].to_numpy(), [len(s["pos"]) for s in sums]), **cells})

    name = seqs.schema["name"].dataType.simpleString()
    y = x.mapInPandas(run, f"name {name}, pos int, masked_sum double, masked_n long, total double, n long")
    t = y.groupBy("name", "pos").agg(*[F.sum(c).alias(c) for c in ("masked_sum", "masked_n", "total", "n")])
    return t.select("name", "pos", F.coalesce(F.try_divide("masked_sum", "masked_n"), F.try_divide("total", "n")).alias("value"))


def _masked(seq: str, start: int, width: int) -> str:
    stop = min(start + width, len(seq))
    return seq[:start] + "N" * (stop - start) + seq[stop:]


def _masked_sums(starts, ys: list[np.ndarray], width: int) -> dict[str, np.ndarray]:
    """Sums per position over the copies of one sequence: where it was masked, and over all.  NaN is no prediction."""
    size = max(map(len, ys))
    masked_sum, total, masked_n, n = np.zeros(size), np.zeros(size), np.zeros(size, int), np.zeros(size, int)
    for start, y in zip(starts, ys):
        ok, y = ~np.isnan(y), np.nan_to_num(y, posinf=np.inf, neginf=-np.inf)
        at = slice(start, min(start + width, len(y)))
        masked_sum[at] += y[at]
        masked_n[at] += ok[at]
        total[: len(y)] += y
        n[: len(y)] += ok
    return {"pos": np.arange(size), "masked_sum": masked_sum, "masked_n": masked_n, "total": total, "n": n}
