"""Row-wise sequence operators and exact word scans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions import sequence as S
from strandframe.operators.blocks import against_reference


def reverse_complement(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("seq", S.reverse_complement(F.col("seq")))


def onehot(seqs: DataFrame, alphabet: str = S.ALPHABET) -> DataFrame:
    """Dense ``(name, onehot)`` for a model boundary."""
    return seqs.select("name", S.onehot(F.col("seq"), alphabet).alias("onehot"))


def onehot_long(seqs: DataFrame, align: str = "left", length: int | None = None, alphabet: str = S.ALPHABET) -> DataFrame:
    """Sparse one-hot ``(name, pos, base)``.

    ``right`` and ``center`` need the padded ``length``; when it is not given the
    longest sequence sets it.  ``bidirectional`` writes the sequence at both ends
    of ``2 * length + 20`` positions.
    """
    n = F.length("seq")
    base = seqs.select("name", "seq", n.alias("n"), F.posexplode(F.split("seq", "")).alias("i", "base")).filter(
        F.col("base") != ""
    )
    base = base.filter(F.instr(F.lit(alphabet), F.col("base")) > 0)
    if align == "left":
        return base.select("name", F.col("i").alias("pos"), "base")
    if length is None:
        top = F.broadcast(seqs.agg(F.max(n).alias("len")))
        base = base.join(top)
    else:
        base = base.withColumn("len", F.lit(length))
    if align == "right":
        pos = [F.col("len") - F.col("n") + F.col("i")]
    elif align == "center":
        pos = [F.floor((F.col("len") - F.col("n")) / 2) + F.col("i")]
    elif align == "bidirectional":
        pos = [F.col("i"), 2 * F.col("len") + 20 - F.col("n") + F.col("i")]
    else:
        raise ValueError(align)
    return base.select("name", F.explode(F.array(*[p.cast("int") for p in pos])).alias("pos"), "base")


def add_region_channels(bases: DataFrame, positions: DataFrame) -> DataFrame:
    """Attach region channels ``(name, pos, region)`` to a sparse one-hot table."""
    extra = positions.select("name", "pos", F.col("region").alias("base"))
    return bases.select("name", "pos", "base").unionByName(extra.join(bases.select("name").distinct(), "name", "left_semi"))


def split_seqlets(seqs: DataFrame, size: int) -> DataFrame:
    """All windows of one length with their 0-based start."""
    return seqs.select("name", F.posexplode(S.windows(F.col("seq"), size)).alias("start", "seqlet"))


def unique_seqlets(seqlets: DataFrame) -> DataFrame:
    return seqlets.select("seqlet").distinct()


def shifted_copies(seqs: DataFrame, shifts: list[int], fill: str = "N") -> DataFrame:
    """One same-length padded copy per shift."""
    copies = F.array(*[F.struct(F.lit(s).alias("shift"), S.shift(F.col("seq"), F.lit(s), fill).alias("seq")) for s in shifts])
    return seqs.select("name", F.inline(copies))


def realign_right(seqs: DataFrame, length: int, fill: str = "N") -> DataFrame:
    """Left-aligned copy followed by a right-aligned copy, both padded to ``length``."""
    s = F.col("seq")
    return seqs.select("name", F.concat(F.rpad(s, length, fill), F.lpad(s, length, fill)).alias("seq"))


def masked_copies(seqs: DataFrame, width: int, step: int, fill: str = "N") -> DataFrame:
    """One copy per masked window at starts 0, step, 2*step, ..."""
    starts = F.sequence(F.lit(0), F.length("seq") - 1, F.lit(step))
    exploded = seqs.filter(F.length("seq") > 0).select("name", "seq", F.explode(starts).alias("mask_start"))
    return exploded.select("name", "mask_start", S.mask(F.col("seq"), F.col("mask_start"), F.lit(width), fill).alias("seq"))


def filter_or_cut_length(seqs: DataFrame, max_length: int, cut: bool = False) -> DataFrame:
    if cut:
        return seqs.withColumn("seq", F.substring("seq", 1, max_length))
    return seqs.filter(F.length("seq") <= max_length)


def combine_sequences(parts: list[DataFrame]) -> DataFrame:
    """Append the encodings of several inputs along the length, on common names."""
    out = parts[0].select("name", F.col("seq").alias("s0"))
    for i, p in enumerate(parts[1:], 1):
        out = out.join(p.select("name", F.col("seq").alias(f"s{i}")), "name")
    return out.select("name", F.concat(*[f"s{i}" for i in range(len(parts))]).alias("seq"))


def replay_edits(seqs: DataFrame, log: DataFrame) -> DataFrame:
    """Apply ``pos,old/new;pos,old/new`` edit strings (0-based) to seed sequences."""
    edits = F.transform(
        F.filter(F.split("edits", ";"), lambda e: e != ""),
        lambda e: F.struct(
            F.substring_index(e, ",", 1).cast("int").alias("pos"),
            F.substring_index(F.substring_index(e, ",", -1), "/", 1).alias("old"),
            F.substring_index(e, "/", -1).alias("new"),
        ),
    )
    return seqs.join(log.select("name", "edits"), "name").select("name", S.apply_edits(F.col("seq"), edits).alias("seq"))


def exact_motif_scan(seqs: DataFrame, words: DataFrame, both_strands: bool = True) -> DataFrame:
    """Hits of exact words ``(motif, word)`` with strand, and the repeat context score.

    ``words`` may carry ``context`` (two letters): the score adds the number of
    bases in uninterrupted context repeats left and right of the hit.  The windows of a
    sequence are looked up in the word list batch by batch, so only hits become rows.
    """
    if "context" not in words.columns:
        words = words.withColumn("context", F.lit(""))
    w = words.select("motif", "word", "context", F.lit("+").alias("strand"))
    if both_strands:
        w = w.unionByName(
            words.select(
                "motif",
                S.reverse_complement(F.col("word")).alias("word"),
                S.reverse_complement(F.col("context")).alias("context"),
                F.lit("-").alias("strand"),
            )
        )
    known = w.filter("word IS NOT NULL")
    types = {c: d.schema[c].dataType.simpleString() for d, c in ((seqs, "name"), (known, "motif"))}
    schema = f"name {types['name']}, motif {types['motif']}, strand string, start int, end int, context_bases int"

    def compare(part: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        by_length: dict[int, dict[str, list[tuple]]] = {}
        for motif, word, unit, strand in zip(listed["motif"], listed["word"], listed["context"], listed["strand"]):
            by_length.setdefault(len(word), {}).setdefault(word, []).append((motif, unit or "", strand))
        units = {unit for unit in listed["context"] if unit}
        out = []
        for name, seq in zip(part["name"], part["seq"]):
            runs = {}
            for size, words_of in by_length.items():
                for start in range(len(seq) - size + 1):
                    for motif, unit, strand in words_of.get(seq[start : start + size], ()):
                        if units and not runs:
                            runs = {u: _unit_runs(seq, u) for u in units}
                        right, left = runs.get(unit, ({}, {}))
                        out.append((name, motif, strand, start, start + size, right.get(start + size, 0) + left.get(start, 0)))
        return pd.DataFrame(out, columns=["name", "motif", "strand", "start", "end", "context_bases"])

    return against_reference(seqs.select("name", "seq").filter("seq IS NOT NULL"), known, compare, schema, "name", "word")


def _unit_runs(text: str, unit: str) -> tuple[dict[int, int], dict[int, int]]:
    """Length of the run of whole ``unit`` repeats that starts at a position, and of the one that ends there, where there is one."""
    right, left, size = {}, {}, len(unit)
    places, at = [], text.find(unit)
    while at >= 0:
        places.append(at)
        at = text.find(unit, at + 1)
    for at in places:
        left[at + size] = left.get(at, 0) + size
    for at in reversed(places):
        right[at] = right.get(at + size, 0) + size
    return right, left
