"""Interval joins, coverage, read counting and intron derivation.

Intervals are 0-based half open unless a function says otherwise.  A range join
is an equi-join on ``(contig, bin)`` with a residual predicate; identical reads
are counted before they are shuffled, so a pile-up is one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BIN = 4096


def _bins(start: Column, end: Column, size: int) -> Column:
    last = F.greatest(end - 1, start)
    return F.sequence(F.floor(start / size).cast("bigint"), F.floor(last / size).cast("bigint"))


def overlap_join(left: DataFrame, right: DataFrame, size: int = BIN, left_key: str = "contig", right_key: str = "chrom") -> DataFrame:
    """Pairs of overlapping intervals, each once.

    ``left`` has ``start``/``end``; the right columns ``start``/``end`` come out as ``r_start``/``r_end``.
    """
    r = right.withColumnsRenamed({"start": "r_start", "end": "r_end", right_key: "__rk"})
    lb = left.withColumn("__bin", F.explode(_bins(F.col("start"), F.col("end"), size)))
    rb = r.withColumn("__rbin", F.explode(_bins(F.col("r_start"), F.col("r_end"), size)))
    first = F.greatest(F.floor(F.col("start") / size), F.floor(F.col("r_start") / size))
    cond = (
        (F.col(left_key) == F.col("__rk"))
        & (F.col("__bin") == F.col("__rbin"))
        & (F.col("start") < F.col("r_end"))
        & (F.col("r_start") < F.col("end"))
        & (F.col("__bin") == first)
    )
    return lb.join(rb, cond).drop("__bin", "__rbin", "__rk")


def extend_regions(regions: DataFrame, length: int) -> DataFrame:
    """Centre every region in ``length`` bases; starts are clipped at 0."""
    extra = F.floor((F.lit(length) - (F.col("end") - F.col("start"))) / 2)
    return regions.withColumns({"start": F.greatest(F.lit(0), F.col("start") - extra), "end": F.col("end") + extra})


def fragments(reads: DataFrame, mode: str = "fragment", max_length: int | None = None, shift: tuple[int, int] = (4, -4)) -> DataFrame:
    """Shifted fragments ``(contig, start, end, reverse, length, n)``, identical ones counted.

    ``fragment`` uses the leftmost mate of proper pairs and the absolute template
    length, so each pair counts once; ``read`` uses every single read.
    """
    if mode == "fragment":
        r = reads.filter("proper AND NOT reverse").withColumn("length", F.abs("tlen"))
        r = r.withColumn("end", F.col("start") + F.col("length"))
    elif mode == "read":
        r = reads.withColumn("length", F.col("end") - F.col("start"))
    else:
        raise ValueError(mode)
    if max_length is not None:
        r = r.filter(F.col("length") <= max_length)
    return r.groupBy(
        "contig", (F.col("start") + shift[0]).alias("start"), (F.col("end") + shift[1]).alias("end"), "reverse", "length"
    ).agg(F.count(F.lit(1)).alias("n"))


def exclude_blacklist(frags: DataFrame, blacklist: DataFrame, size: int = BIN) -> DataFrame:
    """Drop fragments with an end in a listed interval.  Only distinct end positions are joined."""
    ends = frags.select("contig", F.explode(F.array("start", "end")).alias("start")).distinct()
    points = ends.withColumn("end", F.col("start") + 1)
    bad = overlap_join(points, blacklist.select("chrom", "start", "end"), size).select("contig", "start").distinct()
    out = frags.join(bad, ["contig", "start"], "left_anti")
    return out.join(bad.withColumnRenamed("start", "end"), ["contig", "end"], "left_anti")


def _deal(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key over ``spark.sql.shuffle.partitions`` tasks; small rows that grow later are not put into fewer tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _cut(df: DataFrame, size: int) -> DataFrame:
    """Every bin that ``(contig, start, end)`` touches, with the stretch ``lo`` to ``hi`` inside of it."""
    d = df.where("end > start").withColumn("bin", F.explode(_bins(F.col("start"), F.col("end"), size)))
    first = F.col("bin") * size
    return d.withColumns({"lo": F.greatest("start", first), "hi": F.least("end", first + size)})


def _per_base(intervals: DataFrame, regions: DataFrame, size: int, by_name: bool = False) -> DataFrame:
    """Sum of ``v`` of the intervals ``(contig, start, end, v)`` on each base of a region: ``(name, offset, v)``.

    The sums are made once per contig, for the bins that regions touch; a bin is one array with
    null for bases that no interval covers.  A region takes its stretch out of the arrays
    of its bins, so what is joined and shuffled grows with intervals and regions and never with their pairs.
    With ``by_name`` all rows of a region are in one partition; only stretches are moved for it.
    A column ``over`` of the regions is taken off each of their bases.
    """
    extra = [c for c in regions.columns if c == "over"]
    r = regions.select("name", F.col("chrom").alias("contig"), "start", "end", *extra)
    parts = _cut(r, size)
    touched = parts.select("contig", "bin").distinct()
    inside = _cut(intervals, size).join(touched, ["contig", "bin"], "left_semi")
    grid = touched.select("contig", "bin", (F.col("bin") * size).alias("lo"), ((F.col("bin") + 1) * size).alias("hi"), F.lit(None).cast(intervals.schema["v"].dataType).alias("v"))
    rows = _deal(inside.select("contig", "bin", "lo", "hi", "v").unionByName(grid), "contig", "bin")
    base = rows.select("contig", "bin", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("at"), "v").groupBy("contig", "bin", "at").agg(F.sum("v").alias("v"))
    packed = base.groupBy("contig", "bin").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("x"))
    packed = packed.select("contig", "bin", F.transform("x", lambda x: x["v"]).alias("x"))
    begin = (F.col("lo") - F.col("bin") * size + 1).cast("int")
    held = _deal(parts, "contig", "bin").join(packed, ["contig", "bin"]).select(
        "name", *extra, (F.col("lo") - F.col("start")).alias("from"), F.slice("x", begin, (F.col("hi") - F.col("lo")).cast("int")).alias("x")
    )
    held = _deal(held, "name") if by_name else held
    out = held.select("name", *extra, "from", F.posexplode("x").alias("i", "v")).where("v IS NOT NULL")
    out = out.select("name", (F.col("from") + F.col("i")).alias("offset"), (F.col("v") - F.col("over") if extra else F.col("v")).alias("v"))
    if r.groupBy("name").count().where("count > 1").isEmpty():
        return out
    return out.groupBy("name", "offset").agg(F.sum("v").alias("v"))


def _less_spanned(d: DataFrame, regions: DataFrame, size: int) -> DataFrame:
    """Regions with the weight ``over`` of the fragments that reach over both of their ends, where fragments are long enough for that."""
    shortest = regions.agg(F.min(F.col("end") - F.col("start"))).first()[0]
    long = d.where(F.col("end") - F.col("start") > F.lit(shortest) + 1)
    if long.isEmpty():
        return regions
    keys = ["name", "chrom", "start", "end"]
    each = regions.distinct().withColumn("key", F.struct(*keys))
    hit = overlap_join(long, each, size).where((F.col("start") < F.col("r_start")) & (F.col("end") > F.col("r_end")))
    over = hit.groupBy("key").agg(F.sum("v").alias("over"))
    joined = regions.join(over, F.struct(*keys).eqNullSafe(F.col("key")), "left")
    return joined.select(*keys, F.coalesce("over", F.lit(0)).alias("over"))


def count_cuts_in_regions(frags: DataFrame, regions: DataFrame, mode: str = "53", size: int = BIN) -> DataFrame:
    """Per-base counts ``(name, offset, count)`` of fragments in regions.

    ``53`` counts both ends, ``5`` and ``3`` one end by strand, ``entire`` every base of a
    fragment that has an end inside, ``entirefraction`` the same with weight 1/length.
    """
    r = regions.select("name", "chrom", "start", "end")
    if mode in ("53", "5", "3"):
        left, right = F.col("start"), F.col("end") - 1
        if mode == "53":
            pos = F.array(left, right)
        else:
            five = F.when(F.col("reverse"), right).otherwise(left)
            three = F.when(F.col("reverse"), left).otherwise(right)
            pos = F.array(five if mode == "5" else three)
        cuts = frags.select("contig", "n", F.explode(pos).alias("start")).groupBy("contig", "start").agg(F.sum("n").alias("v"))
        return _per_base(cuts.withColumn("end", F.col("start") + 1), r, size).withColumnRenamed("v", "count")
    weight = F.col("n") / F.col("length") if mode == "entirefraction" else F.col("n")
    d = frags.filter(F.col("end") > F.col("start")).groupBy("contig", "start", "end").agg(F.sum(weight).alias("v"))
    # a fragment without an end inside covers the whole region
    level = _per_base(d, _less_spanned(d, r, size), size)
    return level.where(F.col("v") > 1e-9).withColumnRenamed("v", "count")


def signal_over_regions(signal: DataFrame, regions: DataFrame, size: int = BIN, by_name: bool = False) -> DataFrame:
    """Per-base signal ``(name, offset, value)`` of each region; NaN counts as 0.

    ``by_name`` keeps the rows of a region in one partition, for steps that go on by region.
    """
    s = signal.select(F.col("chrom").alias("contig"), "start", "end", F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)).alias("value"))
    s = s.groupBy("contig", "start", "end").agg(F.sum("value").alias("v")).filter("v <> 0 AND end > start")
    return _per_base(s, regions, size, by_name).withColumnRenamed("v", "value")


def average_pool(profile: DataFrame, window: int | None, regions: DataFrame | None = None, value: str = "value") -> DataFrame:
    """Mean per fixed window (last one padded with zeros), or over the whole region when ``window`` is None."""
    if window is not None:
        g = profile.groupBy("name", F.floor(F.col("offset") / window).cast("int").alias("window"))
        return g.agg((F.sum(value) / window).alias("value"))
    length = regions.select("name", (F.col("end") - F.col("start")).alias("__len"))
    s = profile.groupBy("name").agg(F.sum(value).alias("__s"))
    return length.join(s, "name", "left").select("name", (F.coalesce("__s", F.lit(0.0)) / F.col("__len")).alias("value"))


def pool_tracks(
    profile: DataFrame, tracks: list[str] | None, length: int, cut_edges: int = 0, percent: bool = True, one_row: bool = False
) -> DataFrame:
    """Sum chosen tracks per base, cut both edges, then (optionally) take off the minimum and scale to 100.

    Positions that are absent count as 0 for the minimum.  ``one_row`` says that the chosen tracks have
    one row per name and offset, as from ``signal_over_regions``: that row is the sum.
    """
    p = profile if tracks is None else profile.filter(F.col("track").isin(tracks))
    s = p.select("name", "offset", "value") if one_row else p.groupBy("name", "offset").agg(F.sum("value").alias("value"))
    s = s.filter((F.col("offset") >= cut_edges) & (F.col("offset") < length - cut_edges))
    if not percent:
        return s
    n = length - 2 * cut_edges
    t = s.groupBy("name").agg(F.min("value").alias("lo"), F.sum("value").alias("s"), F.count(F.lit(1)).alias("k"))
    low = F.when(F.col("k") < n, F.least(F.col("lo"), F.lit(0.0))).otherwise(F.col("lo"))
    t = t.select("name", low.alias("lo"), (F.col("s") - n * low).alias("total"))
    total = F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))
    t = t.select("name", "lo", total.alias("total")).hint("shuffle_hash")
    return s.join(t, "name").select("name", "offset", ((F.col("value") - F.col("lo")) / F.col("total") * 100).alias("value"))


def total_reads(reads: DataFrame, prefix: str = "chr") -> DataFrame:
    """Mapped reads on contigs with the prefix."""
    ok = F.col("contig").startswith(prefix) & (F.col("flag").bitwiseAND(4) == 0)
    return reads.filter(ok).agg(F.count(F.lit(1)).alias("reads"))


def covered_bases(intervals: DataFrame, size: int = 65_536) -> DataFrame:
    """Distinct covered bases per contig.  Intervals are clipped to bins, so no contig is sorted as a whole."""
    d = intervals.select("chrom", "start", "end").filter("end > start").distinct()
    b = d.withColumn("bin", F.explode(_bins(F.col("start"), F.col("end"), size)))
    b = b.select(
        "chrom", "bin",
        F.greatest(F.col("start"), F.col("bin") * size).alias("s"), F.least(F.col("end"), (F.col("bin") + 1) * size).alias("e"),
    ).distinct()
    w = W.partitionBy("chrom", "bin").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)
    seen = F.coalesce(F.max("e").over(w), F.col("s"))
    new = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), seen))
    return b.select("chrom", new.alias("new")).groupBy("chrom").agg(F.sum("new").cast("bigint").alias("bases"))


def _gene_range(key, reads: pd.DataFrame, features: pd.DataFrame) -> pd.DataFrame:
    """First and last gene among the features of a bin with ``a <= x`` and ``b >= y``, for its reads.

    Features come in by their start; ``lo`` and ``hi`` hold the first and last gene of those that
    end at an end or later.  Costs features and reads, never their pairs.
    """
    if not len(reads) or not len(features):
        return pd.DataFrame()
    genes, code = np.unique(features["gene"].to_numpy(dtype=object), return_inverse=True)
    a, (ends, at) = features["a"].to_numpy(), np.unique(features["b"].to_numpy(), return_inverse=True)
    reads = reads.sort_values("x")
    x, slot = reads["x"].to_numpy(), np.searchsorted(ends, reads["y"].to_numpy())
    lo, hi = np.full(len(ends) + 1, len(genes)), np.full(len(ends) + 1, -1)
    first, last = np.empty(len(x), int), np.empty(len(x), int)
    order, done = np.argsort(a, kind="stable"), 0
    until = np.searchsorted(x, a[order])
    for i, stop in zip(order.tolist(), until.tolist()):
        if stop > done:
            first[done:stop], last[done:stop], done = lo[slot[done:stop]], hi[slot[done:stop]], stop
        np.minimum(lo[: at[i] + 1], code[i], out=lo[: at[i] + 1])
        np.maximum(hi[: at[i] + 1], code[i], out=hi[: at[i] + 1])
    first[done:], last[done:] = lo[slot[done:]], hi[slot[done:]]
    ok = last >= 0
    out = reads.loc[ok, ["contig", "start", "end", "n"]]
    return out.assign(gene=genes[first[ok]], last=genes[last[ok]]) if len(out) else pd.DataFrame()


def count_reads_in_features(
    reads: DataFrame, features: DataFrame, mode: str = "union", min_overlap: int = 5, size: int = 4 * BIN
) -> DataFrame:
    """Reads per gene; a read counts when exactly one gene fits.

    ``union``: overlap of at least ``min_overlap``; ``strict``: the whole read lies in the
    gene's features.  ``features`` is ``(gene, chrom, start, end)``.

    Both say that a feature begins at ``x`` or before and ends at ``y`` or behind.  A bin gives each of its
    reads the first and the last gene that fit, so no pair of read and feature is made.
    """
    r = reads.groupBy("contig", "start", "end").agg(F.count(F.lit(1)).alias("n")).where("contig IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")
    f = features.where("gene IS NOT NULL AND chrom IS NOT NULL AND end > start").select(
        F.col("gene").cast("string").alias("gene"), F.col("chrom").alias("contig"), F.col("start").cast("long").alias("a"), F.col("end").cast("long").alias("b")
    ).distinct()
    if mode == "union":
        m = max(min_overlap, 1)
        r = r.where(F.col("end") - F.col("start") >= m).withColumns({"x": F.col("end") - m, "y": F.col("start") + m})
        f = f.where(F.col("b") - F.col("a") >= m)
        r, f = r.withColumn("bin", F.explode(_bins(F.col("start"), F.col("x") + 1, size))), f.withColumn("bin", F.explode(_bins(F.col("a"), F.col("b") - m + 1, size)))
    else:
        # reads without length lie where both neighbours do
        r = r.withColumns({"x": F.least(F.col("start"), F.col("end") - 1), "y": F.greatest(F.col("end"), F.col("start") + 1)})
        r, f = r.withColumn("bin", F.floor(F.col("x") / size).cast("bigint")), f.withColumn("bin", F.explode(_bins(F.col("a"), F.col("b"), size)))
    r = r.select("contig", "bin", *[F.col(c).cast("long").alias(c) for c in ("start", "end", "n", "x", "y")])
    f = f.select(F.col("contig").alias("chrom"), F.col("bin").alias("rbin"), "gene", "a", "b")
    hit = r.groupBy("contig", "bin").cogroup(f.groupBy("chrom", "rbin")).applyInPandas(
        _gene_range, "contig string, start long, end long, n long, gene string, last string"
    )
    one = hit.groupBy("contig", "start", "end").agg(F.min("gene").alias("gene"), F.max("last").alias("last"), F.max("n").alias("n"))
    return one.filter(F.col("gene") == F.col("last")).groupBy("gene").agg(F.sum("n").alias("count"))


def feature_length_per_gene(features: DataFrame) -> DataFrame:
    """Sum of end - start per gene and type (as the reference, without the +1 of closed coordinates)."""
    return features.groupBy("gene", "type").agg(F.sum(F.col("end") - F.col("start")).alias("length"))


# ------------------------------------------------- introns (closed coordinates)
def derive_introns(transcripts: DataFrame, exons: DataFrame) -> DataFrame:
    """Gaps between exons plus leading and trailing gaps, ``(transcript, start, end)`` closed."""
    w = W.partitionBy("transcript").orderBy("start")
    gaps = exons.select(
        "transcript", (F.lag("end").over(w) + 1).alias("s"), (F.col("start") - 1).alias("e")
    ).filter(F.col("s").isNotNull())
    edge = exons.groupBy("transcript").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    t = transcripts.select("transcript", F.col("start").alias("ts"), F.col("end").alias("te")).join(edge, "transcript")
    lead = t.filter(F.col("ts") != F.col("first")).select("transcript", F.col("ts").alias("s"), (F.col("first") - 1).alias("e"))
    trail = t.filter(F.col("te") != F.col("last")).select("transcript", (F.col("last") + 1).alias("s"), F.col("te").alias("e"))
    out = gaps.unionByName(lead).unionByName(trail).filter("e >= s")
    return out.select("transcript", F.col("s").alias("start"), F.col("e").alias("end"))


def constitutive_introns(transcripts: DataFrame, introns: DataFrame) -> DataFrame:
    """Stretches that are intronic in every transcript that covers them, per transcript that holds them.

    Sweep over break points of a gene: intron depth equals transcript depth.
    ``transcripts`` is ``(gene, transcript, start, end)``, closed.
    """
    def events(df: DataFrame, t: int, i: int) -> DataFrame:
        steps = F.array(
            F.struct(F.col("start").alias("pos"), F.lit(t).alias("dt"), F.lit(i).alias("di")),
            F.struct((F.col("end") + 1).alias("pos"), F.lit(-t).alias("dt"), F.lit(-i).alias("di")),
        )
        return df.select("gene", F.inline(steps))

    ig = introns.join(transcripts.select("gene", "transcript"), "transcript")
    ev = events(transcripts, 1, 0).unionByName(events(ig, 0, 1))
    ev = ev.groupBy("gene", "pos").agg(F.sum("dt").alias("dt"), F.sum("di").alias("di"))
    w = W.partitionBy("gene").orderBy("pos")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    seg = ev.select(
        "gene", F.col("pos").alias("s"), (F.lead("pos").over(w) - 1).alias("e"),
        F.sum("dt").over(run).alias("t"), F.sum("di").over(run).alias("i"),
    ).filter("t > 0 AND i = t")
    ws = W.partitionBy("gene").orderBy("s")
    isl = seg.withColumn("new", F.when(F.lag("e").over(ws) + 1 == F.col("s"), 0).otherwise(1))
    isl = isl.withColumn("id", F.sum("new").over(ws.rowsBetween(W.unboundedPreceding, 0)))
    isl = isl.groupBy("gene", "id").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    t = transcripts.select("gene", "transcript", F.col("start").alias("ts"), F.col("end").alias("te"))
    held = isl.join(t, "gene").filter((F.col("start") >= F.col("ts")) & (F.col("end") <= F.col("te")))
    return held.select("gene", "transcript", "start", "end")
