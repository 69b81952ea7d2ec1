"""Attribution maps ``(seq, track, pos, base, value)``: gauges, runs, seqlets and motif matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.operators.matrix import attach, attach_small, signed_maxabs
from strandframe.session import written

CHUNK = 4096

# One chunk and the state (t, who) before it, to the state behind it and what was found.
Fold = Callable[..., tuple[int, int, list]]


# --------------------------------------------------------------------- gauges
def attribution_gauge(attr: DataFrame, how: str = "center", reference: DataFrame | None = None, frequencies: dict[str, float] | None = None) -> DataFrame:
    """``center`` zero mean per position; ``frequency`` subtract the frequency-weighted sum;
    ``reference`` subtract the value of the base present; ``altmean`` subtract the mean of the
    other bases; ``meaneffect`` value at the base minus the mean of the others, at the base only."""
    keys = ["seq", "track", "pos"]
    if how == "center":
        m = attach_small(attr, keys, __t=F.avg("value"))
    elif how == "frequency":
        f = frequencies or {b: 0.25 for b in "ACGT"}
        weight = F.coalesce(*[F.when(F.col("base") == b, F.lit(p)) for b, p in f.items()])
        m = attach_small(attr, keys, __t=F.sum(F.col("value") * weight))
    else:
        ref = reference.select("seq", "pos", F.col("base").alias("__r"))
        m = attr.join(ref, ["seq", "pos"])
        at = F.col("base") == F.col("__r")
        agg = F.max(F.when(at, F.col("value"))) if how == "reference" else F.avg(F.when(~at, F.col("value")))
        m = attach_small(m, keys, __t=agg)
        if how == "meaneffect":
            m = m.filter(at)
    return m.select(*keys, "base", (F.col("value") - F.col("__t")).alias("value"))


def attribution_at_reference(attr: DataFrame, reference: DataFrame) -> DataFrame:
    """Value of the base present at each position."""
    return attr.join(reference.select("seq", "pos", "base"), ["seq", "pos", "base"]).select("seq", "track", "pos", "value")


def attribution_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Map a minus map b on common cells."""
    keys = ["seq", "track", "pos", "base"]
    return a.join(b.withColumnRenamed("value", "__b"), keys).select(*keys, (F.col("value") - F.col("__b")).alias("value"))


def track_difference(attr: DataFrame, reference_track: str) -> DataFrame:
    """Every track minus one reference track."""
    ref = attr.filter(F.col("track") == reference_track).select("seq", "pos", "base", F.col("value").alias("__b"))
    j = attr.filter(F.col("track") != reference_track).join(ref, ["seq", "pos", "base"])
    return j.select("seq", "track", "pos", "base", (F.col("value") - F.col("__b")).alias("value"))


def sparse_to_dense(attr: DataFrame, lengths: DataFrame) -> DataFrame:
    """Missing positions are 0; ``lengths`` is ``(seq, length)``."""
    bases = F.explode(F.array(*[F.lit(b) for b in "ACGT"]))
    grid = attr.select("seq", "track").distinct().join(lengths, "seq")
    grid = grid.select("seq", "track", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("pos")).select("seq", "track", "pos", bases.alias("base"))
    return grid.join(attr, ["seq", "track", "pos", "base"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def attribution_similarity(a: DataFrame, b: DataFrame, metric: str = "correlation") -> DataFrame:
    """Per sequence and track similarity of two maps."""
    from strandframe.operators.stats import cosine_expr, pearson_expr

    keys = ["seq", "track", "pos", "base"]
    j = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), keys)
    x, y = F.col("a"), F.col("b")
    agg = {"correlation": pearson_expr(x, y), "cosine": cosine_expr(x, y), "mse": F.avg((x - y) * (x - y))}[metric]
    return j.groupBy("seq", "track").agg(agg.alias(metric))


def similarity_summary(sim: DataFrame, column: str) -> DataFrame:
    return sim.groupBy("track").agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


# ----------------------------------------------------------- windows and crops
def center_window(profile: DataFrame, width: int, moving: int = 7) -> DataFrame:
    """Window of ``width`` around the largest moving sum of absolute values, per sequence and track.

    The moving sum over chunks with a halo needs no sequence-wide sort.
    """
    rows = _with_halo(profile, moving)
    w = W.partitionBy("seq", "track", "__chunk").orderBy("pos").rangeBetween(-(moving - 1), 0)
    mov = rows.withColumn("m", F.sum(F.abs("value")).over(w)).filter("NOT __halo")
    full = mov.filter(F.col("pos") >= moving - 1)
    centre = full.groupBy("seq", "track").agg((F.max_by("pos", F.struct("m", -F.col("pos"))) - moving // 2).alias("c"))
    j = profile.join(centre, ["seq", "track"])
    lo = F.col("c") - width // 2
    return j.filter((F.col("pos") >= lo) & (F.col("pos") < lo + width)).drop("c")


def trim_flanks(profile: DataFrame, cut: float, relative: bool = True) -> DataFrame:
    """Keep from the first to the last position over an absolute or relative cut-off."""
    keys = ["seq", "track"]
    size = profile.groupBy(*keys, "pos").agg(F.max(F.abs("value")).alias("v"))
    if relative:
        size = attach(size, keys, top=F.max("v")).filter((F.col("v") >= cut * F.col("top")) & (F.col("top") > 0))
    else:
        size = size.filter(F.col("v") > cut)
    lim = size.groupBy(*keys).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return profile.join(lim, keys).filter(F.col("pos").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def _with_halo(profile: DataFrame, halo: int) -> DataFrame:
    """Rows with a chunk number; rows near a border are copied into the neighbour chunk."""
    c = F.floor(F.col("pos") / CHUNK).cast("int")
    at = F.col("pos") % CHUNK
    here = F.struct(c.alias("__chunk"), F.lit(False).alias("__halo"))
    nxt = F.struct((c + 1).alias("__chunk"), F.lit(True).alias("__halo"))
    prev = F.struct((c - 1).alias("__chunk"), F.lit(True).alias("__halo"))
    copies = F.concat(
        F.array(here), F.when(at >= CHUNK - halo, F.array(nxt)).otherwise(F.array().cast("array<struct<__chunk:int,__halo:boolean>>")),
        F.when((at < halo) & (c > 0), F.array(prev)).otherwise(F.array().cast("array<struct<__chunk:int,__halo:boolean>>")),
    )
    return profile.select("*", F.inline(copies))


# ----------------------------------------------------------------------- runs
def _islands(profile: DataFrame, gap: int, active: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """Active rows with an island id: a new island starts after more than ``gap`` inactive positions.

    Works on chunks of a sequence: the neighbour test needs a halo of ``gap + 1``, the id is the
    last start in the chunk or, when there is none, the last start of an earlier chunk.
    """
    rows = _with_halo(profile, 2 * gap + 2)
    for name, col in (extra or {}).items():
        rows = rows.withColumn(name, col)
    rows = rows.filter(active)
    w = W.partitionBy("seq", "track", "__chunk").orderBy("pos")
    rows = rows.withColumn("__start", F.when(F.col("pos") - F.lag("pos").over(w) <= gap + 1, F.lit(None)).otherwise(F.col("pos")))
    rows = rows.filter("NOT __halo")
    heads = rows.groupBy("seq", "track", "__chunk").agg(F.max("__start").alias("__head"))
    before = W.partitionBy("seq", "track").orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = heads.select("seq", "track", "__chunk", F.max("__head").over(before).alias("__carry"))
    local = F.max("__start").over(w.rowsBetween(W.unboundedPreceding, 0))
    out = rows.withColumn("__local", local).join(carry, ["seq", "track", "__chunk"])
    return out.withColumn("island", F.coalesce("__local", "__carry")).drop("__local", "__carry", "__start", "__chunk", "__halo")


def _smoothed(gap: int) -> Column:
    w = W.partitionBy("seq", "track", "__chunk").orderBy("pos").rowsBetween(-gap, gap)
    return F.avg("value").over(w)


_OPEN = 2**31 - 1  # reach of what the end of the sequence leaves open


def _entered(chunks: DataFrame, entries: Callable[[DataFrame], DataFrame], fold: Fold) -> DataFrame:
    """Chunks with the state ``t``, ``who`` in which a walk from the start of the sequence enters them.

    ``chunks`` has ``seq, track, __chunk, length, items``; ``entries`` gives ``seq, track, __chunk,
    entries``, every state in which the walk can come in with ``t`` behind the chunk's first item.  A
    chunk becomes a table from entry to exit, however long the sequence is; only these tables meet in
    one task.  A sequence of one chunk is entered at its start and needs no table.
    """
    keys = ["seq", "track"]
    chunks = written(chunks)  # read five times below

    def table(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            at, exits = [], []
            for row in part.itertuples(index=False):
                states = [(-1, 0), *((int(e["t"]), int(e["who"])) for e in row.entries)]
                out = [fold(row, t, who)[:2] for t, who in states]
                at.append([x for state in states for x in state])
                exits.append([x for state in out for x in state])
            yield part[["seq", "track", "chunk", "begin"]].assign(at=at, exits=exits)

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            come = []
            for row in part.itertuples(index=False):
                t, who, state = -1, 0, []
                for begin, at, exits in zip(row.begin.tolist(), row.at, row.exits):
                    if t <= begin:
                        t, who = -1, 0
                    state.append({"t": t, "who": who})
                    at, exits = at.tolist(), exits.tolist()
                    states = list(zip(at[::2], at[1::2]))
                    if (t, who) in states:
                        i = states.index((t, who))
                        t, who = exits[2 * i], exits[2 * i + 1]
                    elif t != _OPEN:
                        raise ValueError(f"no exit for {(t, who)} among {states}")
                come.append(state)
            yield part[["seq", "track", "chunk"]].assign(come=come)

    fields = [f.name for f in chunks.schema["items"].dataType.elementType]
    cells = [F.col("__chunk").alias("chunk"), *[F.col(f"items.{f}").alias(f) for f in fields]]
    whole = chunks.where(F.col("length") <= CHUNK).select(*keys, *cells, F.lit(-1).alias("t"), F.lit(0).alias("who"))
    cut = chunks.where(F.col("length") > CHUNK)
    if cut.isEmpty():
        return whole
    named = cut.join(entries(cut), [*keys, "__chunk"]).select(*keys, *cells, F.col(f"items.{fields[0]}")[0].alias("begin"), "entries")
    exits = named.mapInPandas(table, "seq string, track string, chunk int, begin int, at array<int>, exits array<int>")
    rows = F.sort_array(F.collect_list(F.struct("chunk", "begin", "at", "exits")))
    tables = exits.groupBy(*keys).agg(rows.alias("rows")).select(*keys, *[F.col(f"rows.{c}").alias(c) for c in ("chunk", "begin", "at", "exits")])
    come = tables.mapInPandas(scan, "seq string, track string, chunk array<int>, come array<struct<t:int,who:int>>")
    come = come.select(*keys, F.inline(F.arrays_zip("chunk", "come"))).select(*keys, "chunk", "come.t", "come.who")
    return whole.unionByName(named.drop("entries", "begin").join(come, [*keys, "chunk"]))


def _chains(profile: DataFrame, cut: float, max_gap: int, smooth: bool) -> DataFrame:
    """Chains ``(seq, track, who, positions, passing)``; ``who`` is the number of the chain times its sign.

    Ranks, the last member's break count and chain numbers run over a sequence as local values of
    a chunk plus what earlier chunks add up to, so no window is longer than a chunk.
    """
    halo = max_gap if smooth else 0
    rows = _with_halo(profile.select("seq", "track", F.col("pos").cast("int").alias("pos"), "value"), halo)
    rows = rows.withColumn("__mean", _smoothed(halo)).where("NOT __halo").where((F.abs("value") > cut) | (F.abs("__mean") >= cut))
    rows = rows.select("*", F.explode(F.array(F.lit(1), F.lit(-1))).alias("s"))
    rows = rows.withColumn("member", F.coalesce((F.abs("value") > cut) & (F.col("value") * F.col("s") > 0), F.lit(False)))
    rows = rows.where(F.col("member") | (F.col("s") * F.col("__mean") >= cut))

    at = ["seq", "track", "s", "__chunk"]
    w = W.partitionBy(*at).orderBy("pos")
    rows = rows.withColumn("rank", F.row_number().over(w)).withColumn("breaks", F.col("pos") - F.col("rank"))
    member_breaks = F.when(F.col("member"), F.col("breaks"))
    rows = rows.withColumn("before", F.max(member_breaks).over(w.rowsBetween(W.unboundedPreceding, -1)))
    starts = F.when(F.col("member") & (F.col("breaks") - F.col("before") > max_gap), 1).otherwise(0)
    rows = rows.withColumn("starts", F.sum(starts).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))

    earlier = W.partitionBy("seq", "track", "s").orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(*at).agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.min(member_breaks).alias("lo"), F.max(member_breaks).alias("hi"), F.max("starts").alias("known")
    )
    sums = sums.withColumn("ranked", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("int"))
    sums = sums.withColumn("last", F.max(F.col("hi") - F.col("ranked")).over(earlier))
    opens = F.col("lo").isNotNull() & F.coalesce(F.col("lo") - F.col("ranked") - F.col("last") > max_gap, F.lit(True))
    sums = sums.withColumn("opens", opens.cast("int"))
    sums = sums.withColumn("chains", F.coalesce(F.sum(F.col("known") + F.col("opens")).over(earlier), F.lit(0)).cast("int"))

    rows = rows.join(sums.select(*at, "ranked", "last", "opens", "chains"), at)
    met = F.col("before").isNotNull()
    since = F.when(met, F.col("breaks") - F.col("before")).otherwise(F.col("breaks") - F.col("ranked") - F.col("last"))
    chain = F.col("chains") + F.col("starts") + F.when(met | F.col("member"), F.col("opens")).otherwise(0)
    rows = rows.withColumn("chain", chain).where((F.col("chain") > 0) & (F.col("member") | F.coalesce(since <= max_gap, F.lit(False))))
    place = F.col("rank") + F.col("ranked")
    return rows.groupBy("seq", "track", (F.col("s") * F.col("chain")).alias("who")).agg(
        F.sort_array(F.collect_list(F.when(F.col("member"), F.col("pos")))).alias("positions"),
        (F.max(place) - F.max(F.when(F.col("member"), place))).alias("passing"),
    )


def _win(row, t: int, who: int) -> tuple[int, int, list[int]]:
    """Members of a chunk in order: the first one at ``t`` or later takes its chain as winner up to the chain's reach."""
    kept = []
    for i, (pos, chain, reach) in enumerate(zip(row.pos.tolist(), row.chain.tolist(), row.reach.tolist())):
        if pos >= t:
            t, who = reach, chain
        if chain == who:
            kept.append(i)
    return t, who, kept


def find_motif_runs(profile: DataFrame, cut: float, max_gap: int = 1, min_size: int = 4, smooth: bool = True) -> DataFrame:
    """Sign-consistent runs over a cut-off with bridged gaps: ``(seq, track, positions)``.

    Members of a sign are positions over the cut-off with that sign.  Another position is a
    break, unless the mean around it passes (``smooth``).  Members with at most ``max_gap``
    breaks between neighbours are a chain; break counts are position minus rank among the
    other rows, so a chain is a running sum away.  A chain reaches over as many positions behind
    its last member as it has passing ones before it closes, or over all if it does not
    close.  A chain that no other one reaches is a run.  Where chains of both signs overlap,
    the one with the earliest member wins and the others keep what lies beyond its reach.
    Input ``(seq, track, pos, value)`` with every position of the sequence present.

    The walk over winners goes chunk by chunk: only the last chain of each sign can reach
    into a chunk, so a chunk has three entries.
    """
    keys = ["seq", "track"]
    length = profile.groupBy(*keys).agg((F.max("pos") + 1).cast("int").alias("__len"))
    chains = _chains(profile, cut, max_gap, smooth).join(length, keys)
    reach = F.element_at("positions", -1) + F.col("passing") + 1
    chains = chains.withColumn("reach", F.when(reach + max_gap < F.col("__len"), reach).otherwise(F.lit(_OPEN)).cast("int"))
    members = chains.select(*keys, F.col("who").alias("chain"), "reach", "__len", F.explode("positions").alias("pos"))
    chunks = members.groupBy(*keys, F.floor(F.col("pos") / CHUNK).cast("int").alias("__chunk")).agg(
        F.max("__len").alias("length"), F.sort_array(F.collect_list(F.struct("pos", "chain", "reach"))).alias("items")
    )

    def entries(chunks: DataFrame) -> DataFrame:
        earlier = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
        last = [F.array_max(F.filter("items", lambda m: m["chain"] * s > 0)).alias(n) for n, s in (("up", F.lit(1)), ("down", F.lit(-1)))]
        tails = chunks.select(*keys, "__chunk", *last)
        tails = tails.select(*keys, "__chunk", F.max("up").over(earlier).alias("up"), F.max("down").over(earlier).alias("down"))
        entry = [F.when(F.col(n).isNotNull(), F.struct(F.col(f"{n}.reach").alias("t"), F.col(f"{n}.chain").alias("who"))) for n in ("up", "down")]
        return tails.select(*keys, "__chunk", F.array_compact(F.array(*entry)).alias("entries"))

    def kept(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            keep = [_win(row, row.t, row.who)[2] for row in part.itertuples(index=False)]
            cells = {c: [v[k] for v, k in zip(part[c], keep)] for c in ("chain", "pos")}
            yield part[keys].assign(**cells)

    won = _entered(chunks, entries, _win).mapInPandas(kept, "seq string, track string, chain array<int>, pos array<int>")
    won = won.select(*keys, F.inline(F.arrays_zip("chain", "pos")))
    runs = won.groupBy(*keys, "chain").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return runs.where(F.size("positions") >= min_size).select(*keys, "positions")


def strict_runs(profile: DataFrame, cut: float, max_gap: int = 1, min_size: int = 4) -> DataFrame:
    """Native rule without smoothing: strong positions of one sign with at most ``max_gap`` others between."""
    signed = profile.filter(F.abs("value") > cut).withColumn("s", F.signum("value").cast("int"))
    rows = _islands(
        signed.withColumn("track", F.concat_ws("\u0001", "track", F.col("s").cast("string"))), max_gap, F.lit(True)
    )
    g = rows.groupBy("seq", "track", "island").agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")
    )
    return g.filter(F.col("n") >= min_size).select(
        "seq", F.substring_index("track", "\u0001", 1).alias("track"), "start", "end", "n", "mean"
    )


def _members(profile: DataFrame, z_cut: float, mean: float) -> tuple[DataFrame, DataFrame]:
    """Positions over the cut-off with their sign: of sequences of one chunk as lists, of longer ones as rows.

    A chunk becomes one row before anything is joined or sorted, so the positions are shuffled once, or not at
    all where they come by sequence.
    """
    keys = ["seq", "track"]
    cells = F.sort_array(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "value")))
    chunks = profile.where("seq IS NOT NULL AND track IS NOT NULL").groupBy(*keys, F.floor(F.col("pos") / CHUNK).cast("int").alias("__chunk")).agg(
        cells.alias("cells"), F.sum(F.pow(F.col("value") - mean, F.lit(2))).alias("sum"), F.count("value").alias("n"), F.max("pos").alias("last")
    )
    over = W.partitionBy(*keys)
    chunks = chunks.withColumns({"__s": F.sqrt(F.try_divide(F.sum("sum").over(over), F.sum("n").over(over))), "__len": (F.max("last").over(over) + 1).cast("int")})
    z = lambda x: F.try_divide(x["value"] - mean, F.col("__s"))
    over_cut = F.filter(F.transform("cells", lambda x: F.struct(x["pos"].alias("pos"), z(x).alias("z"))), lambda x: F.abs(x["z"]) >= z_cut)
    signed = F.transform(over_cut, lambda x: F.struct(x["pos"].alias("pos"), F.signum(x["z"]).cast("int").alias("s")))
    chunks = written(chunks.select(*keys, "__chunk", "__len", signed.alias("cells")).where(F.size("cells") > 0))
    whole = chunks.where(F.col("__len") <= CHUNK).select(*keys, "__len", F.col("cells.pos").alias("pos"), F.col("cells.s").alias("s"))
    return whole, chunks.where(F.col("__len") > CHUNK).select(*keys, "__chunk", "__len", F.inline("cells"))


def _walk(min_size: int):
    def walk(row, t: int, who: int) -> tuple[int, int, list[tuple[int, int, int]]]:
        runs = []
        for b, f, e, sign, closed in zip(*(v.tolist() for v in (row.b, row.f, row.e, row.s, row.closed))):
            if f <= t:
                continue
            start = max(b, t)
            if not closed:
                t = _OPEN
            elif e - 1 - start >= min_size:
                runs.append((start, e - 1, sign))
                t = e
            else:
                t = f + 1
        return t, 0, runs

    return walk


def _blocks(pos: np.ndarray, sign: np.ndarray, length: int) -> SimpleNamespace:
    """Blocks of one sequence from its positions over the cut-off, as the joins of ``find_zscore_runs`` make them."""
    found = []
    for s in np.unique(sign):
        p = pos[sign == s]
        kind = p - np.arange(1, len(p) + 1)
        order = np.argsort(kind, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(kind[order]) != 0])
        b, f = np.minimum.reduceat(p[order], cuts), np.maximum.reduceat(p[order], cuts) + 1
        by = np.argsort(b, kind="stable")
        lo, hi = np.searchsorted(b[by], f + 1, "left"), np.searchsorted(b[by], f + 1, "right")
        n = np.maximum(hi - lo, 1)
        which = np.repeat(np.arange(len(b)), n)
        at = np.repeat(lo, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        e = np.where((hi > lo)[which], f[by][np.minimum(at, len(b) - 1)], f[which] + 1)
        found.append(np.stack([b[which], f[which], e, np.full(len(which), s), e < length]))
    b, f, e, s, closed = np.concatenate(found, axis=1)
    order = np.lexsort((closed, s, e, f, b))
    return SimpleNamespace(b=b[order], f=f[order], e=e[order], s=s[order], closed=closed[order])


def _short_runs(min_size: int):
    walk = _walk(min_size)

    def found(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = zip(part["seq"], part["track"], part["__len"], part["pos"], part["s"])
            runs = [(seq, track, *run) for seq, track, n, pos, s in rows for run in walk(_blocks(pos, s, n), -1, 0)[2]]
            yield pd.DataFrame(runs, columns=["seq", "track", "start", "end", "direction"])

    return found


def find_zscore_runs(profile: DataFrame, z_cut: float = 1.3, min_size: int = 5, mean: float | None = 0.0) -> DataFrame:
    """Runs on z-scored saliency per (seq, track): ``(seq, track, start, end, direction)``.

    With ``mean`` None the sequence's own mean and std are used, else the std around ``mean``.
    A run is a stretch of one sign with one interruption by one position; it must be ended
    inside the sequence by a second one.  A run with ``min_size`` members is kept and the next
    one begins where it ended, else the next one begins behind the interruption.
    """
    keys = ["seq", "track"]
    short = None
    if mean is None:
        p = attach(profile, keys, __m=F.avg("value"), __s=F.stddev_pop("value"), __len=F.max("pos") + 1)
        z = F.try_divide(F.col("value") - F.col("__m"), F.col("__s"))
        p = p.select(*keys, "pos", z.alias("z"), "__len")
        rows = _with_halo(p, 0).where(F.abs("z") >= z_cut).withColumn("s", F.signum("z").cast("int"))
    else:
        whole, rows = _members(profile, z_cut, mean)
        short = whole.mapInPandas(_short_runs(min_size), "seq string, track string, start int, end int, direction int")
    # Blocks are unbroken positions of one sign, [b, f); with the block behind one interruption they end at e.
    at = [*keys, "s", "__chunk"]
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*at).orderBy("pos")))
    earlier = W.partitionBy(*keys, "s").orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).select(*at, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ranked"))
    blocks = rows.join(ranked, at).groupBy(*keys, "s", (F.col("pos") - F.col("rank") - F.col("ranked")).alias("__block")).agg(
        F.min("pos").cast("int").alias("b"), (F.max("pos") + 1).cast("int").alias("f"), F.max("__len").cast("int").alias("__len")
    )
    behind = blocks.select(*keys, "s", (F.col("b") - 1).alias("f"), F.col("f").alias("__e"))
    blocks = blocks.join(behind, [*keys, "s", "f"], "left")
    blocks = blocks.withColumn("e", F.coalesce("__e", F.col("f") + 1)).withColumn("closed", F.col("e") < F.col("__len"))
    chunks = blocks.groupBy(*keys, F.floor(F.col("b") / CHUNK).cast("int").alias("__chunk")).agg(
        F.max("__len").alias("length"), F.sort_array(F.collect_list(F.struct("b", "f", "e", "s", "closed"))).alias("items")
    )

    def entries(chunks: DataFrame) -> DataFrame:
        """A walk is behind the last block, at the end of one of the last two, or through."""
        order = W.partitionBy(*keys).orderBy("__chunk")
        tails = chunks.select(*keys, "__chunk", F.slice("items", F.greatest(F.size("items") - 1, F.lit(1)), F.lit(2)).alias("tail"))
        none = F.array().cast(tails.schema["tail"].dataType)
        tail = F.concat(*[F.coalesce(F.lag("tail", k).over(order), none) for k in (2, 1)])
        tails = tails.select(*keys, "__chunk", F.slice(F.reverse(tail), 1, 2).alias("tail"))
        ts = F.concat(F.transform("tail", lambda x: x["e"]), F.transform(F.slice("tail", 1, 1), lambda x: x["f"] + 1))
        states = F.transform(F.array_distinct(ts), lambda t: F.struct(t.alias("t"), F.lit(0).alias("who")))
        return tails.select(*keys, "__chunk", states.alias("entries"))

    walk = _walk(min_size)

    def found(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            runs = [(row.seq, row.track, *run) for row in part.itertuples(index=False) for run in walk(row, row.t, 0)[2]]
            yield pd.DataFrame(runs, columns=[*keys, "start", "end", "direction"])

    if short is not None and rows.isEmpty():
        return short
    runs = _entered(chunks, entries, walk).mapInPandas(found, "seq string, track string, start int, end int, direction int")
    return runs if short is None else short.unionByName(runs)


# -------------------------------------------------------------------- seqlets
def extract_seqlets(
    attr: DataFrame, reference: DataFrame, cut: float, max_gap: int = 1, min_size: int = 4, norm: str = "condition", std: float = 1.0
) -> DataFrame:
    """Seqlets ``(name, seq, track, start, end, mean, max, positions)`` from attribution maps.

    The cut-off is in units of the root mean square, averaged over sequences per track
    (``condition``), over tracks per sequence (``seq``), over all (``global``), or ``std``.
    """
    per = attr.groupBy("seq", "track").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("s"))
    at = attribution_at_reference(attr, reference)
    if norm == "condition":
        scaled = at.join(per.groupBy("track").agg(F.avg("s").alias("s")), "track")
    elif norm == "seq":
        scaled = at.join(per.groupBy("seq").agg(F.avg("s").alias("s")), "seq")
    elif norm == "global":
        scaled = at.join(F.broadcast(per.agg(F.avg("s").alias("s"))))
    else:
        scaled = at.withColumn("s", F.lit(float(std) if norm == "std" else 1.0))
    stat = scaled.select("seq", "track", "pos", F.try_divide("value", "s").alias("value"))
    runs = find_motif_runs(stat, cut, max_gap, min_size).withColumn("start", F.array_min("positions"))
    cells = runs.select("seq", "track", "start", F.explode("positions").alias("pos")).join(at, ["seq", "track", "pos"])
    s = cells.groupBy("seq", "track", "start").agg(
        F.max("pos").alias("end"), F.avg("value").alias("mean"), signed_maxabs("value").alias("max"),
        F.sort_array(F.collect_list("pos")).alias("positions"),
    )
    name = F.concat_ws("_", "seq", "track", F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")))
    return s.select(name.alias("name"), "seq", "track", "start", "end", "mean", "max", "positions")


def seqlet_motifs(attr: DataFrame, seqlets: DataFrame) -> DataFrame:
    """Sub-matrix of each seqlet times the sign of its mean: ``(motif, pos, base, w)``."""
    s = seqlets.select(F.col("name").alias("motif"), "seq", "track", "start", "end", F.signum("mean").alias("sg"))
    cells = s.select("*", F.explode(F.sequence("start", "end")).alias("pos"))
    j = cells.join(attr, ["seq", "track", "pos"])
    return j.select("motif", (F.col("pos") - F.col("start")).alias("pos"), "base", (F.col("value") * F.col("sg")).alias("w"))


# --------------------------------------------------- motif x sequence matrices
def motif_sequence_matrix(
    effects: DataFrame, statistic: str = "max", conditions: list[str] | None = None, minimum_size: int | None = None,
    n_largest: int | None = None, minimum_fraction: float | None = None, sequence_clusters: DataFrame | None = None,
) -> DataFrame:
    """Cluster by sequence matrix (sparse) from ``(cluster, seq, condition, effect)``.

    The largest absolute effect stands for a condition, missing conditions are 0.
    ``max`` is the signed maximum over seqlets, ``absmax`` keeps the sign of the largest absolute one,
    ``count`` is the number of conditions with the motif.  A sequence-cluster table ``(seq, seqcluster)``
    gives means over its sequences, absent sequences counting as 0.
    """
    e = effects if conditions is None else effects.filter(F.col("condition").isin(conditions))
    if minimum_size or n_largest or minimum_fraction:
        size = e.groupBy("cluster").agg(F.count_distinct("seq").alias("k"))
        if minimum_size:
            size = size.filter(F.col("k") >= minimum_size)
        if minimum_fraction:
            n = e.agg(F.count_distinct("seq").alias("n"))
            size = size.join(F.broadcast(n)).filter(F.col("k") >= minimum_fraction * F.col("n")).drop("n")
        if n_largest:
            size = size.orderBy(F.col("k").desc(), "cluster").limit(n_largest)
        e = e.join(size.select("cluster"), "cluster", "left_semi")
    per = e.groupBy("cluster", "seq", "condition").agg(signed_maxabs("effect").alias("x"), F.max("effect").alias("top"))
    n_cond = F.broadcast(e.agg(F.count_distinct("condition").alias("n")))
    x = F.col("x")
    g = per.groupBy("cluster", "seq").agg(
        F.max("top").alias("max"), signed_maxabs("x").alias("absmax"), F.sum(x).alias("sum"), F.max(x).alias("hi"), F.min(x).alias("lo"),
        F.count(F.lit(1)).alias("k"),
    ).join(n_cond)
    full = F.col("k") == F.col("n")
    value = {
        "max": F.col("max"),
        "absmax": F.col("absmax"),
        "mean": F.col("sum") / F.col("n"),
        "sum": F.col("sum"),
        "maxdiff": F.when(full, F.col("hi") - F.col("lo")).otherwise(F.greatest("hi", F.lit(0.0)) - F.least("lo", F.lit(0.0))),
        "presence": F.signum("absmax"),
        "count": F.col("k").cast("double"),
    }[statistic]
    out = g.select("cluster", "seq", value.alias("value"))
    if sequence_clusters is None:
        return out
    sc = sequence_clusters.join(e.select("seq").distinct(), "seq", "left_semi")
    n = sc.groupBy("seqcluster").agg(F.count(F.lit(1)).alias("n"))
    s = out.join(sc, "seq").groupBy("cluster", "seqcluster").agg(F.sum("value").alias("s"))
    return s.join(n, "seqcluster").select("cluster", F.col("seqcluster").alias("seq"), (F.col("s") / F.col("n")).alias("value"))


def motif_counts_by_state(df: DataFrame) -> DataFrame:
    """Signed motif counts per cluster from ``(target, state, cluster, effect)``, one column per state and sign."""
    sign = F.signum("effect").cast("int")
    g = df.filter("effect <> 0").groupBy("target", "cluster")
    cells = [
        F.sum(F.when((F.col("state") == st) & (sign == sg), sg).otherwise(0)).alias(f"{st}_{nm}")
        for st in ("start", "end") for sg, nm in ((1, "positive"), (-1, "negative"))
    ]
    return g.agg(*cells)


def step_summary(df: DataFrame, minimum: int = 3) -> DataFrame:
    """mean and std per (method, condition, step) of step series ``(name, method, condition, series)``.

    ``series`` is a comma list; steps with fewer than ``minimum`` sequences are left out.
    """
    e = df.select("name", "method", "condition", F.posexplode(F.split("series", ",")).alias("step", "v"))
    v = F.col("v").try_cast("double")
    g = e.groupBy("method", "condition", "step").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"))
    return g.filter(F.col("n") >= minimum)


# ------------------------------------------------------------------- ablation
def kernel_effects(df: DataFrame) -> DataFrame:
    """Ablation summary per (kernel, track) of ``(kernel, point, track, y, yhat, yhat_masked)``.

    ``effect`` weighs each point's change by its share of the point's squared change over tracks.
    """
    from strandframe.operators.stats import pearson_expr

    d = F.col("yhat") - F.col("yhat_masked")
    rows = attach_small(df, ["kernel", "point"], __ss=F.sum(d * d))
    y = F.col("y")

    def rmse(c: str) -> Column:
        return F.sqrt(F.avg(F.pow(F.col(c) - y, F.lit(2))))

    return rows.groupBy("kernel", "track").agg(
        F.sum(F.when(F.col("__ss") > 0, F.pow(d, F.lit(3)) / F.col("__ss")).otherwise(0.0)).alias("effect"),
        F.sum(d).alias("sum_effect"),
        (pearson_expr(F.col("yhat"), y) - pearson_expr(F.col("yhat_masked"), y)).alias("correlation_change"),
        (rmse("yhat_masked") - rmse("yhat")).alias("rmse_change"),
    )


def kernel_effects_per_point(df: DataFrame, classes: DataFrame, well_predicted: float | None = None, unit: str = "kernel") -> DataFrame:
    """Correlation-distance change per (kernel, class, point) over the class's tracks.

    With ``well_predicted`` the mean over points whose full correlation distance is at most that value.
    """
    from strandframe.operators.stats import pearson_expr

    y = F.col("y")
    j = df.join(classes, "track")
    g = j.groupBy(unit, "class", "point").agg(
        (1 - pearson_expr(F.col("yhat"), y)).alias("full"), (1 - pearson_expr(F.col("yhat_masked"), y)).alias("masked"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1")
    out = g.select(unit, "class", "point", (F.col("masked") - F.col("full")).alias("change"), "full")
    if well_predicted is None:
        return out
    return out.filter(F.col("full") <= well_predicted).groupBy(unit, "class").agg(F.avg("change").alias("change"), F.count(F.lit(1)).alias("points"))


def network_contribution(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Error and correlation change per (input, class, point) when one input branch is masked."""
    y = F.col("y")
    err = df.join(classes, "track").groupBy("input", "class", "point").agg(
        (F.sqrt(F.avg(F.pow(F.col("yhat_masked") - y, F.lit(2)))) - F.sqrt(F.avg(F.pow(F.col("yhat") - y, F.lit(2))))).alias("rmse_change")
    )
    corr = kernel_effects_per_point(df, classes, unit="input").select("input", "class", "point", F.col("change").alias("correlation_change"))
    return err.join(corr, ["input", "class", "point"], "left")
