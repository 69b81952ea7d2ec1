"""Best-fit packing of documents into sequences of fixed length under conflicts.

Documents are cut into pieces of at most one sequence and spread over shards by hash, so
that each shard is a bounded group of lengths (no text is moved).  Inside a shard, longest
first, a piece goes to the tightest open bin that fits and holds neither its duplicate
cluster nor a source that already has its share.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_fit(pieces: list[tuple[int, object, object]], capacity: int, source_share: float) -> list[tuple[int, int, int]]:
    """(bin, place in bin, offset in bin) of each (length, source, cluster), taken in the given order.

    Open bins are ordered by residual, then number.  A bin's source bitmap has a bit for
    each source that holds ``source_share`` of the capacity or more, its cluster bitmap
    one for each duplicate cluster inside; the search goes from the tightest residual
    upwards until both bits of the piece are free.  A null source or cluster never conflicts.
    """
    source_bit: dict[object, int] = {}
    copies = Counter(c for _, _, c in pieces if c is not None)
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in copies.items() if n > 1)}
    order: list[tuple[int, int]] = []  # residual and bin, ascending
    full_sources: list[int] = []
    clusters: list[int] = []
    held: list[Counter] = []
    n_in: list[int] = []
    smallest = min((p[0] for p in pieces), default=0)
    out = []
    for length, source, cluster in pieces:
        s = 0 if source is None else source_bit.setdefault(source, 1 << len(source_bit))
        c = cluster_bit.get(cluster, 0)
        at = bisect_left(order, (length, -1))
        while at < len(order) and (full_sources[order[at][1]] & s or clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(n_in)
            full_sources.append(0)
            clusters.append(0)
            held.append(Counter())
            n_in.append(0)
        out.append((b, n_in[b], capacity - residual))
        n_in[b] += 1
        clusters[b] |= c
        if s:
            held[b][s] += length
            if held[b][s] >= source_share * capacity:
                full_sources[b] |= s
        if residual - length >= smallest:
            entry = (residual - length, b)
            order.insert(bisect_left(order, entry), entry)
    return out


def pack(
    docs: DataFrame,
    length: Column,
    cluster: Column,
    capacity: int = 4096,
    source_share: float = 0.5,
    shard_pieces: int = 4096,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """One row per piece: ``id_col, copy, piece, start, n_tokens, bin_id, place, offset``.

    ``length`` is the document's token count; a null or 0 gives one empty piece, so every
    row of ``docs`` appears.  A document longer than ``capacity`` is cut into full
    sequences and a rest.  Repeated rows are numbered by ``copy`` and spread over shards
    like all others.  Ties in length go by id, copy and piece.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    n = F.coalesce(length.cast("long"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), cluster.cast("long").alias("cluster"), n.alias("n"))
    each = rows.groupBy("id", "source", "cluster", "n").agg(F.count(F.lit(1)).alias("copies"))
    pieces = (
        each.select("id", "source", "cluster", "n", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)))).alias("piece"))
        .select("id", "source", "cluster", "copy", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("len"))
    )
    total = rows.agg(F.sum(F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "source", "cluster", "copy", "piece"), F.lit(shards)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["len", "id", "copy", "piece", "source", "cluster"], ascending=[False, True, True, True, True, True], na_position="first")
        plain = lambda c: [None if pd.isna(v) else v for v in group[c]]
        lengths = [int(v) for v in group["len"]]
        placed = best_fit(list(zip(lengths, plain("source"), plain("cluster"))), capacity, source_share)
        return pd.DataFrame(
            {
                "id": group["id"], "copy": group["copy"], "piece": group["piece"], "start": group["start"], "n_tokens": group["len"],
                "bin_id": [(int(s) << 32) + b for s, (b, _, _) in zip(group["shard"], placed)],
                "place": [p for _, p, _ in placed], "offset": [o for _, _, o in placed],
            }
        )

    schema = f"id {kind}, copy long, piece long, start long, n_tokens long, bin_id long, place int, offset int"
    return dealt.groupBy("shard").applyInPandas(run, schema).withColumnRenamed("id", id_col)
