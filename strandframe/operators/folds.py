"""Train, validation and test folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.ranking import ordinal_rank
from strandframe.operators.matrix import attach
from strandframe.session import maybe_broadcast


def stratified_folds(df: DataFrame, folds: int, name: str = "name", label: str | None = None, seed: int = 0, order: str | None = None) -> DataFrame:
    """``(name, fold)`` with an equal share of every class per fold.

    Names are put in hash order (or in the order of a numeric column) inside each class and cut
    into ``folds`` equal parts; the rank is computed in buckets, so a class may be of any size.
    """
    cls = F.col(label) if label else F.lit(0)
    if order:
        x = df.select(F.col(name).alias("name"), cls.alias("__c"), F.col(order).cast("double").alias("__v"), F.col(order).alias("__t"))
    else:
        h = F.xxhash64(F.col(name), F.lit(seed))
        x = df.select(
            F.col(name).alias("name"), cls.alias("__c"), F.shiftright(h, 11).cast("double").alias("__v"), F.xxhash64(F.col(name), F.lit(seed + 1)).alias("__t")
        )
    ranked = attach(ordinal_rank(x, ["__c"], "__v", "__t", "__r"), ["__c"], __n=F.count(F.lit(1)))
    return ranked.select("name", F.floor(F.col("__r") * folds / F.col("__n")).cast("int").alias("fold"))


def split_roles(folds: DataFrame, n_folds: int, fold: int, from_file: bool = False) -> DataFrame:
    """``test``, ``val`` or ``train`` per name.

    Numbered folds: test is ``fold`` and validation the one before.  Folds from a file:
    validation is ``fold`` and test the next one.
    """
    test = (fold + 1) % n_folds if from_file else fold % n_folds
    val = fold % n_folds if from_file else (fold - 1) % n_folds
    role = F.when(F.col("fold") == test, "test").when(F.col("fold") == val, "val").otherwise("train")
    return folds.select("name", role.alias("role"))


def _poured(sizes: np.ndarray, counts: np.ndarray, folds: int, order: np.ndarray) -> np.ndarray:
    """Groups of each size dealt to the folds, all of a size at once, each where least is so far."""
    dealt, total = np.zeros((len(sizes), folds), np.int64), np.zeros(folds)
    for k in order:
        left = int(counts[k])
        while left:
            # raise the lowest folds to the common level that the groups of this size reach
            ranked = np.sort(total)
            fill = np.append(np.arange(1, folds) * ranked[1:] - np.cumsum(ranked)[:-1], np.inf)
            reach = int(np.searchsorted(fill, left * sizes[k])) + 1
            level = (ranked[:reach].sum() + left * sizes[k]) / reach
            more = np.floor(np.maximum(level - total, 0) / sizes[k]).astype(np.int64)
            if more.sum() == 0 or more.sum() > left:
                more = np.zeros(folds, np.int64)
                more[int(np.argmin(total))] = 1
            dealt[k] += more
            total += more * sizes[k]
            left -= int(more.sum())
    return dealt


def _evened(dealt: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A group moves, or two change places, as long as that brings two folds closer."""
    dealt, total = dealt.copy(), sizes @ dealt
    rising = np.argsort(sizes, kind="stable")
    moved = True
    while moved:
        moved = False
        for f in np.argsort(-total, kind="stable"):
            for g in np.argsort(total, kind="stable"):
                gap = total[f] - total[g]
                if gap <= 0:
                    continue
                mine, theirs = rising[dealt[rising, f] > 0], rising[dealt[rising, g] > 0]
                back = np.append(0.0, sizes[theirs])  # against nothing, or against one of the other fold
                best = np.searchsorted(back, sizes[mine] - gap / 2)
                tries = [(abs(sizes[i] - back[j] - gap / 2), int(i), int(j)) for i, c in zip(mine, best) for j in (c - 1, c) if 0 <= j < len(back)]
                off, i, j = min(tries, default=(np.inf, 0, 0))
                if off < gap / 2 - 1e-9:
                    dealt[i, f] -= 1
                    dealt[i, g] += 1
                    if j:
                        dealt[theirs[j - 1], g] -= 1
                        dealt[theirs[j - 1], f] += 1
                    change = sizes[i] - back[j]
                    total[f] -= change
                    total[g] += change
                    moved = True
    return dealt


def deal_sizes(sizes: np.ndarray, counts: np.ndarray, folds: int, tries: int = 40) -> np.ndarray:
    """How many groups of each size go to each fold, so that the folds are of near-equal size: largest sizes first, or the best of some other orders."""
    rng = np.random.default_rng(0)
    best, least = None, np.inf
    for t in range(tries):
        order = np.argsort(-sizes, kind="stable") if t == 0 else rng.permutation(len(sizes))
        dealt = _evened(_poured(sizes, counts, folds, order), sizes)
        off = np.ptp(sizes @ dealt) if len(sizes) else 0.0
        if off < least:
            best, least = dealt, off
        if least <= 1:
            break
    return best


def group_balanced_folds(df: DataFrame, group: str, folds: int, name: str = "name", seed: int = 0) -> DataFrame:
    """``(name, fold)``: whole groups to folds of near-equal size, by one rule for any number of groups.

    Only the number of groups of each size reaches the driver (N rows have at most sqrt(2 N) different
    sizes); which group of a size goes where follows from its rank in hash order.  Rows
    without a group are a group of their own.
    """
    key = F.struct(F.col(group).alias("g"))
    sizes = df.groupBy(key.alias("__g")).agg(F.count(F.lit(1)).alias("__size"))
    table = sizes.groupBy("__size").agg(F.count(F.lit(1)).alias("c")).orderBy("__size").collect()
    each, counts = np.array([r["__size"] for r in table], float), np.array([r["c"] for r in table], np.int64)
    dealt = deal_sizes(each, counts, folds)
    rows = []
    for k, r in enumerate(table):
        ends = np.cumsum(dealt[k])
        rows += [(int(r["__size"]), int(f), int(ends[f] - dealt[k, f]), int(ends[f])) for f in range(folds) if dealt[k, f]]
    spark = df.sparkSession
    parts = maybe_broadcast(spark.createDataFrame(rows, "__size long, fold int, __lo long, __hi long"))
    text = F.col("__g").cast("string")
    hashed = sizes.select("__g", "__size", F.shiftright(F.xxhash64(text, F.lit(seed)), 11).cast("double").alias("__v"), F.xxhash64(text, F.lit(seed + 1)).alias("__t"))
    ranked = ordinal_rank(hashed, ["__size"], "__v", "__t", "__r")
    chosen = ranked.join(parts, "__size").where("__r >= __lo AND __r < __hi").select("__g", "fold")
    return df.select(F.col(name).alias("name"), key.alias("__g")).join(chosen, "__g").select("name", "fold")
