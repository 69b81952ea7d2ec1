"""Ranks, running sums and exact percentiles for groups of any size.

A window over one column of a tall matrix would sort the whole column in one
task.  Here a value is first mapped to an order-preserving bucket that depends
on the value only (1,024 buckets per factor of two).  Equal values are counted
before the shuffle, bucket totals give the offset, and only rows inside one
bucket are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_PER_OCTAVE = 1024
_SHIFT = 1_200_000


def value_bucket(v: Column, per_octave: int = _PER_OCTAVE) -> Column:
    """Monotone bucket number of a double; nulls stay null, NaN is largest."""
    shift = (_SHIFT // _PER_OCTAVE) * per_octave
    v = v.cast("double")
    size = F.floor(F.log2(F.abs(v)) * per_octave) + shift
    return (
        F.when(F.isnan(v), F.lit(10 * shift))
        .when(v == 0, F.lit(0))
        .when(v == float("inf"), F.lit(9 * shift))
        .when(v == float("-inf"), F.lit(-9 * shift))
        .otherwise(F.signum(v).cast("bigint") * size)
        .cast("bigint")
    )


def running_totals(
    cells: DataFrame, keys: list[str], value: str, sums: list[str], extra: list[str] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add ``<s>_before`` (sum over smaller values) and ``<s>_total`` for each sum.

    ``cells`` has one row per ``keys + value + extra`` and is already aggregated.
    With ``descending`` "before" means larger values.
    """
    extra = extra or []
    b = "__bucket"
    cells = cells.withColumn(b, value_bucket(F.col(value)))
    if descending:
        cells = cells.withColumn(b, -F.col(b))
    wk = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    w = wk.orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    totals = cells.groupBy(*keys, b).agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    offsets = totals.select(
        *keys,
        b,
        *[F.coalesce(F.sum(f"__{s}").over(w), F.lit(0)).alias(f"__{s}_off") for s in sums],
        *[F.sum(f"__{s}").over(wk).alias(f"{s}_total") for s in sums],
    )
    order = [F.col(value).desc() if descending else F.col(value).asc()] + [F.col(e) for e in extra]
    inner = W.partitionBy(*keys, b).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = _join_null_safe(cells, offsets, keys, b)
    for s in sums:
        out = out.withColumn(f"{s}_before", F.coalesce(F.sum(s).over(inner), F.lit(0)) + F.col(f"__{s}_off"))
    return out.drop(b, *[f"__{s}_off" for s in sums])


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], b: str) -> DataFrame:
    return left.join(right, [*keys, b], "inner")


def ordinal_rank(df: DataFrame, keys: list[str], value: str, tie: str, out: str = "rank", descending: bool = False) -> DataFrame:
    """0-based rank inside each group, ties ordered by the numeric column ``tie``.

    Equal values are spread over buckets of the tie column, so that a value that
    fills a third of a column does not meet in one task.
    """
    tb = "__tie_bucket"
    rows = df.withColumn(tb, value_bucket(F.col(tie), 64))
    cells = rows.groupBy(*keys, value, tb).agg(F.count(F.lit(1)).alias("__n"))
    cells = running_totals(cells, keys, value, ["__n"], [tb], descending).drop("__n", "__n_total")
    w = W.partitionBy(*keys, value, tb).orderBy(tie)
    return (
        rows.join(cells, [*keys, value, tb])
        .withColumn(out, (F.col("__n_before") + F.row_number().over(w) - 1).cast("bigint"))
        .drop("__n_before", tb)
    )


def rank_cells(df: DataFrame, keys: list[str], value: str, weights: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct value with ``n``, ``n_before``, ``n_total`` and ``avg_rank`` (1-based).

    Tests on ranks only need these cells, never one rank per input row.
    """
    weights = weights or {}
    cells = df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in weights.items()]
    )
    out = running_totals(cells, keys, value, ["n"])
    return out.withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / F.lit(2.0))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, qs: list[float], names: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per entry of ``qs``.

    Only the buckets that hold a wanted position are sorted.
    """
    names = names or [f"p{q}" for q in qs]
    b = "__bucket"
    data = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    cells = data.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n")).withColumn(b, value_bucket(F.col("__v")))
    wk = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    totals = cells.groupBy(*keys, b).agg(F.sum("__n").alias("__bn"))
    totals = totals.select(
        *keys,
        b,
        "__bn",
        F.sum("__bn").over(wk).alias("__total"),
        (F.sum("__bn").over(wk.orderBy(b).rowsBetween(W.unboundedPreceding, 0)) - F.col("__bn")).alias("__off"),
    )
    q_arr = F.array(*[F.lit(float(q)) for q in qs])
    ranks = F.array_distinct(
        F.flatten(
            F.transform(
                q_arr,
                lambda q: F.array(
                    F.floor(q * (F.col("__total") - 1)).cast("bigint"), F.ceil(q * (F.col("__total") - 1)).cast("bigint")
                ),
            )
        )
    )
    wanted = totals.withColumn(
        "__want", F.filter(ranks, lambda r: (r >= F.col("__off")) & (r < F.col("__off") + F.col("__bn")))
    ).filter(F.size("__want") > 0)
    inner = W.partitionBy(*keys, b).orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    hit = (
        cells.join(wanted, [*keys, b])
        .withColumn("__hi", F.col("__off") + F.sum("__n").over(inner))
        .withColumn("__lo", F.col("__hi") - F.col("__n"))
        .withColumn("__r", F.explode(F.filter("__want", lambda r: (r >= F.col("__lo")) & (r < F.col("__hi")))))
    )
    grouped = hit.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("__r", "__v"))).alias("__at"), F.max("__total").alias("__total")
    )
    cols = []
    for q, name in zip(qs, names):
        pos = F.lit(float(q)) * (F.col("__total") - 1)
        lo, hi = F.floor(pos).cast("bigint"), F.ceil(pos).cast("bigint")
        vlo, vhi = F.element_at("__at", lo), F.element_at("__at", hi)
        cols.append((vlo + (vhi - vlo) * (pos - lo)).alias(name))
    return grouped.select(*keys, *cols)
