"""Named matrices in long form ``(row, col, value)``: summaries and normalisation.

Totals per row or column come from a partial aggregation that is joined back,
so that a column with a third of all rows never sits in one window task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.functions import ranking as R

_QS = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]


def attach(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Join group aggregates back to the rows."""
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(totals, keys)


def attach_small(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """As ``attach`` by a window: one shuffle, for groups that the data model keeps small.

    Such groups are the four bases of a position, the cells of a motif or the tracks of a row.
    """
    w = W.partitionBy(*keys)
    return df.withColumns({n: c.over(w) for n, c in aggs.items()})


# ------------------------------------------------------------------ summaries
def gini(df: DataFrame, keys: list[str], value: str = "value", eps: float = 1e-16) -> DataFrame:
    """Gini coefficient per group after shifting the minimum to 0 and adding ``eps``."""
    cells = R.rank_cells(df.select(*keys, F.col(value).cast("double").alias("__x")), keys, "__x")
    weight = F.col("n") * (2 * F.col("n_before") + F.col("n") - F.col("n_total"))
    agg = cells.groupBy(*keys).agg(
        F.sum(F.col("__x") * weight).alias("num"),
        F.sum(F.col("__x") * F.col("n")).alias("s"),
        F.min("__x").alias("lo"),
        F.max("n_total").alias("n"),
    )
    den = F.col("n") * (F.col("s") - F.col("n") * F.col("lo") + F.col("n") * F.lit(eps))
    return agg.select(*keys, (F.col("num") / den).alias("gini"))


def matrix_stats(df: DataFrame, axis: str = "row", round_to: int | None = None, small_groups: bool | None = None) -> DataFrame:
    """min, percentiles, max, mean, 95-5 spread, std, skew, variation and Gini per row or column.

    A row holds one value per track, so by default rows are summarised in one aggregation over
    their few values; a column holds one value per data point and goes through value buckets.
    """
    v = F.col("value").cast("double")
    names = [f"p{int(q * 100)}" for q in _QS]
    plain = [
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.skewness(v).alias("skew"),
    ]
    if axis == "row" if small_groups is None else small_groups:
        g = df.groupBy(axis).agg(
            *plain, F.percentile(v, F.array(*[F.lit(q) for q in _QS])).alias("q"), F.sort_array(F.collect_list(v)).alias("x")
        )
        n = F.size("x")
        num = F.aggregate(
            F.transform("x", lambda x, i: (2 * (i + 1) - n - 1) * x), F.lit(0.0), lambda s, t: s + t
        )
        den = n * (F.aggregate("x", F.lit(0.0), lambda s, t: s + t) - n * F.col("min") + n * F.lit(1e-16))
        out = g.select(
            axis, "min", "max", "mean", "std", "skew", *[F.col("q")[i].alias(c) for i, c in enumerate(names)], (num / den).alias("gini")
        )
    else:
        pct = R.exact_percentiles(df, [axis], "value", _QS, names)
        out = df.groupBy(axis).agg(*plain).join(pct, axis).join(gini(df, [axis]), axis)
    out = out.withColumn("spread", F.col("p95") - F.col("p5")).withColumn(
        "cv", F.try_divide(F.col("std"), F.col("mean"))
    )
    if round_to is not None:
        cols = [c for c in out.columns if c != axis]
        out = out.select(axis, *[F.round(c, round_to).alias(c) for c in cols])
    return out


def replicate_mean(df: DataFrame, geometric: bool = False, sep: str = "_") -> DataFrame:
    """Mean over replicate columns; the name before the last separator is the group."""
    group = F.regexp_replace("col", f"{sep}[^{sep}]*$", "")
    mean = F.exp(F.avg(F.log("value"))) if geometric else F.avg("value")
    return df.groupBy("row", group.alias("col")).agg(mean.alias("value"))


def combine_runs(runs: DataFrame, n_runs: int, how: str = "mean") -> DataFrame:
    """min, max or mean over runs ``(run, name, value)`` for names that occur in every run."""
    fn = {"mean": F.avg, "min": F.min, "max": F.max}[how]
    agg = runs.groupBy("name").agg(fn("value").alias("value"), F.count_distinct("run").alias("__n"))
    return agg.filter(F.col("__n") == n_runs).drop("__n")


def signed_maxabs(value: str | Column, tie: str | Column | None = None) -> Column:
    """Value with the largest absolute size, sign kept; the positive one wins a tie."""
    v = F.col(value) if isinstance(value, str) else value
    return F.max_by(v, F.struct(F.abs(v), v))


def summarize_by_datatype(df: DataFrame, sep: str = ".") -> DataFrame:
    """Per row and data type (column suffix): mean, variation, signed max-abs and scaled forms."""
    typed = df.select("row", F.substring_index("col", sep, -1).alias("datatype"), "value")
    per = typed.groupBy("row", "datatype").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("sd"),
        signed_maxabs("value").alias("maxabs"),
    )
    per = per.withColumn("cv", F.try_divide(F.col("sd"), F.col("mean"))).drop("sd")
    per = attach(per, ["datatype"], top_mean=F.max(F.abs("mean")), top_max=F.max(F.abs("maxabs")))
    return per.select(
        "row", "datatype", "mean", "cv", "maxabs",
        F.try_divide(F.col("mean"), F.col("top_mean")).alias("mean_scaled"),
        F.try_divide(F.col("maxabs"), F.col("top_max")).alias("maxabs_scaled"),
    )


def class_mean_tracks(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Mean over the tracks of each class; ``classes`` is ``(col, class)``."""
    return df.join(classes, "col").groupBy("row", F.col("class").alias("col")).agg(F.avg("value").alias("value"))


def run_table(df: DataFrame, sort_by: str = "mean") -> DataFrame:
    """mean, std, median of ``(model, value)`` per model, sorted."""
    base = df.groupBy("model").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    med = R.exact_percentiles(df, ["model"], "value", [0.5], ["median"])
    return base.join(med, "model").orderBy(F.col(sort_by).desc(), "model")


def histogram(df: DataFrame, value: str, start: float, end: float, bins: int, keys: list[str] | None = None) -> DataFrame:
    """Fixed-width bin counts with cumulative share; the last bin is closed, outside values are left out."""
    keys = keys or []
    width = (end - start) / bins
    b = F.least(F.floor((F.col(value) - start) / width), F.lit(bins - 1)).cast("int")
    counts = (
        df.filter((F.col(value) >= start) & (F.col(value) <= end))
        .groupBy(*keys, b.alias("bin"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    wk = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    w = wk.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumn("cumulative", F.sum("cnt").over(w) / F.sum("cnt").over(wk))


def binned_quantiles(df: DataFrame, x: str, y: str, start: float, end: float, bins: int) -> DataFrame:
    """Box statistics of ``y`` in equal bins of ``x``."""
    width = (end - start) / bins
    b = F.least(F.floor((F.col(x) - start) / width), F.lit(bins - 1)).cast("int")
    data = df.filter((F.col(x) >= start) & (F.col(x) <= end)).select(b.alias("bin"), F.col(y).alias("y"))
    pct = R.exact_percentiles(data, ["bin"], "y", [0.0, 0.25, 0.5, 0.75, 1.0], ["lo", "q1", "median", "q3", "hi"])
    return pct.join(data.groupBy("bin").agg(F.count(F.lit(1)).alias("cnt")), "bin")


def sliding_density(df: DataFrame, value: str, start: float, end: float, bins: int = 20, shifts: int = 4) -> DataFrame:
    """Mean normalised bin density of each distinct value over grids shifted both ways.

    Each grid is moved by (m+1)/(shifts+1) of a bin to the left and to the right,
    scaled to a top of 1, and a value outside a grid does not count for it.
    """
    width = (end - start) / bins
    moves = [d * (m + 1) * width / (shifts + 1) for m in range(shifts) for d in (-1, 1)]
    grids = F.array(*[F.struct(F.lit(i).alias("grid"), F.lit(o).alias("move")) for i, o in enumerate(moves)])
    values = df.groupBy(F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    placed = values.select("x", "n", F.inline(grids)).withColumn(
        "bin", F.floor((F.col("x") - (F.lit(start) + F.col("move"))) / width).cast("int")
    )
    placed = placed.filter((F.col("bin") >= 0) & (F.col("bin") < bins))
    cells = placed.groupBy("grid", "bin").agg(F.sum("n").alias("cnt"))
    cells = attach(cells, ["grid"], top=F.max("cnt"))
    dens = placed.join(cells.select("grid", "bin", (F.col("cnt") / F.col("top")).alias("d")), ["grid", "bin"])
    return dens.groupBy("x").agg(F.avg("d").alias("density"))


# -------------------------------------------------------------- normalisation
def tpm(df: DataFrame, lengths: DataFrame) -> DataFrame:
    """Counts over length, then each column scaled to one million; ``lengths`` is ``(row, length)``."""
    rate = df.join(lengths, "row").select("row", "col", (F.col("value") / F.col("length") * 1e3).alias("value"))
    tot = attach(rate, ["col"], total=F.sum("value"))
    return tot.select("row", "col", F.try_divide(F.col("value"), F.col("total") / 1e6).alias("value"))


def size_factors(df: DataFrame, pseudo: float = 0.0) -> DataFrame:
    """Median over rows of the ratio to the row's geometric mean, per column; 0/0 counts as 1."""
    x = df.select("row", "col", (F.col("value") + pseudo).alias("value"))
    # log of 0 is null in Spark, so the geometric mean with any zero is set to 0 by hand
    geo = x.groupBy("row").agg(
        F.when(F.min("value") <= 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.log("value")))).alias("geo")
    )
    ratio = x.join(geo, "row").select(
        "col",
        F.when((F.col("value") == 0) & (F.col("geo") == 0), F.lit(1.0))
        .otherwise(F.try_divide(F.col("value"), F.col("geo")))
        .alias("ratio"),
    )
    return R.exact_percentiles(ratio, ["col"], "ratio", [0.5], ["size_factor"])


def median_ratio_normalize(df: DataFrame, pseudo: float = 0.0) -> DataFrame:
    factors = size_factors(df, pseudo)
    return df.join(factors, "col").select(
        "row", "col", F.try_divide(F.col("value") + pseudo, F.col("size_factor")).alias("value")
    )


def quantile_normalize(df: DataFrame, tie: str | None = None) -> DataFrame:
    """Every column takes the mean sorted profile; ties are broken by the numeric ``tie`` column."""
    t = tie or "__tie"
    x = df if tie else df.withColumn(t, F.xxhash64("row"))
    ranked = R.ordinal_rank(x, ["col"], "value", t, "__rank")
    profile = ranked.groupBy("__rank").agg(F.avg("value").alias("__mean"))
    return ranked.join(profile, "__rank").select("row", "col", F.col("__mean").alias("value"))


def transform_chain(df: DataFrame, steps: list[str], tie: str | None = None) -> DataFrame:
    """Ordered transforms ``mean``, ``geomean``, ``add=X``, ``log2``, ``quantile``."""
    for step in steps:
        if step == "mean":
            df = replicate_mean(df)
        elif step == "geomean":
            df = replicate_mean(df, geometric=True)
        elif step.startswith("add="):
            df = df.withColumn("value", F.col("value") + float(step[4:]))
        elif step == "log2":
            df = df.withColumn("value", F.log2(F.when(F.col("value") <= 0, 1e-8).otherwise(F.col("value"))))
        elif step == "quantile":
            df = quantile_normalize(df, tie)
        else:
            raise ValueError(f"unknown transform {step}")
    return df


def log_ratio(num: DataFrame, den: DataFrame, log2: bool = True) -> DataFrame:
    """Numerator minus denominator on common cells; null with ``log2`` where the denominator is 0."""
    j = num.join(den.withColumnRenamed("value", "__d"), ["row", "col"])
    zero = F.col("__d") == 0
    if log2:
        v = F.when(zero | (F.col("value") <= 0), F.lit(None)).otherwise(F.log2("value") - F.log2("__d"))
    else:
        v = F.when(zero, F.lit(0.0)).otherwise(F.col("value")) - F.col("__d")
    return j.select("row", "col", v.cast("double").alias("value"))


def fold_change(df: DataFrame, design: DataFrame, control: str | None = None, pseudo: float = 1.0) -> DataFrame:
    """log2 contrast of condition means against a control or the mean of all conditions."""
    means = (
        df.join(design, "col")
        .groupBy("row", "condition")
        .agg(F.avg(F.log2(F.col("value") + pseudo)).alias("m"))
    )
    if control is None:
        both = attach_small(means, ["row"], ref=F.avg("m"))
    else:
        ref = means.filter(F.col("condition") == control).select("row", F.col("m").alias("ref"))
        both = means.filter(F.col("condition") != control).join(ref, "row")
    return both.select("row", "condition", (F.col("m") - F.col("ref")).alias("log2fc"))


def remove_batch_effect(df: DataFrame, design: DataFrame) -> DataFrame:
    """Subtract each batch's deviation from the mean of batch means, per row."""
    d = df.join(design, "col")
    batch = d.groupBy("row", "batch").agg(F.avg("value").alias("bm"))
    batch = attach_small(batch, ["row"], overall=F.avg("bm"))
    return d.join(batch, ["row", "batch"]).select(
        "row", "col", (F.col("value") - F.col("bm") + F.col("overall")).alias("value")
    )


def zero_row_alignment(a: DataFrame, b: DataFrame, drop_zero: bool = True) -> DataFrame:
    """Align two count tables on (row, col); absent cells become 0; optionally drop all-zero rows."""
    j = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), ["row", "col"], "full_outer")
    j = j.select("row", "col", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    if drop_zero:
        live = j.groupBy("row").agg(F.sum(F.abs("a") + F.abs("b")).alias("s")).filter("s > 0").select("row")
        j = j.join(live, "row", "left_semi")
    return j


def normalize_matrix(df: DataFrame, how: str = "center_feature") -> DataFrame:
    """``center_feature|center_data|norm1_feature|norm1_data|norm2_feature|norm2_data``.

    A feature is a column, a data point is a row.  A zero norm counts as 1.
    """
    kind, axis = how.split("_")
    key = {"feature": "col", "data": "row"}[axis]
    agg = {
        "center": F.avg("value"),
        "norm1": F.sum(F.abs("value")),
        "norm2": F.sqrt(F.sum(F.col("value") * F.col("value"))),
    }[kind]
    if axis == "data" and kind != "norm2":
        j = attach_small(df, [key], __t=agg)
    else:
        j = attach(df, [key], __t=agg)
    if kind == "center":
        v = F.col("value") - F.col("__t")
    else:
        v = F.col("value") / F.when(F.col("__t") == 0, 1.0).otherwise(F.col("__t"))
    return j.select("row", "col", v.alias("value"))


def column_norms(df: DataFrame) -> DataFrame:
    """Stored column norms, to undo a ``norm2_feature`` scaling of outputs."""
    return df.groupBy("col").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def undo_norm(df: DataFrame, norms: DataFrame) -> DataFrame:
    return df.join(norms, "col").select("row", "col", (F.col("value") * F.col("norm")).alias("value"))


def fit_standardizer(df: DataFrame) -> DataFrame:
    """Mean and std per column; columns without variance are left out."""
    f = df.groupBy("col").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return f.filter(F.col("std") > 0)


def standardize_features(df: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """Centre and scale to unit std with a fitted table (fitted on ``df`` when not given)."""
    f = fitted if fitted is not None else fit_standardizer(df)
    return df.join(f, "col").select("row", "col", ((F.col("value") - F.col("mean")) / F.col("std")).alias("value"))


def pairwise_products(df: DataFrame) -> DataFrame:
    """Original columns plus all products of two columns in the same row.

    The products are built inside one row's collected features, without a self-join.
    """
    packed = df.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("f"))
    pairs = F.flatten(
        F.transform(
            "f",
            lambda a, i: F.transform(
                F.slice("f", i + 2, F.greatest(F.size("f") - i - 1, F.lit(0))),
                lambda b: F.struct(
                    F.concat_ws("*", a["col"], b["col"]).alias("col"), (a["value"] * b["value"]).alias("value")
                ),
            ),
        )
    )
    return packed.select("row", F.inline(F.concat("f", pairs)))


def similarity_to_distance(df: DataFrame, value: str = "value") -> DataFrame:
    """Min-max scale a similarity table ``(a, b, value)`` and flip it."""
    lim = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return df.join(F.broadcast(lim)).withColumn(
        "distance", 1 - F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo"))
    ).drop("lo", "hi")


# ----------------------------------------------------------- elementwise edits
def transform_values(df: DataFrame, steps: list[str], value: str = "value") -> DataFrame:
    """``flip`` (1-x), ``log10``, ``log10p1``, ``clip=X`` (infinities and size), ``nan=X``."""
    v = F.col(value).cast("double")
    for s in steps:
        if s == "flip":
            v = 1 - v
        elif s == "log10":
            v = F.log10(v)
        elif s == "log10p1":
            v = F.log10(v + 1)
        elif s.startswith("clip="):
            lim = float(s[5:])
            v = F.greatest(F.least(v, F.lit(lim)), F.lit(-lim))
        elif s.startswith("nan="):
            v = F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(float(s[4:])))
        else:
            raise ValueError(s)
    return df.withColumn(value, v)


def rescale_by_reference(df: DataFrame, ref: DataFrame, minimum: float, maximum: float) -> DataFrame:
    """Divide by a reference per name, drop references under ``minimum``, cap at ``maximum``."""
    j = df.join(ref.withColumnRenamed("value", "__r"), "name").filter(F.col("__r") >= minimum)
    return j.select("name", F.least(F.col("value") / F.col("__r"), F.lit(maximum)).alias("value"))
