"""Grouped metrics, rank tests and multiple-testing corrections.

Rank statistics use one row per distinct value (see ``functions.ranking``), so no
group is sorted as a whole in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.functions import ranking as R
from strandframe.functions import special as SP
from strandframe.operators.matrix import attach


def rank_transform(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """0-based ordinal rank in each group, ties by position."""
    return R.ordinal_rank(df, keys, value, tie, "rank")


# ---------------------------------------------------------- pairwise distances
def pearson_expr(a: Column, b: Column) -> Column:
    """Correlation with the reference's edge rules: -1 when one side is constant, null for both."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)  # pairs with both sides only
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    one = (sa == 0) | (sb == 0)
    both = (sa == 0) & (sb == 0)
    r = F.covar_pop(a, b) / F.nullif(sa * sb, F.lit(0.0))
    return F.when(both, F.lit(None).cast("double")).when(one, F.lit(-1.0)).otherwise(r)


def cosine_expr(a: Column, b: Column) -> Column:
    na, nb = F.sum(a * a), F.sum(b * b)
    r = F.sum(a * b) / F.nullif(F.sqrt(na) * F.sqrt(nb), F.lit(0.0))
    return F.when((na == 0) & (nb == 0), F.lit(None).cast("double")).when((na == 0) | (nb == 0), F.lit(-1.0)).otherwise(r)


def _spearman_input(df: DataFrame, keys: list[str], a: str, b: str, tie: str) -> DataFrame:
    df = R.ordinal_rank(df, keys, a, tie, "__ra")
    df = R.ordinal_rank(df, keys, b, tie, "__rb")
    return df.withColumn(a, F.col("__ra").cast("double")).withColumn(b, F.col("__rb").cast("double"))


def correlation(
    df: DataFrame, keys: list[str], a: str = "a", b: str = "b", kind: str = "pearson", distance: bool = True,
    tie: str | None = None,
) -> DataFrame:
    """Correlation (distance) per group, four decimals; spearman needs the numeric ``tie`` column."""
    if kind == "spearman":
        if tie is None:
            raise ValueError("spearman ranks need a tie column")
        df = _spearman_input(df, keys, a, b, tie)
    expr = (cosine_expr if kind == "cosine" else pearson_expr)(F.col(a), F.col(b))
    out = (1 - expr) if distance else expr
    return df.groupBy(*keys).agg(F.round(out, 4).alias("correlation"))


def rmse(df: DataFrame, keys: list[str], a: str = "a", b: str = "b", root: bool = True) -> DataFrame:
    m = F.avg(F.pow(F.col(a) - F.col(b), F.lit(2)))
    return df.groupBy(*keys).agg((F.sqrt(m) if root else m).alias("rmse" if root else "mse"))


def relative_error(df: DataFrame, keys: list[str], predicted: str = "b", target: str = "a") -> DataFrame:
    """Mean absolute error over the target; a target of 0 counts as 1."""
    t = F.col(target)
    return df.groupBy(*keys).agg(
        F.avg(F.abs(t - F.col(predicted)) / F.when(t == 0, 1.0).otherwise(t)).alias("relative_error")
    )


def distance_measures(df: DataFrame, keys: list[str], a: str = "a", b: str = "b", tie: str | None = None) -> DataFrame:
    """dot, cosine, pearson, absolute and euclidean per group (spearman with ``tie``)."""
    x, y = F.col(a), F.col(b)
    out = df.groupBy(*keys).agg(
        F.sum(x * y).alias("dot"),
        (1 - cosine_expr(x, y)).alias("cosine"),
        (1 - pearson_expr(x, y)).alias("pearson"),
        F.sum(F.abs(x - y)).alias("absolute"),
        F.sqrt(F.sum((x - y) * (x - y))).alias("euclidean"),
    )
    if tie:
        sp = _spearman_input(df, keys, a, b, tie).groupBy(*keys).agg((1 - pearson_expr(x, y)).alias("spearman"))
        out = out.join(sp, keys)
    return out


# ------------------------------------------------------------ ranking metrics
def auroc(df: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Area under ROC from average ranks; null when a group has one class only."""
    cells = R.rank_cells(df, keys, score, {"pos": F.col(label).cast("bigint")})
    g = cells.groupBy(*keys).agg(
        F.sum(F.col("avg_rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n")
    )
    p, n = F.col("p"), F.col("n") - F.col("p")
    return g.select(*keys, F.try_divide(F.col("r") - p * (p + 1) / 2, p * n).alias("auroc"))


def auprc(df: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Average precision over distinct thresholds."""
    cells = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    run = R.running_totals(cells, keys, score, ["n", "pos"], descending=True)
    precision = (F.col("pos_before") + F.col("pos")) / (F.col("n_before") + F.col("n"))
    term = F.try_divide(F.col("pos"), F.col("pos_total")) * precision
    return run.groupBy(*keys).agg(F.sum(term).alias("auprc"))


def _two_sample(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """n1, n2, rank sum of group 1 and the tie term, per key; ``group`` is boolean-like."""
    cells = R.rank_cells(df, keys, value, {"k": F.col(group).cast("int")})
    return cells.groupBy(*keys).agg(
        F.sum(F.col("avg_rank") * F.col("k")).alias("r1"),
        F.sum("k").cast("double").alias("n1"),
        (F.sum("n") - F.sum("k")).cast("double").alias("n2"),
        F.sum(F.pow(F.col("n"), F.lit(3)) - F.col("n")).alias("ties"),
    )


def rank_sum(df: DataFrame, keys: list[str], group: str, value: str, log: bool = True) -> DataFrame:
    """Wilcoxon rank-sum z of group 1 and its two-sided p (or -log10 p)."""
    s = _two_sample(df, keys, group, value)
    n = F.col("n1") + F.col("n2") + 1
    z = F.try_divide(F.col("r1") - F.col("n1") * n / 2, F.sqrt(F.col("n1") * F.col("n2") * n / 12))
    out = s.select(*keys, z.alias("z")).withColumn("p", 2 * SP.normal_sf(F.abs("z")))
    if log:
        out = out.withColumn("neglog10p", -F.log10("p"))
    return out


def mann_whitney(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """U of group 1 and the two-sided p with tie and continuity correction."""
    s = _two_sample(df, keys, group, value)
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, sd)
    return s.select(*keys, u.alias("u"), z.alias("z")).withColumn("p", F.least(F.lit(1.0), 2 * SP.normal_sf("z")))


def wilcoxon_signed_rank(df: DataFrame, keys: list[str], a: str = "a", b: str = "b", alternative: str = "two-sided") -> DataFrame:
    """Paired test on a - b; zero differences are dropped, normal approximation with tie correction."""
    d = df.select(*keys, (F.col(a) - F.col(b)).alias("d")).filter("d <> 0")
    d = d.withColumn("size", F.abs("d")).withColumn("up", (F.col("d") > 0).cast("int"))
    cells = R.rank_cells(d, keys, "size", {"up": F.col("up")})
    s = cells.groupBy(*keys).agg(
        F.sum(F.col("avg_rank") * F.col("up")).alias("w"),
        F.sum("n").cast("double").alias("n"),
        F.sum(F.pow(F.col("n"), F.lit(3)) - F.col("n")).alias("ties"),
    )
    n = F.col("n")
    se = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    s = s.select(*keys, "w", F.try_divide(F.col("w") - n * (n + 1) / 4, se).alias("z"))
    p = {"two-sided": 2 * SP.normal_sf(F.abs("z")), "less": 1 - SP.normal_sf("z"), "greater": SP.normal_sf("z")}[alternative]
    return s.withColumn("p", p)


# ---------------------------------------------------------------- divergences
def distribution_divergence(df: DataFrame, keys: list[str], a: str = "a", b: str = "b", eps: float = 1e-8) -> DataFrame:
    """Jensen-Shannon (base 2), its natural-log root, KL, symmetric cross-entropy and count+shape errors.

    Both sides are scaled to sum to 1 per group first; negative predictions count as 0.
    """
    x = df.select(*keys, F.col(a).cast("double").alias("a"), F.greatest(F.col(b).cast("double"), F.lit(0.0)).alias("b"))
    t = attach(
        x, keys, sa=F.sum("a"), sb=F.sum("b"), ma=F.min("a"), mb=F.min("b"), n=F.count(F.lit(1))
    )
    p, q = F.try_divide(F.col("a"), F.col("sa")), F.try_divide(F.col("b"), F.col("sb"))
    t = t.withColumn("p", p).withColumn("q", q).withColumn("m", (F.col("p") + F.col("q")) / 2)

    def part(u: str) -> Column:
        return F.when(F.col(u) > 0, F.col(u) * F.log2(F.col(u) / F.col("m"))).otherwise(0.0)

    # shapes after the minimum is taken off, as in the count + shape loss
    na = F.col("sa") - F.col("n") * F.col("ma")
    nb = F.col("sb") - F.col("n") * F.col("mb")
    pn = (F.col("a") - F.col("ma")) / F.when(na == 0, 1.0).otherwise(na)
    qn = (F.col("b") - F.col("mb")) / F.when(nb == 0, 1.0).otherwise(nb)
    js = F.sum((part("p") + part("q")) / 2)
    return t.groupBy(*keys).agg(
        js.alias("js"),
        F.sqrt(F.greatest(js, F.lit(0.0)) * F.lit(0.6931471805599453)).alias("js_distance"),
        F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2((F.col("p") + eps) / (F.col("q") + eps))).otherwise(0.0)).alias("kl"),
        (-F.sum(F.col("p") * F.log(F.col("q") + eps) + F.col("q") * F.log(F.col("p") + eps)) / 2).alias("cross_entropy"),
        F.avg(F.pow(pn - qn, F.lit(2))).alias("shape_mse"),
        F.pow(F.avg("a") - F.avg("b"), F.lit(2)).alias("count_mse"),
    )


def composite_error(df: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Per row of ``(row, col, a, b)``: ratio * row correlation + (1-ratio) * mse, and the
    row/column mixture of correlation and cosine (the column part is averaged over the row's columns)."""
    a, b = F.col("a"), F.col("b")
    rows = df.groupBy("row").agg(
        (1 - pearson_expr(a, b)).alias("rc"), (1 - cosine_expr(a, b)).alias("rcos"), F.avg(F.pow(a - b, F.lit(2))).alias("mse")
    )
    cols = df.groupBy("col").agg((1 - pearson_expr(a, b)).alias("cc"), (1 - cosine_expr(a, b)).alias("ccos"))
    per = df.select("row", "col").join(cols, "col").groupBy("row").agg(F.avg("cc").alias("cc"), F.avg("ccos").alias("ccos"))
    r = F.lit(ratio)
    return rows.join(per, "row").select(
        "row",
        (r * F.col("rc") + (1 - r) * F.col("mse")).alias("correlation_mse"),
        (r * F.col("rc") + (1 - r) * F.col("cc")).alias("correlation_both"),
        (r * F.col("rcos") + (1 - r) * F.col("ccos")).alias("cosine_both"),
    )


# ----------------------------------------------------------------- evaluation
def _metric(name: str, fn: Callable[[DataFrame, list[str]], DataFrame], column: str):
    return lambda df, keys: fn(df, keys).select(*keys, F.lit(name).alias("metric"), F.col(column).cast("double").alias("value"))


METRICS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {
    "mse": _metric("mse", rmse, "rmse"),
    "correlation": _metric("correlation", lambda d, k: correlation(d, k), "correlation"),
    "cosine": _metric("cosine", lambda d, k: correlation(d, k, kind="cosine"), "correlation"),
    "jensenshannon": _metric("jensenshannon", lambda d, k: distribution_divergence(d, k), "js_distance"),
    "relative": _metric("relative", lambda d, k: relative_error(d, k), "relative_error"),
    "wilcoxon": _metric("wilcoxon", lambda d, k: rank_sum(_stack(d, k), k, "measured", "v"), "neglog10p"),
    "auroc": _metric("auroc", lambda d, k: auroc(d, k, "a", "b"), "auroc"),
    "auprc": _metric("auprc", lambda d, k: auprc(d, k, "a", "b"), "auprc"),
}


def _stack(df: DataFrame, keys: list[str]) -> DataFrame:
    both = F.array(F.struct(F.lit(0).alias("measured"), F.col("b").alias("v")), F.struct(F.lit(1).alias("measured"), F.col("a").alias("v")))
    return df.select(*keys, F.inline(both))


def evaluate_predictions(
    measured: DataFrame, predicted: DataFrame, classes: DataFrame, metrics: list[str], per: str = "track"
) -> DataFrame:
    """Metric table ``(class, track|name, metric, value)`` from two ``(name, track, value)`` tables.

    ``classes`` is ``(track, class)``; columns are matched by name.
    """
    j = (
        measured.withColumnRenamed("value", "a")
        .join(predicted.withColumnRenamed("value", "b"), ["name", "track"])
        .join(classes, "track")
    )
    keys = ["class", "track"] if per == "track" else ["class", "name"]
    out = None
    for m in metrics:
        t = METRICS[m](j, keys)
        out = t if out is None else out.unionByName(t)
    return out


def metric_averages(table: DataFrame) -> DataFrame:
    """Mean of each metric per class."""
    return table.groupBy("class", "metric").agg(F.avg("value").alias("value"))


def permutation_baseline(df: DataFrame, seed: int = 0) -> DataFrame:
    """Correlation of each row with its prediction and with the prediction of another row.

    Input ``(row, col, a, b)``.  All rows stand on one ring in hash order, by ranks from
    bucket counts, and each takes the prediction of the next one, so none is its own null.  A lone
    row has no other: its ``shuffled`` is null.
    """
    names = df.select("row").distinct()
    hashed = names.select(
        "row", F.lit(0).alias("__k"), F.shiftright(F.xxhash64("row", F.lit(seed)), 11).cast("double").alias("__v"), F.xxhash64("row", F.lit(seed + 1)).alias("__t")
    )
    placed = attach(R.ordinal_rank(hashed, ["__k"], "__v", "__t", "__r"), ["__k"], __n=F.count(F.lit(1))).where("__n > 1")
    after = placed.select(F.col("row").alias("other"), F.col("__r").alias("__next"))
    ring = placed.select("row", F.pmod(F.col("__r") + 1, F.col("__n")).alias("__next")).join(after, "__next").select("row", "other")
    null = df.select("row", "col", "a").join(ring, "row").join(
        df.select(F.col("row").alias("other"), "col", "b"), ["other", "col"]
    )
    true = correlation(df, ["row"]).withColumnRenamed("correlation", "observed")
    rand = correlation(null, ["row"]).withColumnRenamed("correlation", "shuffled")
    return true.join(rand, "row", "left")


def permutation_test(df: DataFrame, seed: int = 0) -> DataFrame:
    """Paired one-sided test that the observed distance is below the shuffled one."""
    b = permutation_baseline(df, seed).where("shuffled IS NOT NULL").select(F.lit("all").alias("group"), F.col("observed").alias("a"), F.col("shuffled").alias("b"))
    return wilcoxon_signed_rank(b, ["group"], alternative="less")


# ---------------------------------------------------------- multiple testing
def bh_adjust(df: DataFrame, keys: list[str], p: str = "p", out: str = "q") -> DataFrame:
    """Benjamini-Hochberg per group.

    The smallest ``p * m / rank`` over equal and larger p values is a suffix minimum,
    taken per value bucket first and inside the bucket after; rows join on their p value.
    """
    cells = R.rank_cells(df.filter(F.col(p).isNotNull()), keys, p)
    cells = cells.withColumn("__r", F.col(p) * F.col("n_total") / (F.col("n_before") + F.col("n")))
    cells = cells.withColumn("__b", R.value_bucket(F.col(p)))
    wk = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    later = wk.orderBy(F.col("__b").desc()).rowsBetween(W.unboundedPreceding, -1)
    buckets = cells.groupBy(*keys, "__b").agg(F.min("__r").alias("__m"))
    buckets = buckets.select(*keys, "__b", F.coalesce(F.min("__m").over(later), F.lit(1.0)).alias("__tail"))
    inner = W.partitionBy(*keys, "__b").orderBy(F.col(p).desc()).rowsBetween(W.unboundedPreceding, 0)
    q = cells.join(buckets, [*keys, "__b"]).select(
        *keys, p, F.least(F.min("__r").over(inner), F.col("__tail"), F.lit(1.0)).alias(out)
    )
    return df.join(q, [*keys, p], "left")


def bonferroni_adjust(df: DataFrame, query: str = "query", target: str = "target", p: str = "p") -> DataFrame:
    """p times (number of queries * number of targets), at most 1."""
    n = df.agg(F.count_distinct(query).alias("__a"), F.count_distinct(target).alias("__b"))
    return df.join(F.broadcast(n)).withColumn("q", F.least(F.lit(1.0), F.col(p) * F.col("__a") * F.col("__b"))).drop("__a", "__b")


def correlation_p_value(df: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """Exact two-sided p from r and n, the motif form (t with n-1 degrees, eps) and its inverse."""
    t = F.col(r) * F.sqrt(F.col(n) - 2) / F.sqrt(1 - F.pow(F.col(r) - 1e-7, F.lit(2)))
    out = df.withColumn("p_exact", SP.correlation_tail(F.col(r), F.col(n)))
    out = out.withColumn("p_motif", SP.t_two_sided(t, (F.col(n) - 1).cast("double")))
    tt = SP.t_isf(F.col("p_motif"), (F.col(n) - 1).cast("double"))
    out = out.withColumn("__t", tt)
    return out.withColumn("r_back", F.sqrt(F.col("__t") * F.col("__t") / (F.col(n) - 2 + F.col("__t") * F.col("__t")))).drop("__t")


# ------------------------------------------------------- significance counting
def count_significant(df: DataFrame, fc_cut: float, logp_cut: float) -> DataFrame:
    """Up and down counts per condition of ``(name, condition, fc, p)``."""
    sig = -F.log10("p") > logp_cut
    up, down = sig & (F.col("fc") > fc_cut), sig & (F.col("fc") < -fc_cut)
    return df.groupBy("condition").agg(
        F.count_if(up).alias("n_up"), F.count_if(down).alias("n_down"), F.count_if(up | down).alias("n_any")
    )


def significant_names(df: DataFrame, fc_cut: float, logp_cut: float) -> DataFrame:
    """Name lists as rows ``(condition, direction, name)``; no list is gathered in one row."""
    return df.filter((F.abs("fc") > fc_cut) & (-F.log10("p") > logp_cut)).select(
        "condition", F.when(F.col("fc") > 0, "up").otherwise("down").alias("direction"), "name"
    )


def conditional_overlap_counts(expr: DataFrame, transcription: DataFrame, decay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expression changes explained by transcription, decay, both or neither, and opposing changes.

    Inputs are ``(condition, name, direction)`` with direction 1 or -1.  Returns the colour
    class per name (0 none, 1 transcription, 2 decay, 3 both, 4 opposing) and the counts.
    """
    def flag(df: DataFrame, c: str) -> DataFrame:
        return df.groupBy("condition", "name").agg(F.max("direction").alias(c))

    j = flag(expr, "e").join(flag(transcription, "t"), ["condition", "name"], "full_outer")
    j = j.join(flag(decay, "d"), ["condition", "name"], "full_outer").na.fill(0, ["e", "t", "d"])
    by_t = (F.col("e") != 0) & (F.col("t") == F.col("e"))
    by_d = (F.col("e") != 0) & (F.col("d") == F.col("e"))
    opposing = (F.col("t") * F.col("d")) == -1
    kind = F.when(by_t & by_d, 3).when(by_t, 1).when(by_d, 2).when(opposing & (F.col("e") != 0), 4).otherwise(0)
    colour = j.filter("e <> 0").select("condition", "name", kind.alias("colour"))
    counts = j.groupBy("condition").agg(
        *[
            F.count_if(cond & (F.col("e") == s)).alias(f"{label}_{d}")
            for s, d in ((1, "up"), (-1, "down"))
            for label, cond in (
                ("transcription", by_t & ~by_d), ("decay", by_d & ~by_t), ("both", by_t & by_d),
                ("neither", (F.col("e") != 0) & ~by_t & ~by_d),
            )
        ],
        F.count_if(opposing & (F.col("t") == 1)).alias("opposing_t_up"),
        F.count_if(opposing & (F.col("t") == -1)).alias("opposing_t_down"),
    )
    return colour, counts


def enrichment_fisher(clusters: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """Per cluster: members of two models and both Fisher tails; input ``(model, cluster)``."""
    totals = clusters.agg(
        F.count_if(F.col("model") == model_a).alias("ta"), F.count_if(F.col("model") == model_b).alias("tb")
    )
    g = clusters.groupBy("cluster").agg(
        F.count_if(F.col("model") == model_a).alias("na"), F.count_if(F.col("model") == model_b).alias("nb")
    )
    g = g.join(F.broadcast(totals))
    t = SP.fisher_tails(F.col("na"), F.col("nb"), F.col("ta") - F.col("na"), F.col("tb") - F.col("nb"))
    return g.withColumn("t", t).select("cluster", "na", "nb", F.col("t.p_more").alias("p_more"), F.col("t.p_less").alias("p_less"))
