"""Metrics, tests and multiple-testing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.operators import joins as J
from strandframe.operators import stats as S
from strandframe.plans import views as V
from strandframe.plans.catalog import query

C = V.ctes


def sql_norm_sf(z: str) -> str:
    """Upper normal tail by the all-positive erf series (independent of the library's erfc)."""
    x = f"greatest(least(abs({z}), 12.0) / sqrt(2.0), 1e-300)"
    return (
        f"(0.5 - 0.5 * sign({z}) * (SELECT sum(2 / sqrt(pi()) * exp(k * ln(2) + (2 * k + 1) * ln({x}) - ({x}) * ({x})"
        f" - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))) FROM range(0, 300) t(k)))"
    )


def sql_t_two_sided(t: str, dof: str, points: int = 2000) -> str:
    """Two-sided t tail by Simpson's rule on the angle atan(t / sqrt(dof))."""
    top = f"atan(abs({t}) / sqrt({dof}))"
    w = f"(CASE WHEN k = 0 OR k = {points} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)"
    return (
        f"(1 - 2 * exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2)) / sqrt(pi()) * "
        f"(SELECT sum({w} * cos({top} * k / {points}) ^ ({dof} - 1)) * {top} / {points} / 3 FROM range(0, {points + 1}) t(k)))"
    )


PRED = """pred AS (SELECT a."row", a."col", a.value AS a, b.value / 100 AS b, CAST(substr(a."row", 2) AS BIGINT) AS tie
  FROM mat a JOIN matb b ON a."row" = b."row" AND a."col" = b."col")"""


def predictions(spark, sf):
    a, b = V.matrix(spark, sf), V.matrix_b(spark, sf)
    j = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), ["row", "col"])
    return j.select("row", "col", "a", (F.col("b") / 100).alias("b"), F.expr("substring(row, 2)").cast("bigint").alias("tie"))


P = (V.MAT, V.MATB, PRED)

SCORED = """scored AS (SELECT d.lang, l.quality AS label, CAST(d.n_chars AS DOUBLE) AS score FROM documents d JOIN labels l USING (doc_id))"""


def scored(spark, sf):
    d, lab = V.table(spark, sf, "documents"), V.table(spark, sf, "labels")
    return d.join(lab, "doc_id").select("lang", F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score"))


def _corr_sql(a: str, b: str) -> str:
    return f"""CASE WHEN stddev_pop({a}) = 0 AND stddev_pop({b}) = 0 THEN NULL WHEN stddev_pop({a}) = 0 OR stddev_pop({b}) = 0 THEN -1.0
  ELSE covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"""


_COS = "sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)))"


@query(
    "rank_transform",
    C(V.MAT) + """SELECT "row", "col", value, row_number() OVER (PARTITION BY "col" ORDER BY value, CAST(substr("row", 2) AS BIGINT)) - 1 AS rank FROM mat""",
)
def _(spark, sf):
    m = V.matrix(spark, sf).withColumn("tie", F.expr("substring(row, 2)").cast("bigint"))
    return S.rank_transform(m, ["col"], "value", "tie").drop("tie")


@query("correlation", C(*P) + f'SELECT "col", round(1 - ({_corr_sql("a", "b")}), 4) AS correlation FROM pred GROUP BY "col"', floats="correlation", digits=4)
def _(spark, sf):
    return S.correlation(predictions(spark, sf), ["col"])


@query("correlation_rows", C(*P) + f'SELECT "row", 1 - ({_corr_sql("a", "b")}) AS correlation FROM pred GROUP BY "row"', floats="correlation", digits=3)
def _(spark, sf):
    # four decimals as in the operator, then three so that both sides meet on exact ties
    out = predictions(spark, sf).groupBy("row").agg((1 - S.pearson_expr(F.col("a"), F.col("b"))).alias("correlation"))
    return out


@query(
    "correlation_spearman",
    C(*P, """r AS (SELECT "col", row_number() OVER (PARTITION BY "col" ORDER BY a, tie) - 1.0 AS ra, row_number() OVER (PARTITION BY "col" ORDER BY b, tie) - 1.0 AS rb FROM pred)""")
    + 'SELECT "col", round(1 - covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)), 4) AS correlation FROM r GROUP BY "col"',
    floats="correlation", digits=4,
)
def _(spark, sf):
    return S.correlation(predictions(spark, sf), ["col"], kind="spearman", tie="tie")


@query("rmse", C(*P) + 'SELECT "row", sqrt(avg((a - b) ^ 2)) AS rmse FROM pred GROUP BY "row"', floats="rmse")
def _(spark, sf):
    return S.rmse(predictions(spark, sf), ["row"])


@query("relative_error", C(*P) + 'SELECT "col", avg(abs(a - b) / CASE WHEN a = 0 THEN 1 ELSE a END) AS relative_error FROM pred GROUP BY "col"', floats="relative_error")
def _(spark, sf):
    return S.relative_error(predictions(spark, sf), ["col"])


@query(
    "distance_measures",
    C(*P)
    + f"""SELECT "col", sum(a * b) AS dot, 1 - {_COS} AS cosine, 1 - ({_corr_sql("a", "b")}) AS pearson, sum(abs(a - b)) AS absolute,
  sqrt(sum((a - b) * (a - b))) AS euclidean FROM pred GROUP BY "col\"""",
    floats="dot cosine pearson absolute euclidean", digits=4,
)
def _(spark, sf):
    return S.distance_measures(predictions(spark, sf), ["col"])


_AVG_RANK = "avg_rank"


@query(
    "auroc",
    C(SCORED, """r AS (SELECT lang, label, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM scored)""")
    + """SELECT lang, (sum(r * label) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0) AS auroc FROM r GROUP BY lang""",
    floats="auroc",
)
def _(spark, sf):
    return S.auroc(scored(spark, sf), ["lang"])


@query(
    "auprc",
    C(
        SCORED,
        "c AS (SELECT lang, score, count(*) AS n, sum(label) AS pos FROM scored GROUP BY ALL)",
        """r AS (SELECT lang, pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY lang) AS tp FROM c
  WINDOW w AS (PARTITION BY lang ORDER BY score DESC))""",
    )
    + "SELECT lang, sum(pos / nullif(tp, 0) * (cp / cn)) AS auprc FROM r GROUP BY lang",
    floats="auprc",
)
def _(spark, sf):
    return S.auprc(scored(spark, sf), ["lang"])


_TWO = """two AS (SELECT lang, sum(r * label) AS r1, sum(label) + 0.0 AS n1, count(*) - sum(label) + 0.0 AS n2, sum(t * t - 1.0) AS ties
  FROM (SELECT lang, label, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r,
        count(*) OVER (PARTITION BY lang, score) AS t FROM scored) GROUP BY lang)"""


@query(
    "rank_sum",
    C(SCORED, _TWO, "z AS (SELECT lang, (r1 - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z FROM two)",
      f"p AS (SELECT lang, z, 2 * {sql_norm_sf('abs(z)')} AS p FROM z)")
    + "SELECT lang, z, p, -log10(p) AS neglog10p FROM p",
    floats="z p neglog10p", digits=5,
)
def _(spark, sf):
    return S.rank_sum(scored(spark, sf), ["lang"], "label", "score")


@query(
    "mann_whitney",
    C(
        SCORED,
        _TWO,
        "u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM two)",
        """z AS (SELECT lang, u, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5)
  / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u)""",
    )
    + f"SELECT lang, u, z, least(1.0, 2 * {sql_norm_sf('z')}) AS p FROM z",
    floats="u z p", digits=5,
)
def _(spark, sf):
    return S.mann_whitney(scored(spark, sf), ["lang"], "label", "score")


@query(
    "wilcoxon_signed_rank",
    C(
        *P,
        'd AS (SELECT "col", a - 1.05 * b AS d FROM pred WHERE a - 1.05 * b <> 0)',
        """r AS (SELECT "col", d, rank() OVER (PARTITION BY "col" ORDER BY abs(d)) + (count(*) OVER (PARTITION BY "col", abs(d)) - 1) / 2.0 AS r,
  count(*) OVER (PARTITION BY "col", abs(d)) AS t FROM d)""",
        """s AS (SELECT "col", sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w, count(*) + 0.0 AS n, sum(t * t - 1.0) AS ties FROM r GROUP BY "col")""",
        'z AS (SELECT "col", w, (w - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM s)',
    )
    + f'SELECT "col", w, z, 2 * {sql_norm_sf("abs(z)")} AS p FROM z',
    floats="w z p", digits=5,
)
def _(spark, sf):
    p = predictions(spark, sf).withColumn("b", 1.05 * F.col("b"))
    return S.wilcoxon_signed_rank(p, ["col"])


@query(
    "distribution_divergence",
    C(
        *P,
        """n AS (SELECT "row", a, b, a / sum(a) OVER w AS p, b / sum(b) OVER w AS q, (a - min(a) OVER w) AS an, (b - min(b) OVER w) AS bn FROM pred WINDOW w AS (PARTITION BY "row"))""",
        """m AS (SELECT "row", a, b, p, q, (p + q) / 2 AS m, an / coalesce(nullif(sum(an) OVER w, 0), 1) AS pn, bn / coalesce(nullif(sum(bn) OVER w, 0), 1) AS qn FROM n WINDOW w AS (PARTITION BY "row"))""",
        """s AS (SELECT "row", sum((p * log2(p / m) + q * log2(q / m)) / 2) AS js, sum(p * log2((p + 1e-8) / (q + 1e-8))) AS kl,
  -sum(p * ln(q + 1e-8) + q * ln(p + 1e-8)) / 2 AS cross_entropy, avg((pn - qn) ^ 2) AS shape_mse, (avg(a) - avg(b)) ^ 2 AS count_mse FROM m GROUP BY "row")""",
    )
    + 'SELECT "row", js, kl, cross_entropy, shape_mse, count_mse, sqrt(greatest(js, 0) * ln(2)) AS js_distance FROM s',
    floats="js kl cross_entropy shape_mse count_mse js_distance",
)
def _(spark, sf):
    return S.distribution_divergence(predictions(spark, sf), ["row"])


@query(
    "composite_error",
    C(
        *P,
        f'r AS (SELECT "row", 1 - ({_corr_sql("a", "b")}) AS rc, 1 - {_COS} AS rcos, avg((a - b) ^ 2) AS mse FROM pred GROUP BY "row")',
        f'c AS (SELECT "col", 1 - ({_corr_sql("a", "b")}) AS cc, 1 - {_COS} AS ccos FROM pred GROUP BY "col")',
        'x AS (SELECT "row", avg(cc) AS cc, avg(ccos) AS ccos FROM pred JOIN c USING ("col") GROUP BY "row")',
    )
    + """SELECT "row", 0.5 * rc + 0.5 * mse AS correlation_mse, 0.5 * rc + 0.5 * cc AS correlation_both, 0.5 * rcos + 0.5 * ccos AS cosine_both
  FROM r JOIN x USING ("row")""",
    floats="correlation_mse correlation_both cosine_both", digits=5,
)
def _(spark, sf):
    return S.composite_error(predictions(spark, sf), 0.5)


_JSD = """n AS (SELECT substr("col", 1, 1) AS class, "col", a / sum(a) OVER w AS p, b / sum(b) OVER w AS q FROM pred WINDOW w AS (PARTITION BY "col"))"""


@query(
    "evaluate_predictions",
    C(*P, _JSD)
    + f"""SELECT substr("col", 1, 1) AS class, "col" AS track, 'mse' AS metric, sqrt(avg((a - b) ^ 2)) AS value FROM pred GROUP BY "col"
  UNION ALL SELECT substr("col", 1, 1), "col", 'correlation', round(1 - ({_corr_sql("a", "b")}), 4) FROM pred GROUP BY "col"
  UNION ALL SELECT class, "col", 'jensenshannon', sqrt(sum((p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2) * ln(2)) FROM n GROUP BY class, "col\"""",
    floats="value", digits=4,
)
def _(spark, sf):
    p = predictions(spark, sf).withColumnsRenamed({"row": "name", "col": "track"})
    classes = p.select("track").distinct().select("track", F.substring("track", 1, 1).alias("class"))
    return S.evaluate_predictions(
        p.select("name", "track", F.col("a").alias("value")), p.select("name", "track", F.col("b").alias("value")), classes,
        ["mse", "correlation", "jensenshannon"],
    )


@query(
    "evaluate_predictions_points",
    C(*P)
    + """SELECT class, metric, avg(value) AS value FROM (
  SELECT substr("col", 1, 1) AS class, "row", 'mse' AS metric, sqrt(avg((a - b) ^ 2)) AS value FROM pred GROUP BY ALL
  UNION ALL SELECT substr("col", 1, 1), "row", 'relative', avg(abs(a - b) / a) FROM pred GROUP BY ALL) GROUP BY ALL""",
    floats="value",
)
def _(spark, sf):
    p = predictions(spark, sf).withColumnsRenamed({"row": "name", "col": "track"})
    classes = p.select("track").distinct().select("track", F.substring("track", 1, 1).alias("class"))
    table = S.evaluate_predictions(
        p.select("name", "track", F.col("a").alias("value")), p.select("name", "track", F.col("b").alias("value")), classes,
        ["mse", "relative"], per="point",
    )
    return S.metric_averages(table)


@query("permutation_baseline")
def _(spark, sf):
    return S.permutation_baseline(predictions(spark, sf))


@query("permutation_test")
def _(spark, sf):
    return S.permutation_test(predictions(spark, sf))


PV = """pv AS (SELECT l_partkey AS name, l_returnflag || l_linestatus AS condition, avg(l_quantity) / 25 - 1 AS fc, 1.0 / (1 + floor(sum(l_quantity))) AS p FROM lineitem GROUP BY ALL)"""


def pvalues(spark, sf):
    """Fold change and p value per part and condition, with many ties."""
    li = V.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("name"), F.concat("l_returnflag", "l_linestatus").alias("condition")).agg(
        (F.avg("l_quantity") / 25 - 1).alias("fc"), (1.0 / (1 + F.floor(F.sum("l_quantity")))).alias("p")
    )


@query(
    "bh_adjust",
    C(
        PV,
        """r AS (SELECT *, count(*) OVER (PARTITION BY condition) AS m, rank() OVER (PARTITION BY condition ORDER BY p)
  + count(*) OVER (PARTITION BY condition, p) - 1 AS rk FROM pv)""",
    )
    + """SELECT name, condition, p, least(1.0, min(p * m / rk) OVER (PARTITION BY condition ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM r""",
    floats="p q", digits=7,
)
def _(spark, sf):
    return S.bh_adjust(pvalues(spark, sf).select("name", "condition", "p"), ["condition"])


@query(
    "bonferroni_adjust",
    C(PV) + """SELECT name AS query, condition AS target, p, least(1.0, p * (SELECT count(DISTINCT name) * count(DISTINCT condition) FROM pv)) AS q FROM pv""",
    floats="p q",
)
def _(spark, sf):
    return S.bonferroni_adjust(pvalues(spark, sf).select(F.col("name").alias("query"), F.col("condition").alias("target"), "p"))


_R = """r AS (SELECT "col", least(0.9, (count(*) % 50) / 55.0) AS r, CAST(20 + count(*) % 40 AS DOUBLE) AS n FROM mat GROUP BY "col")"""


@query(
    "correlation_p_value",
    C(V.MAT, _R)
    + f"""SELECT "col", r, n, {sql_t_two_sided("(r * sqrt((n - 2) / (1 - r * r)))", "(n - 2)")} AS p_exact,
  {sql_t_two_sided("(r * sqrt(n - 2) / sqrt(1 - (r - 1e-7) ^ 2))", "(n - 1)")} AS p_motif, r AS r_back FROM r""",
    floats="r p_exact p_motif r_back", digits=5,
)
def _(spark, sf):
    g = V.matrix(spark, sf).groupBy("col").agg(F.count(F.lit(1)).alias("c"))
    x = g.select("col", F.least(F.lit(0.9), (F.col("c") % 50) / 55.0).alias("r"), (20 + F.col("c") % 40).cast("double").alias("n"))
    return S.correlation_p_value(x)


@query(
    "count_significant",
    C(PV)
    + """SELECT condition, count(*) FILTER (WHERE -log10(p) > 1.9 AND fc > 0.1) AS n_up, count(*) FILTER (WHERE -log10(p) > 1.9 AND fc < -0.1) AS n_down,
  count(*) FILTER (WHERE -log10(p) > 1.9 AND abs(fc) > 0.1) AS n_any FROM pv GROUP BY condition""",
)
def _(spark, sf):
    return S.count_significant(pvalues(spark, sf), 0.1, 1.9)


@query(
    "significant_names",
    C(PV) + "SELECT condition, CASE WHEN fc > 0 THEN 'up' ELSE 'down' END AS direction, name FROM pv WHERE -log10(p) > 1.9 AND abs(fc) > 0.1",
)
def _(spark, sf):
    return S.significant_names(pvalues(spark, sf), 0.1, 1.9)


def _overlap_sets(spark, sf):
    """Direction of three measures per part: quantity by status, by instruction halves."""
    li = V.table(spark, sf, "lineitem").withColumn("condition", F.col("l_returnflag"))
    out = []
    for status in (None, "F", "O"):
        d = li if status is None else li.filter(F.col("l_linestatus") == status)
        g = d.groupBy("condition", F.col("l_partkey").alias("name")).agg(F.avg("l_quantity").alias("m"))
        g = g.filter(F.abs(F.col("m") - 25) > 3)
        out.append(g.select("condition", "name", F.when(F.col("m") > 25, 1).otherwise(-1).alias("direction")))
    return out


def _set_cte(name: str, where: str) -> str:
    return f"""{name} AS (SELECT l_returnflag AS condition, l_partkey AS name, CASE WHEN avg(l_quantity) > 25 THEN 1 ELSE -1 END AS v
  FROM lineitem {where} GROUP BY ALL HAVING abs(avg(l_quantity) - 25) > 3)"""


_OVER = (
    _set_cte("ex", ""),
    _set_cte("tr", "WHERE l_linestatus = 'F'"),
    _set_cte("de", "WHERE l_linestatus = 'O'"),
    """al AS (SELECT condition, name, coalesce(ex.v, 0) AS e, coalesce(tr.v, 0) AS t, coalesce(de.v, 0) AS d
  FROM ex FULL JOIN tr USING (condition, name) FULL JOIN de USING (condition, name))""",
)


@query(
    "conditional_overlap_counts",
    C(*_OVER)
    + "SELECT condition, "
    + ", ".join(
        f"count(*) FILTER (WHERE e = {s} AND {cond}) AS {label}_{d}"
        for s, d in ((1, "up"), (-1, "down"))
        for label, cond in (("transcription", "t = e AND d <> e"), ("decay", "d = e AND t <> e"), ("both", "t = e AND d = e"), ("neither", "t <> e AND d <> e"))
    )
    + ", count(*) FILTER (WHERE t = 1 AND d = -1) AS opposing_t_up, count(*) FILTER (WHERE t = -1 AND d = 1) AS opposing_t_down FROM al GROUP BY condition",
)
def _(spark, sf):
    return S.conditional_overlap_counts(*_overlap_sets(spark, sf))[1]


@query(
    "conditional_overlap_colours",
    C(*_OVER)
    + """SELECT condition, name, CASE WHEN t = e AND d = e THEN 3 WHEN t = e THEN 1 WHEN d = e THEN 2 WHEN t * d = -1 THEN 4 ELSE 0 END AS colour FROM al WHERE e <> 0""",
)
def _(spark, sf):
    return S.conditional_overlap_counts(*_overlap_sets(spark, sf))[0]


_CM = """cm AS (SELECT label AS cluster, CASE WHEN vec_id % 3 = 0 THEN 'a' ELSE 'b' END AS model FROM embeddings),
tot AS (SELECT count(*) FILTER (WHERE model = 'a') AS ta, count(*) FILTER (WHERE model = 'b') AS tb FROM cm),
g AS (SELECT cluster, count(*) FILTER (WHERE model = 'a') AS na, count(*) FILTER (WHERE model = 'b') AS nb FROM cm GROUP BY cluster)"""


def _tail(op: str) -> str:
    def lc(n, k):
        return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1))"

    n, k = "(ta + tb)", "(na + nb)"
    return (
        f"least(1.0, (SELECT sum(exp({lc('ta', 'x')} + {lc('tb', '(na + nb) - x')} - {lc(n, k)})) FROM range(greatest(0, na + nb - tb), least(ta, na + nb) + 1) t(x) WHERE x {op} na))"
    )


@query(
    "enrichment_fisher",
    C(_CM) + f"SELECT cluster, na, nb, {_tail('>=')} AS p_more, {_tail('<=')} AS p_less FROM g, tot",
    floats="p_more p_less",
)
def _(spark, sf):
    e = V.table(spark, sf, "embeddings")
    c = e.select(F.col("label").alias("cluster"), F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b").alias("model"))
    return S.enrichment_fisher(c, "a", "b")


@query(
    "best_examples",
    C(*P, f'g AS (SELECT "row" AS name, round(1 - ({_corr_sql("a", "b")}), 4) AS correlation, sqrt(avg((a - b) ^ 2)) AS rmse FROM pred GROUP BY "row" HAVING count(*) > 3)')
    + "SELECT name, 0.75 * correlation + 0.25 * rmse AS score FROM g ORDER BY score, name LIMIT 50",
    floats="score", digits=4,
)
def _(spark, sf):
    from strandframe.operators.select import best_examples

    p = predictions(spark, sf)
    many = p.groupBy("row").agg(F.count(F.lit(1)).alias("c")).filter("c > 3").select("row")
    p = p.join(many, "row", "left_semi")
    j = S.correlation(p, ["row"]).join(S.rmse(p, ["row"]), "row").withColumnRenamed("row", "name")
    return best_examples(j, 50)


# ------------------------------------------------------- matches and name joins
MATCH = """mt AS (SELECT 'q' || CAST(l_suppkey AS VARCHAR) AS query, 'T' || CAST(l_partkey AS VARCHAR) AS target, min(l_extendedprice) / 1e5 AS q FROM lineitem GROUP BY ALL)"""


def matches(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return li.groupBy(
        F.concat(F.lit("q"), F.col("l_suppkey").cast("string")).alias("query"),
        F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("target"),
    ).agg((F.min("l_extendedprice") / 1e5).alias("q"))


@query(
    "best_matches",
    C(MATCH) + "SELECT query, CASE WHEN q <= 0.012 THEN target ELSE '-1' END AS target, q, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY q, target) AS rn FROM mt) WHERE rn <= 3",
    floats="q", digits=7,
)
def _(spark, sf):
    from strandframe.operators.select import best_matches

    return best_matches(matches(spark, sf), 3, cutoff=0.012)


@query(
    "annotate_motif_matches",
    C(MATCH, "b AS (SELECT query, target, row_number() OVER (PARTITION BY query ORDER BY q, target) AS rn FROM mt WHERE q <= 0.0105 AND contains(target, '1'))",
      "l AS (SELECT query, string_agg(target, ',' ORDER BY rn) AS t FROM b WHERE rn <= 3 GROUP BY query)")
    + "SELECT query, query || '(' || coalesce(t, '*') || ')' AS label FROM (SELECT DISTINCT query FROM mt) LEFT JOIN l USING (query)",
)
def _(spark, sf):
    return J.annotate_motif_matches(matches(spark, sf), 0.0105, 3, "1")


@query(
    "match_summary",
    C(MATCH, "b AS (SELECT query, arg_min(target, {'q': q, 't': target}) AS target, min(q) AS q FROM mt GROUP BY query)")
    + """SELECT count(*) AS queries, count(*) FILTER (WHERE q <= 0.0105) AS assigned, count(DISTINCT target) AS targets,
  quantile_cont(q, 0.25) AS q25, quantile_cont(q, 0.5) AS q50, quantile_cont(q, 0.75) AS q75 FROM b""",
    floats="q25 q50 q75", digits=7,
)
def _(spark, sf):
    return J.match_summary(matches(spark, sf), 0.0105)


@query(
    "match_assignment",
    C(MATCH) + "SELECT 'q' || CAST(s_suppkey AS VARCHAR) AS name, CASE WHEN 'q' || CAST(s_suppkey AS VARCHAR) IN (SELECT query FROM mt WHERE q <= 0.0105) THEN 1 ELSE 0 END AS assigned FROM supplier",
)
def _(spark, sf):
    names = V.table(spark, sf, "supplier").select(F.concat(F.lit("q"), F.col("s_suppkey").cast("string")).alias("name"))
    return J.match_assignment(matches(spark, sf), names, 0.0105)


@query(
    "join_metric_to_matches",
    C(MATCH, """mm AS (SELECT DISTINCT 'q' || CAST(l_suppkey AS VARCHAR) AS query, 't' || CAST(l_linenumber AS VARCHAR) AS factor, l_linenumber * 1.0 AS metric FROM lineitem)""",
      """pr AS (SELECT m.query, m.target, max(metric) AS metric FROM mt m JOIN mm ON m.query = mm.query AND contains(upper(m.target), upper(mm.factor)) GROUP BY ALL)""")
    + """SELECT query, target, q, CAST(metric AS DOUBLE) AS metric, CAST(row_number() OVER (PARTITION BY query ORDER BY metric DESC, q, target) AS INTEGER) AS rank FROM mt JOIN pr USING (query, target)""",
    floats="q", digits=7,
)
def _(spark, sf):
    li = V.table(spark, sf, "lineitem")
    metric = li.select(
        F.concat(F.lit("q"), F.col("l_suppkey").cast("string")).alias("query"),
        F.concat(F.lit("t"), F.col("l_linenumber").cast("string")).alias("factor"),
        F.col("l_linenumber").cast("double").alias("metric"),
    ).distinct()
    return J.join_metric_to_matches(matches(spark, sf), metric)


@query(
    "align_by_name",
    "SELECT d.doc_id AS name, d.lang AS docs_lang, l.quality AS labels_quality FROM documents d JOIN labels l USING (doc_id)",
)
def _(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("name"), "lang")
    lab = V.table(spark, sf, "labels").select(F.col("doc_id").alias("name"), "quality")
    return J.align_by_name({"docs": d, "labels": lab})


@query(
    "read_matrices_aligned",
    C(V.MAT, V.MATB, """a AS (SELECT 'x' AS modality, * FROM mat)""", """b AS (SELECT 'y' AS modality, * FROM matb)""",
      'rw AS (SELECT "row" FROM a INTERSECT SELECT "row" FROM b)')
    + 'SELECT * FROM a WHERE "row" IN (SELECT "row" FROM rw) UNION ALL SELECT * FROM b WHERE "row" IN (SELECT "row" FROM rw)',
)
def _(spark, sf):
    return J.align_matrices({"x": V.matrix(spark, sf), "y": V.matrix_b(spark, sf)})


@query(
    "stack_matrices",
    C(V.MAT, V.MATB, """a AS (SELECT 'x' AS modality, * FROM mat)""")
    + """SELECT * FROM a UNION ALL SELECT 'y', * FROM matb WHERE "row" NOT IN (SELECT "row" FROM a)""",
)
def _(spark, sf):
    return J.align_matrices({"x": V.matrix(spark, sf), "y": V.matrix_b(spark, sf)}, axis=0)


@query(
    "read_xy_dataset",
    C(V.SEQ)
    + """SELECT name, 'F0' AS channel, w AS feature, count(*) AS value FROM (SELECT name, substr(seq, i, 3) AS w FROM (SELECT name, seq, unnest(range(1, length(seq) - 1)) AS i FROM seqs WHERE length(seq) >= 3))
  WHERE name IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) GROUP BY ALL""",
)
def _(spark, sf):
    from strandframe.operators.kmers import kmer_count_regular

    x = kmer_count_regular(V.sequences(spark, sf), 3).select("name", F.col("kmer").alias("feature"), F.col("cnt").alias("value"))
    y = V.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("name"), F.lit("quality").alias("col"), F.col("quality").cast("double").alias("value"))
    return J.xy_dataset([x], {"labels": y})[0]


@query(
    "substring_membership",
    """SELECT p_partkey, p_name AS name FROM part WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT upper(split_part(p_name, ' ', 2)) AS w FROM part) WHERE contains(upper(p_name), w) OR contains(w, upper(p_name)))""",
)
def _(spark, sf):
    p = V.table(spark, sf, "part")
    words = p.select(F.substring_index("p_name", " ", -1).alias("w"))
    return J.substring_membership(p.select("p_partkey", F.col("p_name").alias("name")), words)


def _gram_cte(name: str, src: str) -> str:
    pieces = " UNION ALL ".join(
        f"SELECT name, w, substr(part, unnest(range(1, length(part) - {n} + 2)), {n}) AS gram FROM {name}_p WHERE length(part) >= {n}" for n in (2, 3, 4)
    )
    return f"""{name}_s AS (SELECT name, string_split(regexp_replace(upper(name), '[_-]', '.', 'g'), '.') AS p FROM ({src})),
{name}_p AS (SELECT name, p[i] AS part, CASE WHEN i - 1 < 2 OR len(p) - (i - 1) <= 2 THEN 2 ELSE 1 END AS w FROM (SELECT name, p, unnest(range(1, len(p) + 1)) AS i FROM {name}_s)),
{name} AS (SELECT name, gram, CAST(sum(w) AS BIGINT) AS cnt FROM ({pieces}) GROUP BY ALL)"""


_LEFT = "SELECT DISTINCT p_name || '_' || p_type AS name FROM part"
_RIGHT = "SELECT DISTINCT p_type || '-' || p_name AS name FROM part"


def _name_sets(spark, sf):
    p = V.table(spark, sf, "part")
    return p.select(F.concat_ws("_", "p_name", "p_type").alias("name")), p.select(F.concat_ws("-", "p_type", "p_name").alias("name"))


_SIM = (
    _gram_cte("ga", _LEFT),
    _gram_cte("gb", _RIGHT),
    "sh AS (SELECT ga.name AS a, gb.name AS b, sum(least(ga.cnt, gb.cnt)) AS s FROM ga JOIN gb USING (gram) GROUP BY ALL)",
    """sim AS (SELECT a, b, s / (ta + tb - s) AS similarity FROM sh JOIN (SELECT name AS a, sum(cnt) AS ta FROM ga GROUP BY name) USING (a)
  JOIN (SELECT name AS b, sum(cnt) AS tb FROM gb GROUP BY name) USING (b))""",
)


@query("string_similarity_join", C(*_SIM) + "SELECT * FROM sim WHERE similarity >= 0.4", floats="similarity")
def _(spark, sf):
    return J.string_similarity_join(*_name_sets(spark, sf), min_similarity=0.4)


@query(
    "most_unique_substring",
    C(_gram_cte("ga", _LEFT), """w AS (SELECT name, gram, (SELECT count(*) FROM (SELECT DISTINCT name FROM ga)) * cnt - sum(cnt) OVER (PARTITION BY gram) AS wt FROM ga)""")
    + "SELECT name, gram FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY wt DESC, length(gram) DESC, gram) AS rn FROM w) WHERE rn = 1",
)
def _(spark, sf):
    return J.most_unique_substring(_name_sets(spark, sf)[0])


@query("match_unique_greedy")
def _(spark, sf):
    return J.match_names(*_name_sets(spark, sf))


_SL = """sl AS (SELECT CAST(label AS VARCHAR) AS cluster, CAST(vec_id % 40 AS VARCHAR) AS seq, 's' || CAST(vec_id AS VARCHAR) AS seqlet,
  CAST(floor(embedding[1] * 1000) AS DOUBLE) AS effect, (vec_id % 7)::INT AS s, vec_id % 2 AS model FROM embeddings)"""


@query(
    "match_seqlets_across_models",
    C(
        _SL,
        """pr AS (SELECT a.cluster, a.seq, a.seqlet AS seqlet_a, a.effect AS effect_a, b.seqlet AS seqlet_b, b.effect AS effect_b,
  row_number() OVER (PARTITION BY a.cluster, a.seq, a.seqlet ORDER BY b.seqlet) AS rn FROM sl a JOIN sl b ON a.cluster = b.cluster AND a.seq = b.seq AND a.model = 0 AND b.model = 1 AND abs(a.s - b.s) <= 3)""",
        "m AS (SELECT * FROM pr WHERE rn = 1)",
    )
    + """SELECT cluster, seq, seqlet_a, seqlet_b, effect_a, effect_b FROM m
  UNION ALL SELECT cluster, seq, seqlet, NULL, effect, 0.0 FROM sl WHERE model = 0 AND seqlet NOT IN (SELECT seqlet_a FROM m)
  UNION ALL SELECT cluster, seq, NULL, seqlet, 0.0, effect FROM sl WHERE model = 1 AND seqlet NOT IN (SELECT seqlet_b FROM m)""",
)
def _(spark, sf):
    e = V.table(spark, sf, "embeddings")
    s = (F.col("vec_id") % 7).cast("int")
    sl = e.select(
        F.col("label").cast("string").alias("cluster"), (F.col("vec_id") % 40).cast("string").alias("seq"),
        F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("seqlet"),
        F.floor(F.element_at("embedding", 1).cast("float") * F.lit(1000).cast("float")).cast("double").alias("effect"),
        F.sequence(s, s + 3).alias("positions"), (F.col("vec_id") % 2).alias("model"),
    )
    return J.match_seqlets_across_models(sl.filter("model = 0"), sl.filter("model = 1"))
