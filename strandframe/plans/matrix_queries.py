"""Matrix summaries, normalisation, selection and set queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from strandframe.functions import values as VF
from strandframe.operators import matrix as M
from strandframe.operators import select as S
from strandframe.plans import views as V
from strandframe.plans.catalog import query

C = V.ctes

_TRACK_CLASS = """cls AS (SELECT DISTINCT "col", substr("col", 1, 1) AS class FROM mat)"""


def _classes(spark, sf):
    m = V.matrix(spark, sf)
    return m.select("col").distinct().select("col", F.substring("col", 1, 1).alias("class"))


def _stats_sql(axis: str) -> str:
    other = f'"{axis}"'
    return C(
        V.MAT,
        f"""r AS (SELECT {other}, value, row_number() OVER (PARTITION BY {other} ORDER BY value) AS i,
  count(*) OVER (PARTITION BY {other}) AS n, min(value) OVER (PARTITION BY {other}) AS lo,
  avg(value) OVER (PARTITION BY {other}) AS mu FROM mat)""",
    ) + f"""SELECT {other}, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std,
  CASE WHEN stddev_pop(value) > 0 THEN avg((value - mu) ^ 3) / (avg((value - mu) ^ 2) ^ 1.5) END AS skew,
  quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
  quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95,
  sum((2 * i - n - 1) * value) / (max(n) * (sum(value) - max(n) * min(lo) + max(n) * 1e-16)) AS gini,
  quantile_cont(value, 0.95) - quantile_cont(value, 0.05) AS spread, stddev_pop(value) / avg(value) AS cv FROM r GROUP BY {other}"""


_STAT_COLS = "mean std skew p5 p10 p25 p50 p75 p90 p95 gini spread cv"


@query("matrix_stats", _stats_sql("row"), floats=_STAT_COLS)
def _(spark, sf):
    out = M.matrix_stats(V.matrix(spark, sf), "row")
    return out.withColumn("skew", F.when(F.col("std") > 0, F.col("skew")))


@query("matrix_stats_columns", _stats_sql("col"), floats=_STAT_COLS)
def _(spark, sf):
    return M.matrix_stats(V.matrix(spark, sf), "col")


@query(
    "gini",
    C(V.MAT, """r AS (SELECT "col", value, row_number() OVER (PARTITION BY "col" ORDER BY value) AS i,
  count(*) OVER (PARTITION BY "col") AS n FROM mat)""")
    + 'SELECT "col", sum((2 * i - n - 1) * value) / (max(n) * (sum(value) - max(n) * min(value) + max(n) * 1e-16)) AS gini FROM r GROUP BY "col"',
    floats="gini",
)
def _(spark, sf):
    return M.gini(V.matrix(spark, sf), ["col"])


_GROUP = """regexp_replace("col", '_[^_]*$', '')"""


@query(
    "replicate_mean",
    C(V.MATREP) + f'SELECT "row", {_GROUP} AS "col", avg(value) AS value FROM matrep GROUP BY ALL',
    floats="value",
)
def _(spark, sf):
    return M.replicate_mean(V.matrix_replicates(spark, sf))


@query(
    "replicate_geomean",
    C(V.MATREP) + f'SELECT "row", {_GROUP} AS "col", exp(avg(ln(value))) AS value FROM matrep GROUP BY ALL',
    floats="value",
)
def _(spark, sf):
    return M.replicate_mean(V.matrix_replicates(spark, sf), geometric=True)


@query(
    "combine_runs",
    C(V.MAT, """runs AS (SELECT "col" AS run, "row" AS name, value FROM mat)""")
    + "SELECT name, min(value) AS value FROM runs GROUP BY name HAVING count(DISTINCT run) = (SELECT count(DISTINCT run) FROM runs)",
)
def _(spark, sf):
    runs = V.matrix(spark, sf).select(F.col("col").alias("run"), F.col("row").alias("name"), "value")
    return M.combine_runs(runs, runs.select("run").distinct().count(), "min")


_DOTTED = """dot AS (SELECT "row", replace("col", '_', '.') AS "col", value - 40 AS value FROM matrep)"""


def _dotted(spark, sf):
    m = V.matrix_replicates(spark, sf)
    return m.select("row", F.regexp_replace("col", "_", ".").alias("col"), (F.col("value") - 40).alias("value"))


@query(
    "summarize_by_datatype",
    C(
        V.MATREP,
        _DOTTED,
        """p AS (SELECT "row", split_part("col", '.', 2) AS datatype, avg(value) AS mean, stddev_pop(value) AS sd,
  CASE WHEN max(value) >= -min(value) THEN max(value) ELSE min(value) END AS maxabs FROM dot GROUP BY ALL)""",
    )
    + """SELECT "row", datatype, mean, sd / nullif(mean, 0) AS cv, maxabs,
  mean / max(abs(mean)) OVER (PARTITION BY datatype) AS mean_scaled,
  maxabs / max(abs(maxabs)) OVER (PARTITION BY datatype) AS maxabs_scaled FROM p""",
    floats="mean cv mean_scaled maxabs_scaled",
)
def _(spark, sf):
    return M.summarize_by_datatype(_dotted(spark, sf))


@query(
    "class_mean_tracks",
    C(V.MAT, _TRACK_CLASS) + 'SELECT "row", class AS "col", avg(value) AS value FROM mat JOIN cls USING ("col") GROUP BY ALL',
    floats="value",
)
def _(spark, sf):
    return M.class_mean_tracks(V.matrix(spark, sf), _classes(spark, sf))


@query(
    "lookup_classes",
    C(V.MAT, _TRACK_CLASS) + 'SELECT "row", "col", value, class FROM mat LEFT JOIN cls USING ("col")',
)
def _(spark, sf):
    from strandframe.operators.joins import lookup_classes

    return lookup_classes(V.matrix(spark, sf), _classes(spark, sf))


@query(
    "run_table",
    C(V.MAT)
    + 'SELECT "col" AS model, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.5) AS median FROM mat GROUP BY "col"',
    floats="mean std median",
)
def _(spark, sf):
    return M.run_table(V.matrix(spark, sf).select(F.col("col").alias("model"), "value"), "median")


@query(
    "histogram",
    C(V.MAT, """b AS (SELECT "col", CAST(least(floor(value / 20), 19) AS INTEGER) AS bin FROM mat WHERE value BETWEEN 0 AND 400)""",
      'c AS (SELECT "col", bin, count(*) AS cnt FROM b GROUP BY ALL)')
    + 'SELECT "col", bin, cnt, sum(cnt) OVER (PARTITION BY "col" ORDER BY bin) / sum(cnt) OVER (PARTITION BY "col") AS cumulative FROM c',
    floats="cumulative",
)
def _(spark, sf):
    return M.histogram(V.matrix(spark, sf), "value", 0.0, 400.0, 20, ["col"])


@query(
    "binned_quantiles",
    """SELECT CAST(least(floor(l_quantity / 5), 9) AS INTEGER) AS bin, min(l_extendedprice) AS lo, quantile_cont(l_extendedprice, 0.25) AS q1,
  quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3, max(l_extendedprice) AS hi, count(*) AS cnt
  FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY ALL""",
    floats="lo q1 median q3 hi", digits=4,
)
def _(spark, sf):
    return M.binned_quantiles(V.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 0.0, 50.0, 10)


@query(
    "sliding_density",
    C(
        "v AS (SELECT l_quantity AS x, count(*) AS n FROM lineitem GROUP BY ALL)",
        "g AS (SELECT m, d, d * (m + 1) * 4.0 / 4 AS move FROM (SELECT unnest([0, 1, 2]) AS m), (SELECT unnest([-1, 1]) AS d))",
        "p AS (SELECT x, n, m, d, CAST(floor((x - move) / 4.0) AS INTEGER) AS bin FROM v, g)",
        "q AS (SELECT * FROM p WHERE bin >= 0 AND bin < 13)",
        "c AS (SELECT m, d, bin, sum(n) AS cnt FROM q GROUP BY ALL)",
        "s AS (SELECT m, d, bin, cnt / max(cnt) OVER (PARTITION BY m, d) AS dens FROM c)",
    )
    + "SELECT x, avg(dens) AS density FROM q JOIN s USING (m, d, bin) GROUP BY x",
    floats="density",
)
def _(spark, sf):
    return M.sliding_density(V.table(spark, sf, "lineitem"), "l_quantity", 0.0, 52.0, 13, 3)


_LEN = """len AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS "row", p_size * 100 AS length FROM part)"""


def _lengths(spark, sf):
    return V.table(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("row"), (F.col("p_size") * 100).alias("length")
    )


@query(
    "tpm",
    C(V.MAT, _LEN, 'r AS (SELECT "row", "col", value / length * 1e3 AS value FROM mat JOIN len USING ("row"))')
    + 'SELECT "row", "col", value / (sum(value) OVER (PARTITION BY "col") / 1e6) AS value FROM r',
    floats="value", digits=4,
)
def _(spark, sf):
    return M.tpm(V.matrix(spark, sf), _lengths(spark, sf))


@query(
    "median_ratio_normalize",
    C(
        V.MAT,
        'g AS (SELECT "row", exp(avg(ln(value + 1))) AS geo FROM mat GROUP BY "row")',
        'f AS (SELECT "col", quantile_cont((value + 1) / geo, 0.5) AS sf FROM mat JOIN g USING ("row") GROUP BY "col")',
    )
    + 'SELECT "row", "col", (value + 1) / sf AS value FROM mat JOIN f USING ("col")',
    floats="value",
)
def _(spark, sf):
    return M.median_ratio_normalize(V.matrix(spark, sf), 1.0)


_QN = """rk AS (SELECT "row", "col", value, row_number() OVER (PARTITION BY "col" ORDER BY value, CAST(substr("row", 2) AS BIGINT)) AS r FROM mat),
prof AS (SELECT r, avg(value) AS m FROM rk GROUP BY r)"""


def _tied(spark, sf):
    return V.matrix(spark, sf).withColumn("tie", F.expr("substring(row, 2)").cast("bigint"))


@query("quantile_normalize", C(V.MAT, _QN) + 'SELECT "row", "col", m AS value FROM rk JOIN prof USING (r)', floats="value")
def _(spark, sf):
    return M.quantile_normalize(_tied(spark, sf), "tie")


@query(
    "transform_chain",
    C(V.MATREP, f'm AS (SELECT "row", {_GROUP} AS "col", avg(value) AS value FROM matrep GROUP BY ALL)')
    + 'SELECT "row", "col", log2(value + 1 - 20 + (CASE WHEN value + 1 - 20 <= 0 THEN 1e-8 - (value + 1 - 20) ELSE 0 END)) AS value FROM m',
    floats="value",
)
def _(spark, sf):
    return M.transform_chain(V.matrix_replicates(spark, sf), ["mean", "add=1", "add=-20", "log2"])


@query(
    "log_ratio",
    C(V.MAT, V.MATB)
    + 'SELECT "row", "col", CASE WHEN b.value = 0 OR a.value <= 0 THEN NULL ELSE log2(b.value) - log2(a.value) END AS value FROM mat a JOIN matb b USING ("row", "col")',
    floats="value",
)
def _(spark, sf):
    return M.log_ratio(V.matrix_b(spark, sf), V.matrix(spark, sf))


_DESIGN = """des AS (SELECT DISTINCT "col", regexp_replace("col", '_[^_]*$', '') AS condition,
  CASE WHEN CAST(split_part("col", '_', 2) AS INT) <= 3 THEN 'b1' ELSE 'b2' END AS batch FROM matrep)"""


def _design(spark, sf):
    cols = V.matrix_replicates(spark, sf).select("col").distinct()
    return cols.select(
        "col",
        F.regexp_replace("col", "_[^_]*$", "").alias("condition"),
        F.when(F.substring_index("col", "_", -1).cast("int") <= 3, "b1").otherwise("b2").alias("batch"),
    )


@query(
    "fold_change",
    C(V.MATREP, _DESIGN, 'cm AS (SELECT "row", condition, avg(log2(value + 1)) AS m FROM matrep JOIN des USING ("col") GROUP BY ALL)')
    + """SELECT a."row", a.condition, a.m - b.m AS log2fc FROM cm a JOIN cm b ON a."row" = b."row" AND b.condition = 'NO' WHERE a.condition <> 'NO'""",
    floats="log2fc",
)
def _(spark, sf):
    return M.fold_change(V.matrix_replicates(spark, sf), _design(spark, sf).select("col", "condition"), "NO")


@query(
    "fold_change_vs_mean",
    C(V.MATREP, _DESIGN, 'cm AS (SELECT "row", condition, avg(log2(value + 1)) AS m FROM matrep JOIN des USING ("col") GROUP BY ALL)')
    + 'SELECT "row", condition, m - avg(m) OVER (PARTITION BY "row") AS log2fc FROM cm',
    floats="log2fc",
)
def _(spark, sf):
    return M.fold_change(V.matrix_replicates(spark, sf), _design(spark, sf).select("col", "condition"))


@query(
    "remove_batch_effect",
    C(
        V.MATREP,
        _DESIGN,
        'j AS (SELECT "row", "col", batch, value FROM matrep JOIN des USING ("col"))',
        'b AS (SELECT "row", batch, avg(value) AS bm FROM j GROUP BY ALL)',
        'o AS (SELECT "row", avg(bm) AS om FROM b GROUP BY ALL)',
    )
    + 'SELECT "row", "col", value - bm + om AS value FROM j JOIN b USING ("row", batch) JOIN o USING ("row")',
    floats="value",
)
def _(spark, sf):
    return M.remove_batch_effect(V.matrix_replicates(spark, sf), _design(spark, sf).select("col", "batch"))


@query(
    "zero_row_alignment",
    C(
        V.MAT,
        """a AS (SELECT "row", "col", value FROM mat WHERE "col" <> 'NO')""",
        """b AS (SELECT "row", "col", value - 60 AS value FROM mat WHERE "col" <> 'AF')""",
        'j AS (SELECT "row", "col", coalesce(a.value, 0) AS a, coalesce(b.value, 0) AS b FROM a FULL JOIN b USING ("row", "col"))',
    )
    + 'SELECT * FROM j WHERE "row" IN (SELECT "row" FROM j GROUP BY "row" HAVING sum(abs(a) + abs(b)) > 0)',
)
def _(spark, sf):
    m = V.matrix(spark, sf)
    return M.zero_row_alignment(
        m.filter(F.col("col") != "NO"), m.filter(F.col("col") != "AF").withColumn("value", F.col("value") - 60)
    )


for _how, _sql in {
    "center_feature": 'value - avg(value) OVER (PARTITION BY "col")',
    "center_data": 'value - avg(value) OVER (PARTITION BY "row")',
    "norm1_feature": 'value / sum(abs(value)) OVER (PARTITION BY "col")',
    "norm2_data": 'value / sqrt(sum(value * value) OVER (PARTITION BY "row"))',
}.items():

    @query(f"normalize_matrix_{_how}", C(V.MAT) + f'SELECT "row", "col", {_sql} AS value FROM mat', floats="value")
    def _(spark, sf, how=_how):
        return M.normalize_matrix(V.matrix(spark, sf), how)


@query("normalize_matrix", C(V.MAT) + 'SELECT "row", "col", value / sqrt(sum(value * value) OVER (PARTITION BY "col")) AS value FROM mat', floats="value")
def _(spark, sf):
    return M.normalize_matrix(V.matrix(spark, sf), "norm2_feature")


@query("undo_norm", C(V.MAT) + 'SELECT "row", "col", value FROM mat', floats="value")
def _(spark, sf):
    m = V.matrix(spark, sf)
    return M.undo_norm(M.normalize_matrix(m, "norm2_feature"), M.column_norms(m))


@query(
    "standardize_features",
    C(V.MAT) + 'SELECT "row", "col", (value - avg(value) OVER w) / stddev_pop(value) OVER w AS value FROM mat WINDOW w AS (PARTITION BY "col")',
    floats="value",
)
def _(spark, sf):
    return M.standardize_features(V.matrix(spark, sf))


@query(
    "pairwise_products",
    C(V.MAT)
    + """SELECT "row", "col", value FROM mat UNION ALL
  SELECT a."row", a."col" || '*' || b."col", a.value * b.value FROM mat a JOIN mat b ON a."row" = b."row" AND a."col" < b."col\"""",
)
def _(spark, sf):
    return M.pairwise_products(V.matrix(spark, sf))


@query(
    "transform_values",
    C(V.MAT) + 'SELECT "row", "col", greatest(least(log10(1 - (1 - value) + 1), 2), -2) AS value FROM mat',
    floats="value",
)
def _(spark, sf):
    return M.transform_values(V.matrix(spark, sf), ["flip", "flip", "log10p1", "clip=2", "nan=0"])


_REFMAX = """ref AS (SELECT "row" AS name, max(value) AS r FROM mat GROUP BY "row")"""


@query(
    "rescale_by_reference",
    C(V.MAT, V.MATB, _REFMAX, """v AS (SELECT "row" AS name, avg(value) AS value FROM matb GROUP BY "row")""")
    + "SELECT name, least(value / r, 50.0) AS value FROM v JOIN ref USING (name) WHERE r >= 120",
    floats="value",
)
def _(spark, sf):
    v = V.matrix_b(spark, sf).groupBy(F.col("row").alias("name")).agg(F.avg("value").alias("value"))
    ref = V.matrix(spark, sf).groupBy(F.col("row").alias("name")).agg(F.max("value").alias("value"))
    return M.rescale_by_reference(v, ref, 120.0, 50.0)


@query(
    "similarity_to_distance",
    C(V.MAT, 'l AS (SELECT min(value) AS lo, max(value) AS hi FROM mat)')
    + 'SELECT "row", "col", value, 1 - (value - lo) / (hi - lo) AS distance FROM mat, l',
    floats="distance",
)
def _(spark, sf):
    return M.similarity_to_distance(V.matrix(spark, sf))


# ------------------------------------------------------------------ selection
_IDX = """idx AS (SELECT "col", row_number() OVER (ORDER BY "col") - 1 AS idx FROM (SELECT DISTINCT "col" FROM matrep))"""


def _indexed(spark, sf):
    from pyspark.sql import Window as W

    m = V.matrix_replicates(spark, sf)
    idx = m.select("col").distinct().withColumn("idx", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("col")) - 1)
    return m.join(F.broadcast(idx), "col")


@query(
    "select_by_spec",
    C(V.MATREP, _IDX) + 'SELECT "row", "col", value FROM matrep JOIN idx USING ("col") WHERE idx BETWEEN 3 AND 11',
)
def _(spark, sf):
    return S.select_by_spec(_indexed(spark, sf), "3-to-11").drop("idx")


@query("select_by_spec_substring", C(V.MATREP) + """SELECT "row", "col", value FROM matrep WHERE contains("col", 'F_')""")
def _(spark, sf):
    return S.select_by_spec(_indexed(spark, sf), "musthave=F_").drop("idx")


_NAMES = """names AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS name FROM part WHERE p_brand = 'Brand#2' OR p_brand = 'Brand#4')"""


def _names(spark, sf):
    return (
        V.table(spark, sf, "part")
        .filter(F.col("p_brand").isin("Brand#2", "Brand#4"))
        .select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"))
    )


@query("filter_by_name_list", C(V.MAT, _NAMES) + 'SELECT * FROM mat WHERE "row" IN (SELECT name FROM names)')
def _(spark, sf):
    return S.filter_by_name_list(V.matrix(spark, sf), _names(spark, sf), "row")


@query("select_features", C(V.MAT) + """SELECT * FROM mat WHERE "col" IN (SELECT "col" FROM mat GROUP BY "col" HAVING avg(value) > 100)""")
def _(spark, sf):
    m = V.matrix(spark, sf)
    keep = m.groupBy("col").agg(F.avg("value").alias("a")).filter("a > 100").select("col")
    return S.select_features(m, keep)


@query("select_by_threshold", C(V.MAT) + 'SELECT "row" AS name FROM mat GROUP BY "row" HAVING bool_and(value > 60)')
def _(spark, sf):
    return S.select_by_threshold(V.matrix(spark, sf).select(F.col("row").alias("name"), F.col("col").alias("matrix"), "value"), 60.0, "gt", "all")


@query("select_by_threshold_any", C(V.MAT) + 'SELECT "row" AS name FROM mat GROUP BY "row" HAVING bool_or(value <= 20)')
def _(spark, sf):
    return S.select_by_threshold(V.matrix(spark, sf).select(F.col("row").alias("name"), F.col("col").alias("matrix"), "value"), 20.0, "leq", "any")


_FLAT = """flat AS (SELECT "row", "col", CASE WHEN CAST(substr("row", 2) AS BIGINT) % 4 = 0 THEN 0.0 WHEN CAST(substr("row", 2) AS BIGINT) % 4 = 1 THEN 1.0 ELSE value END AS value FROM mat)"""


def _flat(spark, sf):
    m = V.matrix(spark, sf)
    k = F.expr("substring(row, 2)").cast("bigint") % 4
    return m.withColumn("value", F.when(k == 0, 0.0).when(k == 1, 1.0).otherwise(F.col("value")))


@query("drop_constant_rows", C(V.MAT, _FLAT) + 'SELECT * FROM flat WHERE "row" IN (SELECT "row" FROM flat GROUP BY "row" HAVING max(value) > min(value))')
def _(spark, sf):
    return S.drop_constant_rows(_flat(spark, sf), "constant")


@query("drop_zero_rows", C(V.MAT, _FLAT) + 'SELECT * FROM flat WHERE "row" IN (SELECT "row" FROM flat GROUP BY "row" HAVING bool_or(value <> 0))')
def _(spark, sf):
    return S.drop_constant_rows(_flat(spark, sf), "zero")


@query("jitter_constant_rows", C(V.MAT, _FLAT) + 'SELECT "row", "col", round(value, 3) AS value FROM flat')
def _(spark, sf):
    return S.jitter_constant_rows(_flat(spark, sf)).withColumn("value", F.round("value", 3))


@query("filter_columns_by_group", C(V.MATREP) + """SELECT * FROM matrep WHERE split_part("col", '_', 2) = '3'""")
def _(spark, sf):
    return S.filter_columns_by_group(V.matrix_replicates(spark, sf), "3", part=1)


@query(
    "split_matrix_by_suffix",
    C(V.MATREP, _DOTTED) + """SELECT "row", split_part("col", '.', 1) AS "col", split_part("col", '.', 2) AS datatype, value FROM dot""",
)
def _(spark, sf):
    return S.split_matrix_by_suffix(_dotted(spark, sf))


@query("subsample")
def _(spark, sf):
    return S.subsample_fraction(V.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 0.25, 7)


@query("subsample_n")
def _(spark, sf):
    return S.subsample_n(V.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 50, 7)


@query(
    "filter_top_by_maxabs",
    C(V.MAT) + 'SELECT * FROM mat WHERE "row" IN (SELECT "row" FROM mat GROUP BY "row" ORDER BY max(abs(value)) DESC, "row" LIMIT 100)',
)
def _(spark, sf):
    return S.filter_top_by_maxabs(V.matrix(spark, sf), 100)


@query(
    "filter_annotation",
    """SELECT p_partkey, p_brand AS chrom, p_type AS feature FROM part WHERE p_type = 'ECONOMY'
  AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4') AND p_brand NOT IN ('Brand#3')""",
)
def _(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("chrom"), F.col("p_type").alias("feature"))
    return S.filter_annotation(p, feature="ECONOMY", chroms="Brand#.1-4", exclude=["Brand#3"])


@query(
    "strip_id_version",
    """SELECT event_id, split_part(CAST(user_id AS VARCHAR) || '.' || CAST(event_id AS VARCHAR), '.', 1) AS gene_id FROM events""",
)
def _(spark, sf):
    e = V.table(spark, sf, "events")
    return S.strip_id_version(e.select("event_id", F.concat_ws(".", "user_id", "event_id").alias("gene_id")), "gene_id")


@query("filter_alignments", C(V.READS) + "SELECT * FROM reads WHERE mapq >= 30 AND (flag & 4) = 0 AND contig <> 'error'")
def _(spark, sf):
    return S.filter_alignments(V.reads(spark, sf), 30, ("error",))


@query("combine_lists", "SELECT n_name AS name FROM nation INTERSECT SELECT 'NATION_' || CAST(c_nationkey AS VARCHAR) FROM customer")
def _(spark, sf):
    c = V.table(spark, sf, "customer")
    return S.combine_lists(
        [V.table(spark, sf, "nation").select("n_name"), c.select(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))], "intersect"
    )


@query("combine_lists_union", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT s_name FROM supplier")
def _(spark, sf):
    return S.combine_lists([V.table(spark, sf, t).select(c) for t, c in (("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name"))])


@query(
    "common_and_difference",
    """SELECT coalesce(a.k, b.k) AS name, CASE WHEN a.k IS NULL THEN 'b' WHEN b.k IS NULL THEN 'a' ELSE 'both' END AS side
  FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN
  (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') b ON a.k = b.k""",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    return S.common_and_difference(*[o.filter(F.col("o_orderstatus") == s).select("o_custkey") for s in ("F", "P")])


@query(
    "union_with_prefix",
    "SELECT 'docs_' || CAST(doc_id AS VARCHAR) AS name, text FROM documents UNION ALL SELECT 'bench_' || CAST(item_id AS VARCHAR), text FROM benchmark",
)
def _(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), "text")
    b = V.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("name"), "text")
    return S.union_with_prefix({"docs": d, "bench": b})


@query(
    "split_by_model",
    "SELECT CAST(label AS VARCHAR) AS model, 'seq_' || CAST(vec_id AS VARCHAR) AS name FROM embeddings",
)
def _(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return S.split_by_model(e.select(F.concat_ws("_", F.col("label").cast("string"), F.lit("seq"), F.col("vec_id").cast("string")).alias("name")))


@query(
    "unique_column_names",
    """SELECT p_partkey AS idx, CASE WHEN rn = 1 THEN p_name ELSE p_name || '_' || CAST(rn - 1 AS VARCHAR) END AS "col"
  FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)""",
)
def _(spark, sf):
    return S.unique_column_names(V.table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("col")))


@query(
    "top_features",
    C(
        V.MATREP,
        """x AS (SELECT split_part("col", '_', 1) AS track, "row" AS feature, sum(value) - 60 AS value FROM matrep GROUP BY ALL)""",
        """r AS (SELECT *, CASE WHEN value = 0 THEN 2147483647 ELSE rank() OVER (PARTITION BY track ORDER BY abs(value) DESC) END AS r FROM x)""",
        "p AS (SELECT feature, avg(abs(value)) AS mean_abs, max(abs(value)) AS max_abs, CAST(min(r) AS INTEGER) AS best_rank FROM r GROUP BY feature)",
        """pick AS ((SELECT feature FROM p ORDER BY mean_abs DESC, feature LIMIT 20) UNION (SELECT feature FROM p ORDER BY max_abs DESC, feature LIMIT 20)
  UNION (SELECT feature FROM p ORDER BY best_rank, feature LIMIT 20))""",
    )
    + "SELECT * FROM p WHERE feature IN (SELECT feature FROM pick)",
    floats="mean_abs",
)
def _(spark, sf):
    m = V.matrix_replicates(spark, sf)
    coef = m.groupBy(F.substring_index("col", "_", 1).alias("track"), F.col("row").alias("feature")).agg(
        (F.sum("value") - 60).alias("value")
    )
    return S.top_features(coef, 20).withColumn("best_rank", F.col("best_rank").cast("int"))


@query(
    "reorder_to",
    """SELECT CAST(doc_id AS VARCHAR) AS name, CAST(doc_id + 10 AS BIGINT) AS idx, n_chars FROM documents""",
)
def _(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), "n_chars", "doc_id")
    return S.reorder_to(d.select("name", "n_chars"), d.select("name", (F.col("doc_id") + 10).alias("idx")))


@query("read_counts_pivot", C(V.MAT, """p AS (PIVOT mat ON "col" IN ('AF', 'NO', 'RF') USING sum(value) GROUP BY "row")""") + "SELECT * FROM p")
def _(spark, sf):
    from strandframe.sources.sinks import wide_matrix

    return wide_matrix(V.matrix(spark, sf), ["AF", "NO", "RF"])


@query(
    "parse_value",
    """SELECT event_id, raw, CASE WHEN raw IN ('True', 'False') THEN 'bool' WHEN raw = 'None' THEN 'none'
  WHEN regexp_full_match(raw, '[+-]?[0-9]+') THEN 'int' WHEN try_cast(raw AS DOUBLE) IS NOT NULL THEN 'float'
  WHEN contains(raw, ',') OR regexp_full_match(raw, '\\[.*\\]') THEN 'list' ELSE 'string' END AS kind,
  try_cast(raw AS DOUBLE) AS number FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR)
  WHEN 2 THEN 'True' WHEN 3 THEN 'None' WHEN 4 THEN event_type ELSE '[' || CAST(user_id AS VARCHAR) || ',2]' END AS raw FROM events)""",
)
def _(spark, sf):
    e = V.table(spark, sf, "events")
    k = F.col("event_id") % 6
    raw = (
        F.when(k == 0, F.col("value").cast("string")).when(k == 1, F.col("user_id").cast("string")).when(k == 2, "True")
        .when(k == 3, "None").when(k == 4, F.col("event_type")).otherwise(F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(",2]")))
    )
    x = e.select("event_id", raw.alias("raw"))
    return x.select("event_id", "raw", VF.value_kind(F.col("raw")).alias("kind"), VF.as_number(F.col("raw")).alias("number"))


@query(
    "parse_seqlet_name",
    """SELECT vec_id, CAST(vec_id AS VARCHAR) || '_x' AS seq, 'T' || CAST(label AS VARCHAR) AS track, label AS "start", label + 8 AS "end" FROM embeddings""",
)
def _(spark, sf):
    e = V.table(spark, sf, "embeddings")
    name = F.concat(
        F.col("vec_id").cast("string"), F.lit("_x_T"), F.col("label").cast("string"), F.lit("_"),
        F.col("label").cast("string"), F.lit("-"), (F.col("label") + 8).cast("string"),
    )
    return e.select("vec_id", VF.seqlet_parts(name).alias("p")).select("vec_id", "p.*")


@query(
    "strip_suffix_names",
    C(V.MATREP) + f'SELECT DISTINCT "col", {_GROUP} AS grp FROM matrep',
)
def _(spark, sf):
    return V.matrix_replicates(spark, sf).select("col").distinct().withColumn("grp", VF.strip_suffix(F.col("col")))
