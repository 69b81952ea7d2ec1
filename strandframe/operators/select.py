"""Selections, filters and set operations on names and matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_COMPARE = {
    "lt": lambda v, c: v < c,
    "leq": lambda v, c: v <= c,
    "gt": lambda v, c: v > c,
    "geq": lambda v, c: v >= c,
}


def spec_predicate(spec: str, name: Column, index: Column) -> Column:
    """Selector language as a predicate: ``all``, integer, ``a-to-b``, ``musthave=x``, name or comma list."""
    if spec in ("all", "complete"):
        return F.lit(True)
    if spec.startswith("musthave="):
        return name.contains(spec[len("musthave="):])
    if "-to-" in spec:
        lo, hi = spec.split("-to-")
        return index.between(int(lo), int(hi))
    parts = spec.split(",")
    if all(p.lstrip("-").isdigit() for p in parts):
        return index.isin([int(p) for p in parts])
    return name.isin(parts)


def select_by_spec(df: DataFrame, spec: str, name: str = "col", index: str = "idx") -> DataFrame:
    return df.filter(spec_predicate(spec, F.col(name), F.col(index)))


def filter_by_name_list(df: DataFrame, names: DataFrame, column: str = "name", keep: bool = True) -> DataFrame:
    """Semi or anti join with a name table."""
    return df.join(names.select(F.col(names.columns[0]).alias(column)).distinct(), column, "left_semi" if keep else "left_anti")


def select_features(df: DataFrame, features: DataFrame) -> DataFrame:
    return filter_by_name_list(df, features, "col")


def select_by_threshold(df: DataFrame, cut: float, how: str = "gt", mode: str = "any") -> DataFrame:
    """Names of ``(name, matrix, value)`` that pass in any or in all matrices."""
    ok = _COMPARE[how](F.col("value"), F.lit(cut))
    agg = F.bool_or(ok) if mode == "any" else F.bool_and(ok)
    return df.groupBy("name").agg(agg.alias("ok")).filter("ok").select("name")


def drop_constant_rows(df: DataFrame, what: str = "zero", axis: str = "row") -> DataFrame:
    """Drop rows (or columns) that are all 0 (``zero``), all 1 (``one``) or all equal (``constant``)."""
    v = F.col("value")
    live = {
        "zero": F.bool_or(v != 0),
        "one": F.bool_or(v != 1),
        "constant": F.max(v) > F.min(v),
    }[what]
    names = df.groupBy(axis).agg(live.alias("live")).filter("live").select(axis)
    return df.join(names, axis, "left_semi")


def jitter_constant_rows(df: DataFrame, scale: float = 1e-4, seed: int = 0) -> DataFrame:
    """Add hashed noise in [0, scale) to rows without variance."""
    flat = df.groupBy("row").agg((F.max("value") == F.min("value")).alias("flat"))
    noise = F.pmod(F.xxhash64("row", "col", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0) * scale
    return df.join(flat, "row").select(
        "row", "col", F.when(F.col("flat"), F.col("value") + noise).otherwise(F.col("value")).alias("value")
    )


def filter_columns_by_group(df: DataFrame, value: str, groups: DataFrame | None = None, part: int | None = None, sep: str = "_") -> DataFrame:
    """Keep columns whose group (lookup table ``(col, group)`` or a part of the name) equals ``value``."""
    if groups is not None:
        keep = groups.filter(F.col("group") == value).select("col").distinct()
        return df.join(keep, "col", "left_semi")
    return df.filter(F.get(F.split("col", sep), F.lit(part)) == value)


def split_matrix_by_suffix(df: DataFrame, sep: str = ".") -> DataFrame:
    """Add the data type from the column suffix and strip it; write with ``partitionBy('datatype')``."""
    stem = F.expr(f"substring(col, 1, length(col) - length(substring_index(col, '{sep}', -1)) - 1)")
    return df.select("row", stem.alias("col"), F.substring_index("col", sep, -1).alias("datatype"), "value")


def subsample_fraction(df: DataFrame, name: str, fraction: float, seed: int = 0) -> DataFrame:
    """A fixed share of names by hash; the same rows whatever the partitioning."""
    h = F.pmod(F.xxhash64(F.col(name), F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return df.filter(h < fraction)


def subsample_n(df: DataFrame, name: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows by hash order (a distributed top-k)."""
    return df.orderBy(F.xxhash64(F.col(name), F.lit(seed)), name).limit(n)


def filter_top_by_maxabs(df: DataFrame, top: float) -> DataFrame:
    """Rows with the largest max-abs value; ``top`` below 1 is a share of the rows."""
    size = df.groupBy("row").agg(F.max(F.abs("value")).alias("size"))
    if top < 1:
        from strandframe.functions.ranking import rank_cells

        cells = rank_cells(size, [], "size")
        cut = cells.filter((F.col("n_total") - F.col("n_before")) <= F.ceil(F.col("n_total") * top)).agg(F.min("size").alias("cut"))
        keep = size.join(F.broadcast(cut)).filter(F.col("size") >= F.col("cut")).select("row")
    else:
        keep = size.orderBy(F.col("size").desc(), "row").limit(int(top)).select("row")
    return df.join(keep, "row", "left_semi")


def filter_annotation(
    df: DataFrame, feature: str | None = None, gene_type: str | None = None, source: str | None = None,
    chroms: str | None = None, exclude: list[str] | None = None,
) -> DataFrame:
    """Annotation predicates; ``chroms`` is a comma list or a range such as ``chr.1-19``."""
    if feature:
        df = df.filter(F.col("feature") == feature)
    if gene_type:
        df = df.filter(F.col("gene_type") == gene_type)
    if source:
        df = df.filter(F.col("source") == source)
    if chroms:
        if "." in chroms and "-" in chroms:
            prefix, span = chroms.split(".", 1)
            lo, hi = span.split("-")
            names = [f"{prefix}{i}" for i in range(int(lo), int(hi) + 1)]
        else:
            names = chroms.split(",")
        df = df.filter(F.col("chrom").isin(names))
    if exclude:
        df = df.filter(~F.col("chrom").isin(exclude))
    return df


def strip_id_version(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.substring_index(column, ".", 1))


def filter_alignments(df: DataFrame, min_mapq: int = 30, exclude: tuple[str, ...] = ("chrM",)) -> DataFrame:
    """Good quality, mapped, not on an excluded contig."""
    return df.filter(
        (F.col("mapq") >= min_mapq) & (F.col("flag").bitwiseAND(4) == 0) & ~F.col("contig").isin(list(exclude))
    )


# ------------------------------------------------------------- set operations
def combine_lists(lists: list[DataFrame], how: str = "union") -> DataFrame:
    """Sorted unique names in any (``union``) or in all (``intersect``) lists."""
    out = lists[0].toDF("name")
    for nxt in lists[1:]:
        nxt = nxt.toDF("name")
        out = out.unionByName(nxt) if how == "union" else out.intersect(nxt)
    return out.distinct().orderBy("name")


def common_and_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every name with its side: ``both``, ``a`` or ``b``."""
    x = a.toDF("name").select("name", F.lit(1).alias("ina"), F.lit(0).alias("inb"))
    y = b.toDF("name").select("name", F.lit(0).alias("ina"), F.lit(1).alias("inb"))
    g = x.unionByName(y).groupBy("name").agg(F.max("ina").alias("ina"), F.max("inb").alias("inb"))
    side = F.when(F.col("ina") + F.col("inb") == 2, "both").when(F.col("ina") == 1, "a").otherwise("b")
    return g.select("name", side.alias("side"))


def union_with_prefix(parts: dict[str, DataFrame], column: str = "name", sep: str = "_") -> DataFrame:
    """Stack tables and put the model id before each name."""
    out = None
    for prefix, df in parts.items():
        named = df.withColumn(column, F.concat_ws(sep, F.lit(prefix), F.col(column)))
        out = named if out is None else out.unionByName(named)
    return out


def split_by_model(df: DataFrame, column: str = "name", sep: str = "_") -> DataFrame:
    """Model id (first part) as a column, prefix removed; write with ``partitionBy('model')``."""
    return df.withColumn("model", F.substring_index(column, sep, 1)).withColumn(
        column, F.expr(f"substring({column}, length(substring_index({column}, '{sep}', 1)) + 2)")
    )


def unique_column_names(cols: DataFrame) -> DataFrame:
    """Append ``_i`` to the second and later copies of a header name ``(idx, col)``."""
    rn = F.row_number().over(W.partitionBy("col").orderBy("idx"))
    return cols.withColumn("__rn", rn).select(
        "idx", F.when(F.col("__rn") == 1, F.col("col")).otherwise(F.concat_ws("_", "col", (F.col("__rn") - 1).cast("string"))).alias("col")
    )


def top_features(coef: DataFrame, max_feat: int) -> DataFrame:
    """Union of top features by mean-abs, by max-abs and by best rank in any track, by max-abs order.

    ``coef`` is ``(track, feature, value)``.  The three rankings run on one row per feature.
    """
    a = F.abs("value")
    rank = F.rank().over(W.partitionBy("track").orderBy(a.desc()))
    ranked = coef.withColumn("r", F.when(F.col("value") == 0, F.lit(2**31 - 1)).otherwise(rank))
    per = ranked.groupBy("feature").agg(F.avg(a).alias("mean_abs"), F.max(a).alias("max_abs"), F.min("r").alias("best_rank"))
    picks = [
        per.orderBy(o, "feature").limit(max_feat).select("feature")
        for o in (F.col("mean_abs").desc(), F.col("max_abs").desc(), F.col("best_rank").asc())
    ]
    chosen = picks[0].union(picks[1]).union(picks[2]).distinct()
    return per.join(chosen, "feature", "left_semi").orderBy(F.col("max_abs").desc(), "feature")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Best ``n`` rows per key.  Spark trims each input partition to ``n`` rows per key before
    the shuffle (window group limit), so a large key never moves as a whole."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def best_matches(df: DataFrame, n: int = 1, key: str = "query", stat: str = "q", cutoff: float | None = None) -> DataFrame:
    """Best ``n`` targets per query by a statistic; with a cut-off the target becomes ``-1`` above it."""
    out = top_per_key(df.select(key, "target", stat), [key], [F.col(stat).asc(), F.col("target").asc()], n)
    if cutoff is not None:
        out = out.withColumn("target", F.when(F.col(stat) <= cutoff, F.col("target")).otherwise("-1"))
    return out


def top_positions(attr: DataFrame, n: int) -> DataFrame:
    """Strongest positions per sequence and track (max-abs over bases), kept in order."""
    pos = attr.groupBy("seq", "track", "pos").agg(F.max(F.abs("value")).alias("size"))
    top = top_per_key(pos, ["seq", "track"], [F.col("size").desc(), F.col("pos").asc()], n).select("seq", "track", "pos")
    return attr.join(top, ["seq", "track", "pos"])


def best_examples(df: DataFrame, n: int) -> DataFrame:
    """Lowest 0.75 * correlation distance + 0.25 * rmse."""
    score = 0.75 * F.col("correlation") + 0.25 * F.col("rmse")
    return df.select("name", score.alias("score")).orderBy("score", "name").limit(n)


def reorder_to(df: DataFrame, target: DataFrame, name: str = "name") -> DataFrame:
    """Rows in the order of a target list ``(name, idx)``; a missing name raises when the row is computed."""
    j = target.join(df.withColumn("__hit", F.lit(True)), name, "left")
    checked = F.when(F.col("__hit").isNull(), F.raise_error(F.concat(F.lit("not found: "), F.col(name)))).otherwise(F.col("idx"))
    return j.withColumn("idx", checked.cast("bigint")).drop("__hit").orderBy("idx")
