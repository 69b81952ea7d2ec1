"""Boilerplate lines by the number of sites that carry them.

Every line hash gets a HyperLogLog sketch of its sites; sketches merge in the map-side
and final aggregation, so a line on a third of all pages is one row per task.  Lines
whose estimate is near the threshold are counted exactly.  A boilerplate line stays in
the document with the smallest id that has it and goes from all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import settled, stored

# White space inside a line, without the line break.
GAP = r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]"


def line_hashes(text: Column) -> Column:
    """Hash per line, in order; lines without a word are null.

    Lines are compared in lower case, trimmed, with runs of white space as one space.
    """
    plain = F.lower(F.trim(F.regexp_replace(text, GAP, " ")))
    return F.transform(F.split(plain, " ?\n ?"), lambda x: F.when(x != "", F.xxhash64(x)))


def boilerplate_lines(lines: DataFrame, min_sites: int, band: float = 0.1, lg_k: int = 12) -> DataFrame:
    """``h, first_id`` of hashes on ``min_sites`` or more sites.

    ``lines`` has ``id, site, hashes``.  The sketch error at ``lg_k`` 12 is 1.6 %; an
    estimate within ``band`` (and one site) of the threshold is replaced by an exact count.
    """
    flat = lines.select("id", "site", F.explode("hashes").alias("h"))
    spread = flat.groupBy("h").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.min("id").alias("first_id")
    )
    low, high = min(min_sites * (1 - band), min_sites - 1), max(min_sites * (1 + band), min_sites + 1)
    judged = stored(spread.where(F.col("sites") >= low), "line-spread")
    near = judged.where(F.col("sites") <= high)
    exact = (
        flat.join(near.select("h"), "h", "left_semi").groupBy("h").agg(F.count_distinct("site").alias("exact"))
    ).where(F.col("exact") >= min_sites)
    sure = judged.where(F.col("sites") > high).select("h", "first_id")
    return sure.unionByName(near.join(exact, "h").select("h", "first_id"))


def dedup_lines(
    docs: DataFrame,
    min_sites: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    removed_col: str = "n_removed",
) -> DataFrame:
    """All columns of ``docs`` with boilerplate lines taken out of the text, and ``removed_col``.

    A null site is one site of its own.  A null text stays null; a text that loses no line is unchanged, and one
    that loses all becomes empty.  Rows that share an id count as one document.  A row without an id keeps its lines
    only if no row with an id has them.  Every input row gives one output row.
    """
    if removed_col in docs.columns:
        raise ValueError(f"{removed_col} is a column of the input; name another with removed_col")
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("-"))
    own = F.array_distinct(F.array_compact(line_hashes(F.col(text_col).cast("string"))))
    lines = stored(
        docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), site.alias("site"), own.alias("hashes")),
        "line-hashes",
    )
    marked = boilerplate_lines(lines, min_sites)
    drops = (
        lines.select("id", F.explode("hashes").alias("h"))
        .join(marked, "h")
        .where(~F.col("id").eqNullSafe(F.col("first_id")))
        .groupBy("id")
        .agg(F.collect_set("h").alias("drops"))
    )
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    met = rows.join(drops, F.col("row")[id_col].eqNullSafe(F.col("id")), "left")
    text = F.col("row")[text_col]
    kept = F.filter(
        F.arrays_zip(F.split(text, "\n").alias("line"), line_hashes(text).alias("h")),
        lambda x: x["h"].isNull() | ~F.array_contains(F.col("drops"), x["h"]),
    )
    cut = settled(met.select("row", F.when(F.col("drops").isNotNull() & text.isNotNull(), kept).alias("kept")))
    n_before, n_after = F.size(F.split(text, "\n")), F.size("kept")
    out = []
    for c in docs.columns:
        value = F.col("row")[c]
        if c == text_col:
            value = F.when(F.col("kept").isNull(), value).otherwise(F.array_join(F.transform("kept", lambda x: x["line"]), "\n"))
        out.append(value.alias(c))
    removed = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(n_before - n_after)
    return cut.select(*out, removed.cast("long").alias(removed_col))
