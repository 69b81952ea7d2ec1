"""A corpus from documents to packed sequences in five stages.

Each stage works on everything the stage before kept, is written as Parquet and read
again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.llm.common import stored, table, text_of, words
from strandframe.llm.decontaminate import contaminated
from strandframe.llm.line_dedup import dedup_lines
from strandframe.llm.near_dup import near_duplicates
from strandframe.llm.packing import pack
from strandframe.llm.quality_rules import apply_policy, rule_ledger


def keyed(docs: DataFrame) -> DataFrame:
    """The rows as ``row``, with text and a key that tells apart texts under one id and rows without id."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")).alias("key")
    return docs.select(row, key, F.col("text").alias("text"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the current policy rejects."""
    judged = apply_policy(rule_ledger(docs, row_col="row"))
    return judged.where("kept").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; one that has no word left goes, and ``n_chars`` follows the text."""
    cut = dedup_lines(docs, removed_col="_removed")
    text = text_of("text")
    full = cut.where((F.col("_removed") == 0) | text.rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        full = full.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return full.select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8); of repeated rows one."""
    rows = keyed(docs)
    verdict = near_duplicates(rows, id_col="key").groupBy("key").agg(F.first("kept").alias("kept"))
    one = F.row_number().over(W.partitionBy("key").orderBy("key"))
    met = rows.select("row", "key").join(verdict, "key")
    return met.where("kept").withColumn("n", one).where("n = 1").select("row.*")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    rows = keyed(docs)
    leaks = contaminated(rows, table(spark, sf_dir, "benchmark"), id_col="key").select("key").distinct()
    return rows.select("row", "key").join(leaks, "key", "left_anti").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 4,096 words and document ends."""
    text = text_of("text")
    same = F.when(F.trim(text) != "", F.xxhash64(F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))))
    return pack(docs, F.size(words(text)) + 1, same)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dup_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]
# Near duplicates and best-fit packing are not SQL; tests/llm compares the rows with a written-out version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
