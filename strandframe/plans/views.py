"""Views that carry the operators on the driver's tables.

Each view exists twice: as a Spark function and as a DuckDB common table
expression with the same columns.  Every view reads its whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators.blocks import spread

BASES = ["A", "C", "G", "T"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- sequences
def sequences(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("name"),
        F.regexp_replace(F.upper("text"), "[^ACGT]+", "").alias("seq"),
    )


SEQ = "seqs AS (SELECT CAST(doc_id AS VARCHAR) AS name, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"


def benchmark_sequences(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "benchmark")
    return d.select(
        F.col("item_id").cast("string").alias("name"), F.regexp_replace(F.upper("text"), "[^ACGT]+", "").alias("seq")
    )


BENCH = "bench AS (SELECT CAST(item_id AS VARCHAR) AS name, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM benchmark)"


def region_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Three intervals per sequence, as 5' part, body and 3' part."""
    s = sequences(spark, sf)
    n = F.length("seq")
    third = F.floor(n / 3).cast("int")
    parts = F.array(
        F.struct(F.lit("F5").alias("region"), F.lit(0).alias("start"), third.alias("end")),
        F.struct(F.lit("body").alias("region"), third.alias("start"), (2 * third).alias("end")),
        F.struct(F.lit("T3").alias("region"), (2 * third).alias("start"), n.alias("end")),
    )
    return s.select("name", F.inline(parts)).filter(F.col("end") > F.col("start"))


REGCH = """regch AS (
  SELECT name, 'F5' AS region, 0 AS "start", len // 3 AS "end" FROM (SELECT name, length(seq) AS len FROM seqs) WHERE len // 3 > 0
  UNION ALL SELECT name, 'body', len // 3, 2 * (len // 3) FROM (SELECT name, length(seq) AS len FROM seqs) WHERE len // 3 > 0
  UNION ALL SELECT name, 'T3', 2 * (len // 3), len FROM (SELECT name, length(seq) AS len FROM seqs) WHERE len > 2 * (len // 3))"""


# ------------------------------------------------------------------- matrix
def matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Part by track quantity matrix; a track is return flag and line status."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("row"),
        F.concat("l_returnflag", "l_linestatus").alias("col"),
    ).agg(F.sum("l_quantity").alias("value"))


MAT = """mat AS (SELECT 'P' || CAST(l_partkey AS VARCHAR) AS "row", l_returnflag || l_linestatus AS "col",
  sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"""


def matrix_replicates(spark: SparkSession, sf: str) -> DataFrame:
    """As ``matrix`` with the line number as replicate suffix."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("row"),
        F.concat_ws("_", F.concat("l_returnflag", "l_linestatus"), F.col("l_linenumber").cast("string")).alias("col"),
    ).agg(F.sum("l_quantity").alias("value"))


MATREP = """matrep AS (SELECT 'P' || CAST(l_partkey AS VARCHAR) AS "row",
  l_returnflag || l_linestatus || '_' || CAST(l_linenumber AS VARCHAR) AS "col",
  sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"""


def matrix_b(spark: SparkSession, sf: str) -> DataFrame:
    """A second modality on the same rows and columns: discounted quantity, in exact units of 0.01."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("row"),
        F.concat("l_returnflag", "l_linestatus").alias("col"),
    ).agg(F.sum(F.round(F.col("l_quantity") * (F.lit(100) - F.round(F.col("l_discount") * 100)))).alias("value"))


MATB = """matb AS (SELECT 'P' || CAST(l_partkey AS VARCHAR) AS "row", l_returnflag || l_linestatus AS "col",
  sum(round(l_quantity * (100 - round(l_discount * 100)))) AS value FROM lineitem GROUP BY ALL)"""


# --------------------------------------------------------- regions and reads
_ORIGIN = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


def _pos():
    return F.expr(f"cast(floor(timestampdiff(MICROSECOND, {_ORIGIN}, cast(ts AS TIMESTAMP_NTZ)) / 1000000) AS bigint)")


def reads(spark: SparkSession, sf: str) -> DataFrame:
    """Alignments from events: contig = event type, position = seconds since the first day."""
    e = table(spark, sf, "events")
    width = 20 + F.floor("value").cast("bigint")
    pos = _pos()
    return e.select(
        F.col("event_id").alias("read"),
        F.col("event_type").alias("contig"),
        pos.alias("start"),
        (pos + width).alias("end"),
        F.when(F.col("event_id") % 2 == 0, width).otherwise(-width).alias("tlen"),
        (F.col("event_id") % 2 == 1).alias("reverse"),
        (F.col("event_id") % 5 != 0).alias("proper"),
        (F.col("event_id") % 61).cast("int").alias("mapq"),
        F.when(F.col("event_id") % 7 == 0, 4).otherwise(0).cast("int").alias("flag"),
    )


POS = "CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) - CAST(epoch_us(TIMESTAMP '2024-01-01') // 1000000 AS BIGINT)"
READS = f"""reads AS (SELECT event_id AS read, event_type AS contig, {POS} AS "start",
  {POS} + 20 + CAST(floor(value) AS BIGINT) AS "end",
  CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (20 + CAST(floor(value) AS BIGINT)) AS tlen,
  event_id % 2 = 1 AS reverse, event_id % 5 <> 0 AS proper, CAST(event_id % 61 AS INTEGER) AS mapq,
  CASE WHEN event_id % 7 = 0 THEN 4 ELSE 0 END AS flag FROM events)"""


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """One region per user and contig: an hour from the user's first event there."""
    e = table(spark, sf, "events")
    return (
        e.groupBy("user_id", F.col("event_type").alias("chrom"))
        .agg(F.min(_pos()).alias("start"))
        .select(
            F.concat_ws(":", "chrom", F.col("user_id").cast("string")).alias("name"),
            "chrom",
            "start",
            (F.col("start") + 3600).alias("end"),
            F.when(F.col("user_id") % 2 == 0, "+").otherwise("-").alias("strand"),
        )
    )


REGIONS = f"""regions AS (SELECT event_type || ':' || CAST(user_id AS VARCHAR) AS name, event_type AS chrom,
  min({POS}) AS "start", min({POS}) + 3600 AS "end", CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand
  FROM events GROUP BY user_id, event_type)"""


def blacklist(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals around very large events."""
    e = table(spark, sf, "events").filter(F.col("value") > 200)
    return e.select(F.col("event_type").alias("chrom"), _pos().alias("start"), (_pos() + 200).alias("end"))


BLACK = f"""black AS (SELECT event_type AS chrom, {POS} AS "start", {POS} + 200 AS "end" FROM events WHERE value > 200)"""


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """bedGraph rows: one per event, ten to sixty bases wide."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("chrom"),
        _pos().alias("start"),
        (_pos() + 10 + F.floor(F.col("value") / 10).cast("bigint")).alias("end"),
        F.floor("value").alias("value").cast("double"),
    )


SIGNAL = f"""signal AS (SELECT event_type AS chrom, {POS} AS "start",
  {POS} + 10 + CAST(floor(value / 10) AS BIGINT) AS "end", floor(value) AS value FROM events)"""


# ---------------------------------------------------- attributions and motifs
def attributions(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 16 x 4 attribution maps; the label is the track."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").cast("string").alias("seq"),
        F.concat(F.lit("T"), F.col("label").cast("string")).alias("track"),
        F.posexplode("embedding").alias("i", "v"),
    ).select(
        "seq",
        "track",
        F.floor(F.col("i") / 4).cast("int").alias("pos"),
        F.element_at(F.array(*[F.lit(b) for b in BASES]), (F.col("i") % 4 + 1).cast("int")).alias("base"),
        F.col("v").cast("double").alias("value"),
    )


ATT = """att AS (SELECT seq, track, CAST((i - 1) // 4 AS INTEGER) AS pos, substr('ACGT', CAST((i - 1) % 4 + 1 AS BIGINT), 1) AS base,
  CAST(embedding[i] AS DOUBLE) AS value FROM (
  SELECT CAST(vec_id AS VARCHAR) AS seq, 'T' || CAST(label AS VARCHAR) AS track, embedding,
  unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def reference_bases(spark: SparkSession, sf: str) -> DataFrame:
    """The reference letter of each map position, a fixed rule on vector and position."""
    a = attributions(spark, sf).select("seq", "pos").distinct()
    i = ((F.col("seq").cast("bigint") + F.col("pos")) % 4 + 1).cast("int")
    return a.select("seq", "pos", F.element_at(F.array(*[F.lit(b) for b in BASES]), i).alias("base"))


REF = """refb AS (SELECT DISTINCT seq, pos, substr('ACGT', CAST((CAST(seq AS BIGINT) + pos) % 4 + 1 AS BIGINT), 1) AS base FROM att)"""


def motifs(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as motifs: frequencies from the squared values at each position."""
    a = attributions(spark, sf)
    return a.select(
        F.concat_ws("_", F.lit("m"), "seq").alias("motif"), "pos", "base", (F.col("value") * F.col("value") + 0.001).alias("w0"), "track"
    )


def ppms(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    m = motifs(spark, sf)
    tot = F.sum("w0").over(W.partitionBy("motif", "pos"))
    return m.select("motif", "pos", "base", (F.col("w0") / tot).alias("w"))


PPM = """ppm AS (SELECT 'm_' || seq AS motif, pos, base,
  (value * value + 0.001) / sum(value * value + 0.001) OVER (PARTITION BY seq, pos) AS w FROM att)"""


def label_ppms(spark: SparkSession, sf: str) -> DataFrame:
    """Reference motif set: the mean motif of each label (ten motifs)."""
    lab = table(spark, sf, "embeddings").select(
        F.concat(F.lit("m_"), F.col("vec_id").cast("string")).alias("motif"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("l")
    )
    return ppms(spark, sf).join(lab, "motif").groupBy(F.col("l").alias("motif"), "pos", "base").agg(F.avg("w").alias("w"))


LPPM = """lppm AS (SELECT 'L' || CAST(e.label AS VARCHAR) AS motif, p.pos, p.base, avg(p.w) AS w
  FROM ppm p JOIN embeddings e ON p.motif = 'm_' || CAST(e.vec_id AS VARCHAR) GROUP BY ALL)"""


def profile(spark: SparkSession, sf: str) -> DataFrame:
    """A 1-D signal per document: word length minus six, in word order."""
    d = spread(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("seq"), "text"), "seq")
    return d.select(
        "seq", F.lit("words").alias("track"), F.posexplode(F.split("text", " ")).alias("pos", "word")
    ).select("seq", "track", "pos", (F.length("word") - 6).cast("double").alias("value"))


PROF = """prof AS (SELECT seq, 'words' AS track, CAST(i - 1 AS INTEGER) AS pos, CAST(length(words[i]) - 6 AS DOUBLE) AS value
  FROM (SELECT seq, words, unnest(range(1, len(words) + 1)) AS i
        FROM (SELECT CAST(doc_id AS VARCHAR) AS seq, string_split(text, ' ') AS words FROM documents)))"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
