"""Reader and writer queries: text is rendered from the tables in Spark and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.plans import views as V
from strandframe.plans.catalog import query
from strandframe.sources import sinks, text

C = V.ctes


def _tab(*cols):
    return F.concat_ws("\t", *[c if not isinstance(c, str) else F.col(c).cast("string") for c in cols]).alias("value")


@query(
    "read_matrix",
    C(V.MAT, """p AS (SELECT "row", sum(value) FILTER (WHERE "col" = 'AF') AS a, sum(value) FILTER (WHERE "col" = 'NO') AS b, sum(value) FILTER (WHERE "col" = 'RF') AS c, sum(value) FILTER (WHERE "col" = 'NF') AS d FROM mat GROUP BY "row")""")
    + """SELECT "row", 'AF' AS "col", coalesce(a, 0) AS value FROM p UNION ALL SELECT "row", 'NO', coalesce(b, 0) FROM p UNION ALL SELECT "row", 'RF', coalesce(c, 0) FROM p UNION ALL SELECT "row", 'NF', coalesce(d, 0) FROM p""",
)
def _(spark, sf):
    wide = sinks.wide_matrix(V.matrix(spark, sf), ["AF", "NO", "RF", "NF"])
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in ("AF", "NO", "RF", "NF")]
    lines = wide.select(_tab(F.concat(F.lit('"'), "row", F.lit('"')), *cells))
    return text.parse_matrix(lines, ["AF", "NO", "RF", "NF"], fill=0.0)


@query("read_fasta", C(V.SEQ) + "SELECT name, seq FROM seqs WHERE length(seq) > 10")
def _(spark, sf):
    s = V.sequences(spark, sf)
    folded = F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n")
    return text.parse_fasta(s.select(F.concat(F.lit(">"), "name", F.lit("\n"), folded, F.lit("\n")).alias("value")))


@query("read_sequences_onehot", C(V.SEQ) + "SELECT name, CAST(length(seq) AS INTEGER) AS n, CAST(length(replace(replace(replace(seq, 'A', ''), 'G', ''), 'T', '')) AS INTEGER) AS n_c FROM seqs WHERE length(seq) > 10")
def _(spark, sf):
    seqs = text.parse_fasta(sinks.format_fasta(V.sequences(spark, sf)))
    oh = text.sequences_onehot(seqs)
    c = F.aggregate("onehot", F.lit(0), lambda acc, r: acc + F.element_at(r, 2).cast("int"))
    return oh.select("name", F.size("onehot").alias("n"), c.alias("n_c"))


@query("write_fasta", C(V.SEQ) + "SELECT '>' || name || chr(10) || seq AS value FROM seqs")
def _(spark, sf):
    return sinks.format_fasta(V.sequences(spark, sf))


@query(
    "read_gtf",
    """SELECT 'chr' || p_size AS chrom, p_partkey * 10 AS "start", p_partkey * 10 + 100 AS "end", CASE WHEN p_partkey % 3 > 0 THEN p_name END AS gene_name, 'exon' AS feature, '+' AS strand,
  p_type AS gene_type, 'src' AS source, 'G' || p_partkey AS gene_id, CASE WHEN p_partkey % 2 = 0 THEN 'T' || p_partkey END AS transcript_id FROM part""",
)
def _(spark, sf):
    p = V.table(spark, sf, "part")
    k = F.col("p_partkey").cast("string")
    attrs = F.concat(
        F.lit('gene_id "G'), k, F.lit('"; gene_type "'), F.col("p_type"), F.lit('";'),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(' transcript_id "T'), k, F.lit('";'))).otherwise(""),
        F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit(' gene_name "'), F.col("p_name"), F.lit('";'))).otherwise(""),
    )
    lines = p.select(
        _tab(F.concat(F.lit("chr"), F.col("p_size").cast("string")), F.lit("src"), F.lit("exon"), (F.col("p_partkey") * 10).cast("string"),
             (F.col("p_partkey") * 10 + 100).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attrs)
    )
    return text.parse_gtf(lines)


@query("read_regions", C(V.REGIONS) + 'SELECT name, chrom, "start", "end", strand FROM regions')
def _(spark, sf):
    r = V.regions(spark, sf)
    return text.parse_regions(r.select(_tab("chrom", (F.col("start") + 1).cast("string"), "end", "name", F.lit("0"), "strand")), "bed", 1)


@query(
    "read_alignments",
    C(V.READS)
    + """SELECT CAST(read AS VARCHAR) AS read, contig, "start", "end", tlen, reverse, proper, mapq, CAST(flag + CASE WHEN reverse THEN 16 ELSE 0 END + CASE WHEN proper THEN 2 ELSE 0 END AS INTEGER) AS flag FROM reads""",
)
def _(spark, sf):
    r = V.reads(spark, sf)
    flag = F.col("flag") + F.when(F.col("reverse"), 16).otherwise(0) + F.when(F.col("proper"), 2).otherwise(0)
    return text.parse_alignments(r.select(_tab("read", flag.cast("string"), "contig", "start", "end", "mapq", "tlen")))


@query("read_signal", C(V.SIGNAL) + 'SELECT chrom, "start", "end", CASE WHEN value < 50 THEN 0 ELSE value END AS value FROM signal')
def _(spark, sf):
    s = V.signal(spark, sf)
    v = F.when(F.col("value") < 50, "NaN").otherwise(F.col("value").cast("string"))
    return text.parse_signal(s.select(_tab("chrom", "start", "end", v)))


@query(
    "read_region_annotation",
    C(V.SEQ, V.REGCH) + """SELECT name AS gene, region, CAST(unnest(range(CAST("start" AS BIGINT), CAST("end" AS BIGINT))) AS INTEGER) AS pos FROM regch WHERE region <> 'T3'
  UNION ALL SELECT name, region, CAST(unnest(["start", "end" - 1]) AS INTEGER) FROM regch WHERE region = 'T3'""",
)
def _(spark, sf):
    r = V.region_channels(spark, sf)
    loc = F.when(F.col("region") != "T3", F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string"))).otherwise(
        F.concat_ws(",", F.col("start").cast("string"), (F.col("end") - 1).cast("string"))
    )
    return text.parse_region_annotation(r.select(_tab("name", "region", loc, F.lit("9999"))))


_ROUNDED = "SELECT motif, pos, base, w FROM ppm"


@query("read_motifs", C(V.ATT, V.PPM) + _ROUNDED, floats="w", digits=5)
def _(spark, sf):
    return text.parse_motifs(sinks.format_motifs(V.ppms(spark, sf), 12))


@query(
    "read_motif_bias",
    "SELECT 'm_' || CAST(vec_id AS VARCHAR) AS motif, label / 8.0 AS bias FROM embeddings",
    floats="bias",
)
def _(spark, sf):
    bias = V.table(spark, sf, "embeddings").select(F.concat(F.lit("m_"), F.col("vec_id").cast("string")).alias("motif"), (F.col("label") / 8.0).alias("bias"))
    return text.parse_motif_bias(sinks.format_motifs(V.ppms(spark, sf), 4, bias))


@query(
    "write_motifs",
    C(V.ATT, """o AS (SELECT 'm_' || seq AS motif, pos, string_agg(CASE WHEN value > 0 THEN '1.00' ELSE '0.00' END, chr(9) ORDER BY base) AS r FROM att GROUP BY ALL)""",
      "b AS (SELECT motif, count(*) AS n, string_agg(r, chr(10) ORDER BY pos) AS t FROM o GROUP BY motif)")
    + "SELECT 'MOTIF ' || motif || chr(10) || 'letter-probability matrix: alength= 4 w= ' || CAST(n AS VARCHAR) || chr(10) || t || chr(10) AS value FROM b",
)
def _(spark, sf):
    m = V.attributions(spark, sf).select(F.concat(F.lit("m_"), "seq").alias("motif"), "pos", "base", (F.col("value") > 0).cast("double").alias("w"))
    return sinks.format_motifs(m, 2)


_TT = """tt AS (SELECT 'q' || CAST(l_suppkey AS VARCHAR) AS query, 'T' || CAST(l_partkey AS VARCHAR) AS target, min(l_linenumber) AS "offset", 1.0 / (1 + max(l_linenumber)) AS p,
  0.5 AS correlation, 1.0 / (2 + max(l_linenumber)) AS q, min(l_linenumber) % 2 AS orientation FROM lineitem GROUP BY ALL)"""


def _tomtom(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return li.groupBy(
        F.concat(F.lit("q"), F.col("l_suppkey").cast("string")).alias("query"), F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("target")
    ).agg(
        F.min("l_linenumber").alias("offset"), (1.0 / (1 + F.max("l_linenumber"))).alias("p"), F.lit(0.5).alias("correlation"),
        (1.0 / (2 + F.max("l_linenumber"))).alias("q"), (F.min("l_linenumber") % 2).alias("orientation"),
    )


@query("read_tomtom", C(_TT) + "SELECT query, target, p, q FROM tt WHERE q <= 0.2", floats="p q")
def _(spark, sf):
    lines = sinks.format_tomtom(_tomtom(spark, sf), 0.2)
    # drop the correlation column's neighbour so that p is column 3 and q column 5, as in the match format
    return text.parse_tomtom(lines)


@query(
    "write_tomtom",
    C(_TT) + """SELECT query || chr(9) || target || chr(9) || "offset" || chr(9) || '0.5' || chr(9) || orientation AS value FROM tt""",
)
def _(spark, sf):
    lines = sinks.format_tomtom(_tomtom(spark, sf)).select(F.split("value", "\t").alias("f"))
    pick = [F.element_at("f", i) for i in (1, 2, 3, 5, 7)]
    return lines.select(F.concat_ws("\t", *pick).alias("value"))


_FOLD = """fold AS (SELECT CAST(doc_id AS VARCHAR) AS name, CAST(doc_id % 5 AS INTEGER) AS fold FROM documents)"""


@query("read_write_folds", C(_FOLD) + "SELECT name, fold FROM fold")
def _(spark, sf):
    f = V.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), (F.col("doc_id") % 5).alias("fold"))
    return text.parse_folds(sinks.format_folds(f))


_SHEET = """sheet AS (SELECT 'S' || CAST(o_orderkey AS VARCHAR) AS sample, o_orderstatus AS cell, o_orderpriority AS treatment, 'rep ' || CAST(o_custkey % 4 AS VARCHAR) AS replicate FROM orders)"""


def _sheet(spark, sf):
    return V.table(spark, sf, "orders").select(
        F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("sample"), F.col("o_orderstatus").alias("cell"),
        F.col("o_orderpriority").alias("treatment"), F.concat(F.lit("rep "), (F.col("o_custkey") % 4).cast("string")).alias("replicate"),
    )


@query(
    "build_design",
    C(_SHEET)
    + """SELECT sample, sample || '.' || ext || '.txt' AS file, read_type, regexp_replace(replicate, '[^A-Za-z0-9]', '', 'g') AS batch, treatment || '_' || cell AS condition
  FROM sheet, (VALUES ('exonic', 'exon'), ('intronic', 'intron')) t(read_type, ext)""",
)
def _(spark, sf):
    return text.build_design(_sheet(spark, sf))


@query(
    "read_counts",
    """WITH c AS (SELECT 'P' || CAST(l_partkey AS VARCHAR) AS "row", l_returnflag AS f, sum(l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY ALL),
  g AS (SELECT "row" FROM c GROUP BY "row" HAVING count(*) = 3)
  SELECT "row", f AS "col", CASE WHEN f = 'N' THEN 'intronic' ELSE 'exonic' END AS datatype, CASE WHEN n = 5 THEN NULL ELSE v END AS value FROM c
  WHERE f = 'N' OR "row" IN (SELECT "row" FROM c WHERE f IN ('A', 'R') GROUP BY "row" HAVING count(*) = 2)""",
)
def _(spark, sf):
    li = V.table(spark, sf, "lineitem")
    c = li.groupBy("l_partkey", "l_returnflag").agg(F.sum("l_quantity").alias("v"), F.count(F.lit(1)).alias("n"))
    name = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    lines = c.select(F.col("l_returnflag").alias("file"), _tab(name, F.when(F.col("n") == 5, "NA").otherwise(F.col("v").cast("string"))))
    skipped = c.select(F.col("l_returnflag").alias("file"), _tab(F.lit("__no_feature"), "n"))
    design = li.select(F.col("l_returnflag").alias("file")).distinct().select(
        "file", F.col("file").alias("sample"), F.when(F.col("file") == "N", "intronic").otherwise("exonic").alias("read_type")
    )
    return text.parse_counts(lines.unionByName(skipped), design)


@query(
    "write_matrix",
    C(V.MAT) + """SELECT "row", round(sum(value) FILTER (WHERE "col" = 'AF'), 1) AS "AF", round(sum(value) FILTER (WHERE "col" = 'NO'), 1) AS "NO", round(sum(value) FILTER (WHERE "col" = 'RF'), 1) AS "RF", round(sum(value) FILTER (WHERE "col" = 'NF'), 1) AS "NF" FROM mat GROUP BY "row\"""",
)
def _(spark, sf):
    return sinks.wide_matrix(V.matrix(spark, sf), ["AF", "NO", "RF", "NF"])


@query(
    "write_motif_bed",
    C(V.READS, V.REGIONS)
    + """SELECT r.name AS seq, 'words' AS track, r.chrom, r."start" + e.event_id % 3000 AS "start", r."start" + e.event_id % 3000 + 11 AS "end",
  CASE WHEN e.event_id % 4 < 3 THEN 'c' || CAST(e.event_id % 4 AS VARCHAR) ELSE '3' END AS name, value AS score
  FROM events e JOIN regions r ON r.name = e.event_type || ':' || CAST(e.user_id AS VARCHAR)""",
)
def _(spark, sf):
    e = V.table(spark, sf, "events")
    seqlets = e.select(
        F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("seq"), F.lit("words").alias("track"),
        (F.col("event_id") % 3000).alias("start"), (F.col("event_id") % 3000 + 10).alias("end"), (F.col("event_id") % 4).alias("cluster"),
        F.col("value").alias("max"),
    )
    labels = seqlets.select("cluster").distinct().filter("cluster < 3").select("cluster", F.concat(F.lit("c"), F.col("cluster").cast("string")).alias("label"))
    return sinks.motif_bed(seqlets, V.regions(spark, sf), labels)
