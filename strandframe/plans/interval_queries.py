"""Interval, genome and intron queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.operators import genome as G
from strandframe.operators import intervals as I
from strandframe.operators.blocks import spread
from strandframe.plans import views as V
from strandframe.plans.catalog import query

C = V.ctes

_FRAG = """frag AS (SELECT contig, "start" + 4 AS s, "start" + abs(tlen) - 4 AS e, reverse, abs(tlen) AS len, count(*) AS n
  FROM reads WHERE proper AND NOT reverse AND abs(tlen) <= 300 GROUP BY ALL)"""
_RFRAG = """frag AS (SELECT contig, "start" + 4 AS s, "end" - 4 AS e, reverse, "end" - "start" AS len, count(*) AS n FROM reads GROUP BY ALL)"""
_INSIDE = """((s >= r."start" AND s < r."end") OR (e >= r."start" AND e <= r."end"))"""


def _frags(spark, sf, mode="fragment", max_length=300):
    return I.fragments(V.reads(spark, sf), mode, max_length)


@query(
    "count_cuts_in_regions",
    C(V.READS, V.REGIONS, _FRAG, "cut AS (SELECT contig, unnest([s, e - 1]) AS p, n FROM frag)")
    + """SELECT name, p - r."start" AS "offset", CAST(sum(n) AS BIGINT) AS count FROM cut JOIN regions r ON contig = chrom AND p >= r."start" AND p < r."end" GROUP BY ALL""",
)
def _(spark, sf):
    return I.count_cuts_in_regions(_frags(spark, sf), V.regions(spark, sf))


@query(
    "count_cuts_five_prime",
    C(V.READS, V.REGIONS, _RFRAG, "cut AS (SELECT contig, CASE WHEN reverse THEN e - 1 ELSE s END AS p, n FROM frag)")
    + """SELECT name, p - r."start" AS "offset", CAST(sum(n) AS BIGINT) AS count FROM cut JOIN regions r ON contig = chrom AND p >= r."start" AND p < r."end" GROUP BY ALL""",
)
def _(spark, sf):
    return I.count_cuts_in_regions(_frags(spark, sf, "read", None), V.regions(spark, sf), "5")


@query(
    "count_cuts_entire",
    C(
        V.READS,
        V.REGIONS,
        _FRAG,
        f"""h AS (SELECT name, greatest(s, r."start") - r."start" AS lo, least(e, r."end") - r."start" AS hi, n FROM frag JOIN regions r ON contig = chrom
  AND s < r."end" AND e > r."start" AND e > s AND {_INSIDE})""",
    )
    + 'SELECT name, "offset", CAST(sum(n) AS BIGINT) AS count FROM (SELECT name, unnest(range(lo, hi)) AS "offset", n FROM h) GROUP BY ALL',
)
def _(spark, sf):
    return I.count_cuts_in_regions(_frags(spark, sf), V.regions(spark, sf), "entire")


@query(
    "count_cuts_entirefraction",
    C(
        V.READS,
        V.REGIONS,
        _FRAG,
        f"""h AS (SELECT name, greatest(s, r."start") - r."start" AS lo, least(e, r."end") - r."start" AS hi, n / len AS n FROM frag JOIN regions r ON contig = chrom
  AND s < r."end" AND e > r."start" AND e > s AND {_INSIDE})""",
    )
    + 'SELECT name, "offset", sum(n) AS count FROM (SELECT name, unnest(range(lo, hi)) AS "offset", n FROM h) GROUP BY ALL',
    floats="count",
)
def _(spark, sf):
    return I.count_cuts_in_regions(_frags(spark, sf), V.regions(spark, sf), "entirefraction")


@query(
    "exclude_blacklist",
    C(V.READS, V.BLACK, _FRAG)
    + """SELECT contig, s AS "start", e AS "end", reverse, len AS length, n FROM frag f WHERE NOT EXISTS (SELECT 1 FROM black b WHERE b.chrom = f.contig
  AND ((f.s >= b."start" AND f.s < b."end") OR (f.e >= b."start" AND f.e < b."end")))""",
)
def _(spark, sf):
    return I.exclude_blacklist(_frags(spark, sf), V.blacklist(spark, sf))


_SIGHIT = """sg AS (SELECT chrom, "start" AS s, "end" AS e, sum(value) AS value FROM signal GROUP BY ALL),
sh AS (SELECT name, greatest(s, r."start") - r."start" AS lo, least(e, r."end") - r."start" AS hi, value FROM sg JOIN regions r ON sg.chrom = r.chrom AND s < r."end" AND e > r."start" AND value <> 0),
sv AS (SELECT name, "offset", sum(value) AS value FROM (SELECT name, unnest(range(lo, hi)) AS "offset", value FROM sh) GROUP BY ALL)"""


@query("signal_over_regions", C(V.SIGNAL, V.REGIONS, _SIGHIT) + "SELECT * FROM sv")
def _(spark, sf):
    return I.signal_over_regions(V.signal(spark, sf), V.regions(spark, sf))


@query(
    "average_pool",
    C(V.SIGNAL, V.REGIONS, _SIGHIT) + 'SELECT name, CAST("offset" // 100 AS INTEGER) AS "window", sum(value) / 100 AS value FROM sv GROUP BY ALL',
    floats="value",
)
def _(spark, sf):
    return I.average_pool(I.signal_over_regions(V.signal(spark, sf), V.regions(spark, sf)), 100)


@query(
    "average_region",
    C(V.SIGNAL, V.REGIONS, _SIGHIT)
    + 'SELECT r.name, coalesce(sum(value), 0) / 3600 AS value FROM regions r LEFT JOIN sv USING (name) GROUP BY r.name',
    floats="value",
)
def _(spark, sf):
    r = V.regions(spark, sf)
    return I.average_pool(I.signal_over_regions(V.signal(spark, sf), r), None, r)


@query(
    "pool_tracks",
    C(
        V.SIGNAL,
        V.REGIONS,
        _SIGHIT,
        """c AS (SELECT name, "offset", value FROM sv WHERE "offset" >= 300 AND "offset" < 3300)""",
        """t AS (SELECT name, CASE WHEN count(*) < 3000 THEN 0 ELSE min(value) END AS lo, sum(value) AS s FROM c GROUP BY name)""",
    )
    + 'SELECT name, "offset", (value - lo) / (s - 3000 * lo) * 100 AS value FROM c JOIN t USING (name)',
    floats="value",
)
def _(spark, sf):
    p = I.signal_over_regions(V.signal(spark, sf), V.regions(spark, sf), by_name=True).withColumn("track", F.lit("t0"))
    return I.pool_tracks(p, ["t0"], 3600, 300, one_row=True)


@query("total_reads", C(V.READS) + "SELECT count(*) AS reads FROM reads WHERE starts_with(contig, 'c') AND (flag & 4) = 0")
def _(spark, sf):
    return I.total_reads(V.reads(spark, sf), "c")


@query(
    "covered_bases",
    C(
        V.READS,
        """d AS (SELECT DISTINCT contig AS chrom, "start" AS s, "end" AS e FROM reads)""",
        """m AS (SELECT chrom, s, e, coalesce(max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s) AS seen FROM d)""",
    )
    + "SELECT chrom, CAST(sum(greatest(0, e - greatest(s, seen))) AS BIGINT) AS bases FROM m GROUP BY chrom",
)
def _(spark, sf):
    return I.covered_bases(V.reads(spark, sf).withColumnRenamed("contig", "chrom"))


_FEAT = """feat AS (SELECT name AS gene, chrom, "start", "end" FROM regions)"""


def _features(spark, sf):
    return V.regions(spark, sf).withColumnRenamed("name", "gene")


_HIT = """h AS (SELECT rd.read, gene, least(rd."end", f."end") - greatest(rd."start", f."start") AS ov, rd."end" - rd."start" AS len FROM reads rd JOIN feat f
  ON rd.contig = f.chrom AND rd."start" < f."end" AND rd."end" > f."start")"""


@query(
    "count_reads_in_features",
    C(V.READS, V.REGIONS, _FEAT, _HIT, "o AS (SELECT read, min(gene) AS gene FROM h WHERE ov >= 5 GROUP BY read HAVING count(DISTINCT gene) = 1)")
    + "SELECT gene, count(*) AS count FROM o GROUP BY gene",
)
def _(spark, sf):
    return I.count_reads_in_features(V.reads(spark, sf), _features(spark, sf))


@query(
    "count_reads_strict",
    C(V.READS, V.REGIONS, _FEAT, _HIT, "o AS (SELECT read, min(gene) AS gene FROM h WHERE ov = len GROUP BY read HAVING count(DISTINCT gene) = 1)")
    + "SELECT gene, count(*) AS count FROM o GROUP BY gene",
)
def _(spark, sf):
    return I.count_reads_in_features(V.reads(spark, sf), _features(spark, sf), "strict")


@query(
    "extend_regions",
    C(V.REGIONS) + """SELECT name, chrom, greatest(0, "start" - 200) AS "start", "end" + 200 AS "end", strand FROM regions""",
)
def _(spark, sf):
    return I.extend_regions(V.regions(spark, sf), 4000)


# -------------------------------------------------------- annotation: introns
_EXON = """exon AS (SELECT l_orderkey AS transcript, l_linenumber * 1000 + min(l_partkey) % 500 AS "start",
  l_linenumber * 1000 + min(l_partkey) % 500 + 100 + CAST(max(l_quantity) AS BIGINT) AS "end" FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
_TRANS = """trans AS (SELECT 'g' || CAST(o_custkey AS VARCHAR) AS gene, transcript, min("start") - (transcript % 3) * 50 AS "start", max("end") + (transcript % 2) * 30 AS "end"
  FROM exon JOIN orders ON transcript = o_orderkey GROUP BY gene, transcript)"""
_INTRON = """intron AS (SELECT transcript, s AS "start", e AS "end" FROM (
  SELECT transcript, lag("end") OVER (PARTITION BY transcript ORDER BY "start") + 1 AS s, "start" - 1 AS e FROM exon WHERE transcript IN (SELECT transcript FROM trans)
  UNION ALL SELECT t.transcript, t."start", min(x."start") - 1 FROM trans t JOIN exon x USING (transcript) GROUP BY t.transcript, t."start"
  UNION ALL SELECT t.transcript, max(x."end") + 1, t."end" FROM trans t JOIN exon x USING (transcript) GROUP BY t.transcript, t."end") WHERE s IS NOT NULL AND e >= s)"""


def exons(spark, sf):
    # by order, in tasks that AQE does not merge: exons, transcripts and introns are then made without another shuffle of lines
    li = spread(V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").where("l_orderkey IS NOT NULL"), "l_orderkey")
    base = F.col("l_linenumber").cast("bigint") * 1000 + F.min("l_partkey") % 500
    return li.groupBy(F.col("l_orderkey").alias("transcript"), "l_linenumber").agg(
        base.alias("start"), (base + 100 + F.max("l_quantity").cast("bigint")).alias("end")
    ).select("transcript", "start", "end")


def transcripts(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("transcript"), F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("gene"))
    return exons(spark, sf).join(o, "transcript").groupBy("gene", "transcript").agg(
        (F.min("start") - (F.col("transcript") % 3) * 50).alias("start"), (F.max("end") + (F.col("transcript") % 2) * 30).alias("end")
    )


@query("derive_introns", C(_EXON, _TRANS, _INTRON) + "SELECT * FROM intron")
def _(spark, sf):
    t = transcripts(spark, sf)
    return I.derive_introns(t, exons(spark, sf).join(t.select("transcript"), "transcript", "left_semi"))


@query(
    "constitutive_introns",
    C(
        _EXON,
        _TRANS,
        _INTRON,
        'ig AS (SELECT gene, i.* FROM intron i JOIN trans USING (transcript))',
        'bp AS (SELECT gene, "start" AS p FROM trans UNION SELECT gene, "end" + 1 FROM trans UNION SELECT gene, "start" FROM ig UNION SELECT gene, "end" + 1 FROM ig)',
        'sg AS (SELECT gene, p AS s, lead(p) OVER (PARTITION BY gene ORDER BY p) - 1 AS e FROM bp)',
        """dp AS (SELECT s.gene, s.s, s.e, (SELECT count(*) FROM trans t WHERE t.gene = s.gene AND t."start" <= s.s AND t."end" >= s.e) AS t,
  (SELECT count(*) FROM ig i WHERE i.gene = s.gene AND i."start" <= s.s AND i."end" >= s.e) AS i FROM sg s WHERE s.e IS NOT NULL)""",
        "ok AS (SELECT gene, s, e, CASE WHEN lag(e) OVER (PARTITION BY gene ORDER BY s) + 1 = s THEN 0 ELSE 1 END AS nw FROM dp WHERE t > 0 AND t = i)",
        "il AS (SELECT gene, min(s) AS s, max(e) AS e FROM (SELECT *, sum(nw) OVER (PARTITION BY gene ORDER BY s) AS id FROM ok) GROUP BY gene, id)",
    )
    + """SELECT t.gene, transcript, s AS "start", e AS "end" FROM il JOIN trans t ON il.gene = t.gene AND s >= t."start" AND e <= t."end\"""",
)
def _(spark, sf):
    t = transcripts(spark, sf)
    introns = I.derive_introns(t, exons(spark, sf).join(t.select("transcript"), "transcript", "left_semi"))
    return I.constitutive_introns(t, introns)


@query(
    "feature_length_per_gene",
    C(_EXON, _TRANS, _INTRON)
    + """SELECT gene, type, CAST(sum("end" - "start") AS BIGINT) AS length FROM (SELECT transcript, 'exonic' AS type, "start", "end" FROM exon UNION ALL SELECT transcript, 'intronic', "start", "end" FROM intron)
  JOIN (SELECT gene, transcript FROM trans) USING (transcript) GROUP BY ALL""",
)
def _(spark, sf):
    t = transcripts(spark, sf)
    ex = exons(spark, sf).join(t.select("transcript"), "transcript", "left_semi")
    both = ex.withColumn("type", F.lit("exonic")).unionByName(I.derive_introns(t, ex).withColumn("type", F.lit("intronic")))
    return I.feature_length_per_gene(both.join(t.select("gene", "transcript"), "transcript"))


# --------------------------------------------------------------------- genome
_GREG = """greg AS (SELECT 'r' || name AS name, name AS chrom, length(seq) // 3 - 5 AS "start", 2 * (length(seq) // 3) + 1 AS "end",
  CASE WHEN CAST(name AS BIGINT) % 3 = 0 THEN '+' WHEN CAST(name AS BIGINT) % 3 = 1 THEN '-' ELSE '.' END AS strand FROM seqs)"""


def _genome(spark, sf):
    return G.genome_chunks(V.sequences(spark, sf).withColumnRenamed("name", "chrom"), 64)


def _genome_regions(spark, sf):
    third = F.floor(F.length("seq") / 3)
    k = F.col("name").cast("bigint") % 3
    return V.sequences(spark, sf).select(
        F.concat(F.lit("r"), "name").alias("name"), F.col("name").alias("chrom"), (third - 5).alias("start"), (2 * third + 1).alias("end"),
        F.when(k == 0, "+").when(k == 1, "-").otherwise(".").alias("strand"),
    )


def _slice(s: str, e: str, seq: str = "seq") -> str:
    """0-based substring with N outside."""
    return (
        f"(repeat('N', CAST(greatest(0, least({e}, 0) - {s}) AS BIGINT)) || substr({seq}, CAST(greatest({s}, 0) + 1 AS BIGINT), CAST(greatest(0, least({e}, length({seq})) - greatest({s}, 0)) AS BIGINT))"
        f" || repeat('N', CAST(greatest(0, {e} - greatest({s}, length({seq}))) AS BIGINT)))"
    )


@query(
    "extract_region_sequences",
    C(V.SEQ, _GREG) + f"""SELECT g.name, {_slice('(g."start" - 10)', '(g."end" + 10)')} AS seq FROM greg g JOIN seqs ON chrom = seqs.name""",
)
def _(spark, sf):
    return G.extract_region_sequences(_genome_regions(spark, sf), _genome(spark, sf), flank=10, size=64)


@query(
    "extract_extended",
    C(V.SEQ, _GREG, """x AS (SELECT *, 300 - ("end" - "start") AS ex FROM greg)""", """y AS (SELECT *, "start" - CAST(floor(ex / 2) AS BIGINT) AS s, "end" + ex - CAST(floor(ex / 2) AS BIGINT) AS e FROM x)""")
    + f"SELECT y.name, chrom, s AS \"start\", e AS \"end\", {_slice('s', 'e')} AS seq FROM y JOIN seqs ON chrom = seqs.name",
)
def _(spark, sf):
    return G.extract_region_sequences(_genome_regions(spark, sf), _genome(spark, sf), extend_to=300, size=64, save_positions=True)


_RC = "translate(reverse({}), 'ACGT', 'TGCA')"


@query(
    "extract_from_tss",
    C(V.SEQ, _GREG)
    + f"""SELECT g.name, {_slice('(g."start" - 40)', '(g."start" + 40)')} AS seq FROM greg g JOIN seqs ON chrom = seqs.name WHERE strand IN ('+', '.')
  UNION ALL SELECT CASE strand WHEN '-' THEN g.name ELSE g.name || '.rev' END, {_RC.format(_slice('(g."end" - 40)', '(g."end" + 40)'))} FROM greg g JOIN seqs ON chrom = seqs.name WHERE strand IN ('-', '.')""",
)
def _(spark, sf):
    return G.extract_region_sequences(_genome_regions(spark, sf), _genome(spark, sf), flank=40, from_tss=True, size=64)


@query(
    "assemble_transcripts",
    C(V.SEQ, """ex AS (SELECT name, seq, unnest([0, length(seq) // 2, 5]) AS s, unnest([4, length(seq) // 2 + 30, 25]) AS e FROM seqs)""",
      f"""pc AS (SELECT name, s, {_slice('s', 'e')} AS p FROM ex)""", "j AS (SELECT name, string_agg(p, '' ORDER BY s, p) AS seq FROM pc GROUP BY name)")
    + f"SELECT name, CASE WHEN CAST(name AS BIGINT) % 2 = 1 THEN {_RC.format('seq')} ELSE seq END AS seq FROM j",
)
def _(spark, sf):
    s = V.sequences(spark, sf)
    half = F.floor(F.length("seq") / 2)
    parts = F.array(
        *[F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("end")) for a, b in
          ((F.lit(0), F.lit(4)), (half, half + 30), (F.lit(5), F.lit(25)))]
    )
    ex = s.select("name", F.col("name").alias("chrom"), F.when(F.col("name").cast("bigint") % 2 == 1, "-").otherwise("+").alias("strand"), F.inline(parts))
    return G.assemble_transcripts(ex, _genome(spark, sf), size=64)


@query("read_genome", C(V.SEQ) + """SELECT name AS chrom, CAST(k AS INTEGER) AS chunk_no, substr(seq, k * 100 + 1, 100) AS seq FROM (SELECT name, seq, unnest(range(0, (length(seq) - 1) // 100 + 1)) AS k FROM seqs WHERE length(seq) > 0)""")
def _(spark, sf):
    from strandframe.sources.text import parse_genome

    s = V.sequences(spark, sf).filter(F.length("seq") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / 60).cast("int"))
    lines = s.select(F.col("name").alias("chrom"), "seq", F.explode(starts).alias("i")).select(
        "chrom", (F.col("i") + 7).cast("bigint").alias("line_no"), F.lower(F.expr("substring(seq, i * 60 + 1, 60)")).alias("value")
    )
    return parse_genome(lines, 100)
