"""Motif, attribution and ablation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.operators import attribution as A
from strandframe.operators import motifs as M
from strandframe.operators import seqops
from strandframe.operators import similarity as SIM
from strandframe.plans import views as V
from strandframe.plans.catalog import query

C = V.ctes
MP = (V.ATT, V.PPM)
LP = (V.ATT, V.PPM, V.LPPM)

# attributions as motifs: raw values, both signs
RAW = """raw AS (SELECT 'k_' || seq AS motif, pos, base, value AS w FROM att)"""


def raw_motifs(spark, sf):
    return V.attributions(spark, sf).select(F.concat(F.lit("k_"), "seq").alias("motif"), "pos", "base", F.col("value").alias("w"))


# ----------------------------------------------------------------- transforms
@query("reverse_motif", C(*MP) + "SELECT motif, 15 - pos AS pos, translate(base, 'ACGT', 'TGCA') AS base, w FROM ppm", floats="w")
def _(spark, sf):
    return M.reverse_motif(V.ppms(spark, sf))


@query(
    "motif_to_kmer",
    C(*MP, "b AS (SELECT motif, pos, arg_max(base, w) AS b FROM ppm GROUP BY ALL)") + "SELECT motif, string_agg(b, '' ORDER BY pos) AS kmer FROM b GROUP BY motif",
)
def _(spark, sf):
    return M.motif_to_kmer(V.ppms(spark, sf))


@query(
    "kmer_to_motif",
    C(V.SEQ, "k AS (SELECT DISTINCT substr(seq, i, 5) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 3)) AS i FROM seqs WHERE length(seq) >= 5))",
      "g AS (SELECT kmer, CAST(unnest(range(0, 12)) AS INTEGER) AS pos FROM k)", "h AS (SELECT kmer, pos, unnest(['A', 'C', 'G', 'T']) AS base FROM g)")
    + "SELECT kmer AS motif, pos, base, CASE WHEN pos BETWEEN 3 AND 7 AND substr(kmer, pos - 2, 1) = base THEN 1 / 5 ELSE 0 END::DOUBLE AS w FROM h",
    floats="w",
)
def _(spark, sf):
    """All 5-mers that occur in the sequences."""
    from strandframe.operators.kmers import kmer_count_regular

    return M.kmer_to_motif(kmer_count_regular(V.sequences(spark, sf), 5).select("kmer").distinct(), 12)


@query("pad_motifs", C(*MP) + "SELECT motif, pos + 2 AS pos, base, w FROM ppm", floats="w")
def _(spark, sf):
    return M.pad_motifs(V.ppms(spark, sf), 20)


@query("pad_motifs_shifts", C(*MP, 'x AS (SELECT *, unnest([0, 1, 2, 3]) AS "shift" FROM ppm)') + 'SELECT motif, "shift", pos + "shift" AS pos, base, w FROM x', floats="w")
def _(spark, sf):
    return M.pad_motifs(V.ppms(spark, sf), 19, all_shifts=True)


@query(
    "rescale_motif",
    C(*MP, "a AS (SELECT motif, pos, base, greatest(log2((w + 0.001) * 4), -2) AS w FROM ppm)",
      "b AS (SELECT motif, pos, base, w / coalesce(nullif(max(abs(w)) OVER (PARTITION BY motif, pos), 0), 1) AS w FROM a)")
    + "SELECT motif, pos, base, w / (16 * stddev_pop(w) OVER (PARTITION BY motif)) AS w FROM b",
    floats="w",
)
def _(spark, sf):
    return M.rescale_motif(V.ppms(spark, sf), infocont=True, psam=True, norm=True)


@query(
    "transform_motif",
    C(V.ATT, RAW, "a AS (SELECT motif, pos, base, exp(w) + 0.25 AS w FROM raw)", "b AS (SELECT motif, pos, base, w / sum(w) OVER (PARTITION BY motif, pos) AS w FROM a)")
    + "SELECT motif, pos, base, greatest(log2((w + 1e-16) / 0.25), 0) AS w FROM b",
    floats="w",
)
def _(spark, sf):
    return M.transform_motif(raw_motifs(spark, sf), ["exp", "pseudo=0.25", "norm=sumpos", "infocont"])


@query(
    "transform_motif_signed",
    C(V.ATT, RAW, "a AS (SELECT motif, pos, base, -w / max(abs(w)) OVER (PARTITION BY motif) AS w FROM raw)")
    + "SELECT motif, pos, base, w * sign(sum(w) OVER (PARTITION BY motif)) AS w FROM a",
    floats="w",
)
def _(spark, sf):
    return M.transform_motif(raw_motifs(spark, sf), ["negate", "norm=absmax", "sign"])


@query(
    "strip_motif",
    C(V.ATT, RAW, "p AS (SELECT motif, pos, sum(abs(w)) AS v FROM raw GROUP BY ALL)", "t AS (SELECT motif, max(v) AS top FROM p GROUP BY motif)",
      "l AS (SELECT motif, min(pos) AS lo, max(pos) AS hi FROM p JOIN t USING (motif) WHERE v >= 0.6 * top GROUP BY motif)")
    + "SELECT motif, pos - lo AS pos, base, w FROM raw JOIN l USING (motif) WHERE pos BETWEEN lo AND hi",
    floats="w",
)
def _(spark, sf):
    return M.strip_motif(raw_motifs(spark, sf), 0.6)


@query(
    "motif_to_iupac",
    C(*MP, "s AS (SELECT motif, pos, sum(CASE WHEN w > 0.25 THEN CASE base WHEN 'A' THEN 16 WHEN 'C' THEN 8 WHEN 'G' THEN 4 ELSE 2 END ELSE 0 END) AS s FROM ppm GROUP BY ALL)",
      """c AS (SELECT motif, pos, CASE s WHEN 16 THEN 'A' WHEN 8 THEN 'C' WHEN 4 THEN 'G' WHEN 2 THEN 'T' WHEN 20 THEN 'R' WHEN 10 THEN 'Y' WHEN 12 THEN 'S' WHEN 18 THEN 'W'
  WHEN 6 THEN 'K' WHEN 24 THEN 'M' WHEN 14 THEN 'B' WHEN 22 THEN 'D' WHEN 26 THEN 'H' WHEN 28 THEN 'V' ELSE 'N' END AS c FROM s)""")
    + "SELECT motif, string_agg(c, '' ORDER BY pos) AS iupac FROM c GROUP BY motif",
)
def _(spark, sf):
    return M.motif_to_iupac(V.ppms(spark, sf))


@query(
    "kernel_to_ppm",
    C(V.ATT, RAW, "b AS (SELECT 'k_' || CAST(vec_id AS VARCHAR) AS motif, label / 10.0 AS bias FROM embeddings)",
      "x AS (SELECT motif, pos, base, 2 ^ ((w + bias / 64) / stddev_pop(w) OVER (PARTITION BY motif) - 2) AS w FROM raw JOIN b USING (motif))",
      "t AS (SELECT motif, max(s) AS t FROM (SELECT motif, pos, sum(w) AS s FROM x GROUP BY ALL) GROUP BY motif)")
    + "SELECT motif, pos, base, w / t AS w FROM x JOIN t USING (motif)",
    floats="w",
)
def _(spark, sf):
    bias = V.table(spark, sf, "embeddings").select(F.concat(F.lit("k_"), F.col("vec_id").cast("string")).alias("motif"), (F.col("label") / 10.0).alias("bias"))
    return M.kernel_to_ppm(raw_motifs(spark, sf), bias)


@query("info_content", C(*MP) + "SELECT motif, sum(-w * log2(w / 0.25)) / 16 AS info_content, sum(w * log2(w / 0.25)) / 16 AS information FROM ppm GROUP BY motif", floats="info_content information")
def _(spark, sf):
    return M.info_content(V.ppms(spark, sf))


@query(
    "reduce_by_name",
    C(*MP, "n AS (SELECT 'c' || CAST(e.label AS VARCHAR) AS motif, pos, base, w FROM ppm JOIN embeddings e ON motif = 'm_' || CAST(vec_id AS VARCHAR))")
    + "SELECT motif, pos, base, avg(w) AS w FROM n GROUP BY ALL",
    floats="w",
)
def _(spark, sf):
    lab = V.table(spark, sf, "embeddings").select(
        F.concat(F.lit("m_"), F.col("vec_id").cast("string")).alias("motif"),
        F.concat(F.lit("c"), F.col("label").cast("string"), F.lit("_"), F.col("vec_id").cast("string")).alias("new"),
    )
    m = V.ppms(spark, sf).join(lab, "motif").select(F.col("new").alias("motif"), "pos", "base", "w")
    return M.reduce_by_name(m)


# ------------------------------------------------------------------- scanning
_CELL = """cell AS (SELECT s.name, s.i - l.pos AS st, l.motif, l.w FROM (SELECT name, length(seq) AS n, unnest(range(0, length(seq))) AS i, seq FROM seqs) s
  JOIN lppm l ON substr(s.seq, s.i + 1, 1) = l.base WHERE s.i - l.pos >= 0 AND s.i - l.pos <= s.n - 16)"""


@query(
    "pwm_scan",
    C(V.SEQ, *LP, _CELL, "sc AS (SELECT name, motif, st, sum(w) AS s FROM cell GROUP BY ALL)",
      "nn AS (SELECT name, length(seq) - 15 AS n FROM seqs WHERE length(seq) >= 16)",
      """ws AS (SELECT name, n, least(50, n) AS size, CAST(unnest(range(0, (greatest(n - least(50, n), 0) + least(50, n) - 1) // least(50, n) + 1)) AS INTEGER) AS "window" FROM nn)""")
    + """SELECT ws.name, motif, "window", max(s) AS score FROM ws JOIN sc ON ws.name = sc.name AND st >= "window" * 50 AND st < "window" * 50 + 50 GROUP BY ALL""",
    floats="score",
)
def _(spark, sf):
    return M.pwm_scan(V.sequences(spark, sf), V.label_ppms(spark, sf), "Max", 50, 50)


@query(
    "pwm_scan_scaled",
    C(V.SEQ, *LP, _CELL, "sc AS (SELECT name, motif, st, sum(w) AS s FROM cell GROUP BY ALL)", "b AS (SELECT name, motif, avg(s) AS s FROM sc GROUP BY ALL)",
      "r AS (SELECT name, motif, s / max(s) OVER (PARTITION BY motif) AS s FROM b)")
    + """SELECT name, motif, CAST(0 AS INTEGER) AS "window", CASE WHEN s < 0.85 THEN 0 ELSE s END AS score FROM r""",
    floats="score", digits=5,
)
def _(spark, sf):
    return M.pwm_scan(V.sequences(spark, sf), V.label_ppms(spark, sf), "Mean", cutoff=0.85, maxscale=True)


SL16 = "sl AS (SELECT DISTINCT substr(seq, i, 16) AS seqlet FROM (SELECT seq, unnest(range(1, length(seq) - 14)) AS i FROM seqs WHERE length(seq) >= 16))"
_ACT = "act AS (SELECT seqlet, motif, sum(w) AS act FROM (SELECT seqlet, i, substr(seqlet, i + 1, 1) AS b FROM sl, range(0, 16) t(i)) JOIN lppm ON pos = i AND base = b GROUP BY ALL)"


def _bench_seqlets(spark, sf):
    return seqops.unique_seqlets(seqops.split_seqlets(V.benchmark_sequences(spark, sf), 16))


SLB = SL16.replace("FROM seqs", "FROM bench")


@query(
    "kernel_activation",
    C(V.BENCH, *LP, SLB, _ACT) + "SELECT seqlet, motif, greatest(act + CAST(substr(motif, 2) AS INTEGER) / 10.0 - 5, 0) AS act FROM act",
    floats="act",
)
def _(spark, sf):
    sl = _bench_seqlets(spark, sf)
    k = V.label_ppms(spark, sf)
    bias = k.select("motif").distinct().withColumn("bias", F.expr("substring(motif, 2)").cast("int") / 10.0 - 5)
    return M.kernel_activation(sl, k, bias, "relu")


@query(
    "pwm_from_activations",
    C(
        V.SEQ, *LP, SL16, _ACT,
        "n AS (SELECT seqlet, motif, (act - min(act) OVER w) / (max(act) OVER w - min(act) OVER w) AS a FROM act WINDOW w AS (PARTITION BY motif))",
        "z AS (SELECT motif, avg(a) + 1.0 * stddev_pop(a) AS cut FROM n GROUP BY motif)",
        "p AS (SELECT seqlet, n.motif, a FROM n JOIN z USING (motif) WHERE a >= cut)",
        "c AS (SELECT motif, CAST(i AS INTEGER) AS pos, substr(seqlet, i + 1, 1) AS base, sum(a) AS s FROM p, range(0, 16) t(i) GROUP BY ALL)",
        "g AS (SELECT DISTINCT motif, pos, b AS base FROM c, (SELECT unnest(['A', 'C', 'G', 'T']) AS b))",
        "f AS (SELECT g.motif, g.pos, g.base, coalesce(s, 0) + 0.025 AS s FROM g LEFT JOIN c USING (motif, pos, base))",
    )
    + "SELECT motif, pos, base, s / sum(s) OVER (PARTITION BY motif, pos) AS w FROM f",
    floats="w", digits=5,
)
def _(spark, sf):
    sl = seqops.unique_seqlets(seqops.split_seqlets(V.sequences(spark, sf), 16))
    return M.pwm_from_activations(M.kernel_activation(sl, V.label_ppms(spark, sf)), 1.0)


@query(
    "mutation_scan",
    C(
        V.BENCH, *LP,
        "s AS (SELECT name, seq, length(seq) AS n FROM bench)",
        """mu AS (SELECT name, p AS pos, b AS base, substr(seq, 1, p) || b || substr(seq, p + 2) AS q, n FROM (SELECT *, unnest(range(0, n)) AS p FROM s), (SELECT unnest(['A', 'C', 'G', 'T']) AS b))""",
        """ce AS (SELECT name, pos, base, l.motif, i - l.pos AS st, w FROM (SELECT *, unnest(range(0, n)) AS i FROM mu) x
  JOIN (SELECT motif, pos, base AS lb, w FROM lppm) l ON substr(q, i + 1, 1) = lb WHERE i - l.pos BETWEEN 0 AND n - 16)""".replace("l.pos", "l.lpos").replace("SELECT motif, pos, base AS lb", "SELECT motif, pos AS lpos, base AS lb"),
        "sc AS (SELECT name, pos, base, motif, st, sum(w) AS s FROM ce GROUP BY ALL)",
        "mx AS (SELECT name, pos, base, sum(m) AS score FROM (SELECT name, pos, base, motif, max(s) AS m FROM sc GROUP BY ALL) GROUP BY ALL)",
    )
    + "SELECT name, 'score' AS track, CAST(pos AS INTEGER) AS pos, base, score - avg(score) OVER (PARTITION BY name, pos) AS effect FROM mx",
    floats="effect", digits=5,
)
def _(spark, sf):
    k = V.label_ppms(spark, sf)

    def scorer(seqs):
        return M.linear_score(seqs, k).select("name", F.lit("score").alias("track"), "score")

    return M.mutation_scan(V.benchmark_sequences(spark, sf), scorer)


def _gc(batch):
    """Toy model: GC share and length in hundreds."""
    return [[(s.count("G") + s.count("C")) / max(1, len(s)), len(s) / 100.0] for s in batch]


@query(
    "batch_predict",
    C(V.SEQ)
    + """SELECT name, track, avg(v) AS value FROM (SELECT name, 'gc' AS track, (length(q) - length(replace(replace(q, 'G', ''), 'C', ''))) / greatest(length(q), 1) AS v FROM (
    SELECT name, seq AS q FROM seqs UNION ALL SELECT name, repeat('N', least(3, length(seq))) || substr(seq, 1, greatest(length(seq) - 3, 0)) FROM seqs)
  UNION ALL SELECT name, 'len', length(seq) / 100 FROM seqs) GROUP BY ALL""",
    floats="value",
)
def _(spark, sf):
    return M.batch_predict(V.sequences(spark, sf), _gc, ["gc", "len"], [0, 3])


@query("masked_prediction_average")
def _(spark, sf):
    def near_gc(batch):
        import numpy as np

        out = []
        for s in batch:
            g = np.frombuffer(s.encode(), dtype=np.uint8)
            x = ((g == 71) | (g == 67)).astype(float)
            out.append(np.convolve(x, np.ones(5) / 5, mode="same")[: len(x)])
        return out

    return M.masked_prediction_average(V.sequences(spark, sf), near_gc, 20, 4)


# ----------------------------------------------------------------- similarity
def _aligned_sql(score: str, pad: float = 0.25, logp: bool = False) -> str:
    """All alignments of every motif to the ten label motifs, from plain cell joins."""
    return C(
        *LP,
        f"q AS (SELECT motif AS a, false AS rc, pos, base, w - {pad} AS w FROM ppm UNION ALL SELECT motif, true, 15 - pos, translate(base, 'ACGT', 'TGCA'), w - {pad} FROM ppm)",
        f"r AS (SELECT motif AS b, pos, base, w - {pad} AS w FROM lppm)",
        "qs AS (SELECT a, rc, sum(w) AS sx, sum(w * w) AS sxx FROM q GROUP BY ALL)",
        "rs AS (SELECT b, sum(w) AS sy, sum(w * w) AS syy FROM r GROUP BY ALL)",
        "cr AS (SELECT a, rc, b, r.pos - q.pos AS o, sum(q.w * r.w) AS x FROM q JOIN r ON q.base = r.base AND abs(r.pos - q.pos) <= 12 GROUP BY ALL)",
        "al AS (SELECT a, rc, b, o, x, sx, sxx, sy, syy, CAST((greatest(16 + o, 16) - least(0, o)) * 4 AS INTEGER) AS n FROM cr JOIN qs USING (a, rc) JOIN rs USING (b))",
        f"sc AS (SELECT a, b, rc, CAST(o AS INTEGER) AS o, n, {score} AS s FROM al)",
    )


_PEAR = "(x - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n))"
_BEST = "SELECT a, b, {dist} AS dist, o AS \"offset\", rc AS revcomp, n FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(s, 10) DESC, rc, o) AS rn FROM sc) WHERE rn = 1"


@query("motif_similarity", _aligned_sql(_PEAR) + _BEST.format(dist="1 - s"), floats="dist")
def _(spark, sf):
    return SIM.motif_similarity(V.ppms(spark, sf), V.label_ppms(spark, sf)).drop("logp")


@query("motif_similarity_mse", _aligned_sql("-(sxx + syy - 2 * x) / n") + _BEST.format(dist="-s"), floats="dist", digits=7)
def _(spark, sf):
    return SIM.motif_similarity(V.ppms(spark, sf), V.label_ppms(spark, sf), "mse").drop("logp")


@query(
    "motif_similarity_cosine",
    _aligned_sql("(x + 0.25 * (sx + sy) + 0.0625 * n) / sqrt((sxx + 0.5 * sx + 0.0625 * n) * (syy + 0.5 * sy + 0.0625 * n))") + _BEST.format(dist="1 - s"),
    floats="dist", digits=7,
)
def _(spark, sf):
    return SIM.motif_similarity(V.ppms(spark, sf), V.label_ppms(spark, sf), "cosine").drop("logp")


@query("motif_similarity_pvalue")
def _(spark, sf):
    return SIM.motif_similarity_pvalue(V.ppms(spark, sf), V.label_ppms(spark, sf))


@query(
    "motif_best_match",
    _aligned_sql(_PEAR)
    + ", m AS (" + _BEST.format(dist="1 - s") + ") SELECT a, b, dist, \"offset\", revcomp FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS rn FROM m) WHERE rn = 1",
    floats="dist",
)
def _(spark, sf):
    return SIM.best_reference(SIM.motif_similarity(V.ppms(spark, sf), V.label_ppms(spark, sf)))


# --------------------------------------------------------------- attributions
def _gauged(sql: str) -> str:
    return C(V.ATT, V.REF) + sql


@query("attribution_gauge", _gauged("SELECT seq, track, pos, base, value - avg(value) OVER (PARTITION BY seq, track, pos) AS value FROM att"), floats="value")
def _(spark, sf):
    return A.attribution_gauge(V.attributions(spark, sf))


@query(
    "attribution_gauge_frequency",
    _gauged("SELECT seq, track, pos, base, value - sum(value * CASE WHEN base IN ('A', 'T') THEN 0.3 ELSE 0.2 END) OVER (PARTITION BY seq, track, pos) AS value FROM att"),
    floats="value",
)
def _(spark, sf):
    return A.attribution_gauge(V.attributions(spark, sf), "frequency", frequencies={"A": 0.3, "C": 0.2, "G": 0.2, "T": 0.3})


@query(
    "attribution_gauge_reference",
    _gauged("SELECT a.seq, track, a.pos, a.base, value - max(CASE WHEN a.base = r.base THEN value END) OVER (PARTITION BY a.seq, track, a.pos) AS value FROM att a JOIN refb r ON a.seq = r.seq AND a.pos = r.pos"),
    floats="value",
)
def _(spark, sf):
    return A.attribution_gauge(V.attributions(spark, sf), "reference", V.reference_bases(spark, sf))


@query(
    "attribution_mean_effect",
    _gauged("""SELECT seq, track, pos, base, value FROM (SELECT a.seq, track, a.pos, a.base, a.base = r.base AS hit, value - avg(CASE WHEN a.base <> r.base THEN value END) OVER (PARTITION BY a.seq, track, a.pos) AS value
  FROM att a JOIN refb r ON a.seq = r.seq AND a.pos = r.pos) WHERE hit"""),
    floats="value",
)
def _(spark, sf):
    return A.attribution_gauge(V.attributions(spark, sf), "meaneffect", V.reference_bases(spark, sf))


@query("attribution_at_reference", _gauged("SELECT seq, track, pos, value FROM att JOIN refb USING (seq, pos, base)"), floats="value", digits=12)
def _(spark, sf):
    return A.attribution_at_reference(V.attributions(spark, sf), V.reference_bases(spark, sf))


@query(
    "attribution_difference",
    _gauged("SELECT seq, track, pos, base, value - (value - avg(value) OVER (PARTITION BY seq, track, pos)) AS value FROM att"),
    floats="value",
)
def _(spark, sf):
    a = V.attributions(spark, sf)
    return A.attribution_difference(a, A.attribution_gauge(a))


_TWOTRACK = """tt AS (SELECT CAST(CAST(seq AS BIGINT) // 2 AS VARCHAR) AS seq, 't' || CAST(CAST(seq AS BIGINT) % 2 AS VARCHAR) AS track, pos, base, value FROM att)"""


def _two_tracks(spark, sf):
    """Neighbouring vectors as the two tracks of one sequence."""
    a = V.attributions(spark, sf)
    i = F.col("seq").cast("bigint")
    return a.select(F.floor(i / 2).cast("string").alias("seq"), F.concat(F.lit("t"), (i % 2).cast("string")).alias("track"), "pos", "base", "value")


@query(
    "track_difference",
    C(V.ATT, _TWOTRACK) + "SELECT a.seq, a.track, a.pos, a.base, a.value - b.value AS value FROM tt a JOIN tt b USING (seq, pos, base) WHERE a.track <> 't0' AND b.track = 't0'",
    floats="value",
)
def _(spark, sf):
    return A.track_difference(_two_tracks(spark, sf), "t0")


@query(
    "attribution_similarity",
    C(V.ATT, _TWOTRACK) + """SELECT seq, 'x' AS track, covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value)) AS correlation FROM tt a JOIN tt b USING (seq, pos, base)
  WHERE a.track = 't0' AND b.track = 't1' GROUP BY seq""",
    floats="correlation",
)
def _(spark, sf):
    t = _two_tracks(spark, sf)
    a, b = (t.filter(F.col("track") == k).withColumn("track", F.lit("x")) for k in ("t0", "t1"))
    return A.attribution_similarity(a, b)


@query(
    "attribution_similarity_summary",
    C(V.ATT, _TWOTRACK, """s AS (SELECT seq, sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)) AS c FROM tt a JOIN tt b USING (seq, pos, base)
  WHERE a.track = 't0' AND b.track = 't1' GROUP BY seq)""") + "SELECT 'x' AS track, avg(c) AS mean, stddev_pop(c) AS std FROM s",
    floats="mean std",
)
def _(spark, sf):
    t = _two_tracks(spark, sf)
    a, b = (t.filter(F.col("track") == k).withColumn("track", F.lit("x")) for k in ("t0", "t1"))
    return A.similarity_summary(A.attribution_similarity(a, b, "cosine"), "cosine")


@query(
    "top_positions",
    C(V.ATT, "p AS (SELECT seq, track, pos, max(abs(value)) AS s FROM att GROUP BY ALL)", "t AS (SELECT *, row_number() OVER (PARTITION BY seq, track ORDER BY s DESC, pos) AS rn FROM p)")
    + "SELECT seq, track, pos, base, value FROM att JOIN t USING (seq, track, pos) WHERE rn <= 5",
    floats="value", digits=12,
)
def _(spark, sf):
    from strandframe.operators.select import top_positions

    return top_positions(V.attributions(spark, sf), 5)


@query(
    "sparse_to_dense",
    C(V.ATT, "p AS (SELECT seq, track, pos, max(abs(value)) AS s FROM att GROUP BY ALL)", "t AS (SELECT *, row_number() OVER (PARTITION BY seq, track ORDER BY s DESC, pos) AS rn FROM p)")
    + "SELECT seq, track, pos, base, CASE WHEN rn <= 5 THEN value ELSE 0 END AS value FROM att JOIN t USING (seq, track, pos)",
    floats="value", digits=12,
)
def _(spark, sf):
    from strandframe.operators.select import top_positions

    a = V.attributions(spark, sf)
    lengths = a.groupBy("seq").agg((F.max("pos") + 1).alias("length"))
    return A.sparse_to_dense(top_positions(a, 5), lengths)


_MOVE = """mv AS (SELECT seq, pos, sum(abs(value)) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m FROM prof),
ce AS (SELECT seq, arg_max(pos, {'m': m, 'p': -pos}) - 3 AS c FROM mv WHERE pos >= 6 GROUP BY seq)"""


@query("center_window", C(V.PROF, _MOVE) + "SELECT seq, track, pos, value FROM prof JOIN ce USING (seq) WHERE pos >= c - 10 AND pos < c + 10")
def _(spark, sf):
    return A.center_window(V.profile(spark, sf), 20)


@query(
    "trim_flanks",
    C(V.PROF, "t AS (SELECT seq, max(abs(value)) AS top FROM prof GROUP BY seq)", "l AS (SELECT seq, min(pos) AS lo, max(pos) AS hi FROM prof JOIN t USING (seq) WHERE abs(value) >= 0.6 * top AND top > 0 GROUP BY seq)")
    + "SELECT seq, track, pos, value FROM prof JOIN l USING (seq) WHERE pos BETWEEN lo AND hi",
)
def _(spark, sf):
    return A.trim_flanks(V.profile(spark, sf), 0.6)


@query("find_motif_runs")
def _(spark, sf):
    return A.find_motif_runs(V.profile(spark, sf), 2.0, 1, 4).select("seq", "track", F.array_join("positions", ",").alias("positions"))


@query(
    "strict_runs",
    C(V.PROF, "s AS (SELECT *, sign(value) AS sg FROM prof WHERE abs(value) > 2)",
      "n AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY seq, sg ORDER BY pos) <= 2 THEN 0 ELSE 1 END AS nw FROM s)",
      "i AS (SELECT *, sum(nw) OVER (PARTITION BY seq, sg ORDER BY pos) AS id FROM n)")
    + 'SELECT seq, track, min(pos) AS "start", max(pos) AS "end", count(*) AS n, avg(value) AS mean FROM i GROUP BY seq, track, sg, id HAVING count(*) >= 4',
    floats="mean",
)
def _(spark, sf):
    return A.strict_runs(V.profile(spark, sf), 2.0, 1, 4)


@query("find_zscore_runs")
def _(spark, sf):
    return A.find_zscore_runs(V.profile(spark, sf), 1.0, 4)


@query("extract_seqlets")
def _(spark, sf):
    s = A.extract_seqlets(V.attributions(spark, sf), V.reference_bases(spark, sf), 0.6, 1, 3)
    return s.withColumn("positions", F.array_join("positions", ","))


@query("seqlet_motifs")
def _(spark, sf):
    a = V.attributions(spark, sf)
    return A.seqlet_motifs(a, A.extract_seqlets(a, V.reference_bases(spark, sf), 0.6, 1, 3))


# seqlet effects: one per event, cluster = user, sequence = day, condition = event type
_EFF = """eff AS (SELECT CAST(user_id AS VARCHAR) AS cluster, strftime(ts, '%Y-%m-%d') AS seq, event_type AS condition, round(value * 100) - 4000 AS effect FROM events)"""
_PER = """per AS (SELECT cluster, seq, condition, CASE WHEN max(effect) >= -min(effect) THEN max(effect) ELSE min(effect) END AS x, max(effect) AS top FROM eff GROUP BY ALL),
gg AS (SELECT cluster, seq, max(top) AS mx, CASE WHEN max(x) >= -min(x) THEN max(x) ELSE min(x) END AS am, sum(x) AS sm, max(x) AS hi, min(x) AS lo, count(*) AS k, (SELECT count(DISTINCT condition) FROM eff) AS n FROM per GROUP BY ALL)"""


def _effects(spark, sf):
    e = V.table(spark, sf, "events")
    return e.select(
        F.col("user_id").cast("string").alias("cluster"), F.date_format("ts", "yyyy-MM-dd").alias("seq"), F.col("event_type").alias("condition"),
        (F.round(F.col("value") * 100) - 4000).alias("effect"),
    )


for _stat, _expr in {
    "max": "mx", "absmax": "am", "mean": "sm / n", "sum": "sm", "maxdiff": "CASE WHEN k = n THEN hi - lo ELSE greatest(hi, 0) - least(lo, 0) END",
    "presence": "CAST(sign(am) AS DOUBLE)", "count": "CAST(k AS DOUBLE)",
}.items():
    _name = "motif_sequence_matrix" if _stat == "max" else f"motif_sequence_matrix_{_stat}"

    @query(_name, C(_EFF, _PER) + f"SELECT cluster, seq, {_expr} AS value FROM gg", floats="value")
    def _(spark, sf, stat=_stat):
        return A.motif_sequence_matrix(_effects(spark, sf), stat)


@query(
    "motif_sequence_clusters",
    C(_EFF, "sz AS (SELECT cluster FROM eff GROUP BY cluster HAVING count(DISTINCT seq) >= 20)", "e2 AS (SELECT * FROM eff WHERE cluster IN (SELECT cluster FROM sz))",
      "g AS (SELECT cluster, seq, max(effect) AS v FROM e2 GROUP BY ALL)", "sc AS (SELECT DISTINCT seq, substr(seq, 9, 1) AS sq FROM e2)", "nn AS (SELECT sq, count(*) AS n FROM sc GROUP BY sq)")
    + "SELECT cluster, sq AS seq, sum(v) / max(n) AS value FROM g JOIN sc USING (seq) JOIN nn USING (sq) GROUP BY ALL",
    floats="value",
)
def _(spark, sf):
    e = _effects(spark, sf)
    sc = e.select("seq").distinct().select("seq", F.substring("seq", 9, 1).alias("seqcluster"))
    return A.motif_sequence_matrix(e, "max", minimum_size=20, sequence_clusters=sc)


_STATE = """st AS (SELECT event_type AS target, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END AS state, user_id AS cluster, round(value * 100) - 4000 AS effect FROM events)"""


@query(
    "motif_counts_by_state",
    C(_STATE)
    + "SELECT target, cluster, "
    + ", ".join(
        f"CAST(sum(CASE WHEN state = '{s}' AND sign(effect) = {g} THEN {g} ELSE 0 END) AS BIGINT) AS {s}_{n}"
        for s in ("start", "end") for g, n in ((1, "positive"), (-1, "negative"))
    )
    + " FROM st WHERE effect <> 0 GROUP BY ALL",
)
def _(spark, sf):
    e = V.table(spark, sf, "events")
    return A.motif_counts_by_state(
        e.select(F.col("event_type").alias("target"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("state"),
                 F.col("user_id").alias("cluster"), (F.round(F.col("value") * 100) - 4000).alias("effect"))
    )


@query(
    "step_summary",
    """WITH s AS (SELECT p_brand AS method, p_type AS condition, [p_size, p_size * 2, CASE WHEN p_partkey % 50 = 0 THEN p_size * 3 END] AS v FROM part),
  e AS (SELECT method, condition, CAST(i - 1 AS INTEGER) AS step, CAST(v[i] AS DOUBLE) AS x FROM s, range(1, 4) t(i))
  SELECT method, condition, step, avg(x) AS mean, stddev_pop(x) AS std, count(x) AS n FROM e GROUP BY ALL HAVING count(x) >= 3""",
    floats="mean std",
)
def _(spark, sf):
    p = V.table(spark, sf, "part")
    third = F.when(F.col("p_partkey") % 50 == 0, (F.col("p_size") * 3).cast("string")).otherwise("")
    series = F.concat_ws(",", F.col("p_size").cast("string"), (F.col("p_size") * 2).cast("string"), third)
    return A.step_summary(p.select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("method"), F.col("p_type").alias("condition"), series.alias("series")))


# ------------------------------------------------------------------- ablation
_ABL = """ab AS (SELECT 'k' || CAST(p_size % 10 AS VARCHAR) AS kernel, CAST(l_suppkey AS VARCHAR) AS point, l_returnflag || l_linestatus AS track, sum(l_quantity) AS y,
  sum(l_quantity) * 0.9 + count(*) AS yhat, sum(l_quantity) * 0.8 + max(l_linenumber) * 3 AS ym FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def _ablation(spark, sf, unit="kernel"):
    li, p = V.table(spark, sf, "lineitem"), V.table(spark, sf, "part")
    q = F.sum("l_quantity")
    return li.join(p, li.l_partkey == p.p_partkey).groupBy(
        F.concat(F.lit("k"), (F.col("p_size") % 10).cast("string")).alias(unit), F.col("l_suppkey").cast("string").alias("point"),
        F.concat("l_returnflag", "l_linestatus").alias("track"),
    ).agg(q.alias("y"), (q * 0.9 + F.count(F.lit(1))).alias("yhat"), (q * 0.8 + F.max("l_linenumber") * 3).alias("yhat_masked"))


def _classes(df):
    return df.select("track").distinct().select("track", F.substring("track", 1, 1).alias("class"))


def _cr(a: str) -> str:
    return f"""CASE WHEN stddev_pop({a}) = 0 AND stddev_pop(y) = 0 THEN NULL WHEN stddev_pop({a}) = 0 OR stddev_pop(y) = 0 THEN -1.0 ELSE covar_pop({a}, y) / (stddev_pop({a}) * stddev_pop(y)) END"""


@query(
    "kernel_effects",
    C(_ABL, "s AS (SELECT *, sum((yhat - ym) ^ 2) OVER (PARTITION BY kernel, point) AS ss FROM ab)")
    + f"""SELECT kernel, track, sum(CASE WHEN ss > 0 THEN (yhat - ym) ^ 3 / ss ELSE 0 END) AS effect, sum(yhat - ym) AS sum_effect, ({_cr("yhat")}) - ({_cr("ym")}) AS correlation_change,
  sqrt(avg((ym - y) ^ 2)) - sqrt(avg((yhat - y) ^ 2)) AS rmse_change FROM s GROUP BY ALL""",
    floats="effect sum_effect correlation_change rmse_change", digits=5,
)
def _(spark, sf):
    return A.kernel_effects(_ablation(spark, sf))


_PP = f"""pp AS (SELECT kernel, substr(track, 1, 1) AS class, point, 1 - ({_cr("yhat")}) AS fl, 1 - ({_cr("ym")}) AS ms, sqrt(avg((ym - y) ^ 2)) - sqrt(avg((yhat - y) ^ 2)) AS rc, count(*) AS n FROM ab GROUP BY ALL)"""


@query(
    "kernel_effects_per_point",
    C(_ABL, _PP) + 'SELECT kernel, class, point, ms - fl AS change, fl AS "full" FROM pp WHERE n > 1',
    floats="change full", digits=5,
)
def _(spark, sf):
    a = _ablation(spark, sf)
    return A.kernel_effects_per_point(a, _classes(a))


@query(
    "network_contribution",
    C(_ABL, _PP) + "SELECT kernel AS input, class, point, rc AS rmse_change, CASE WHEN n > 1 THEN ms - fl END AS correlation_change FROM pp",
    floats="rmse_change correlation_change", digits=5,
)
def _(spark, sf):
    a = _ablation(spark, sf, "input")
    return A.network_contribution(a, _classes(a))
