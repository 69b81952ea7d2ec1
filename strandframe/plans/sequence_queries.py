"""K-mer, composition and sequence-string queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import sequence as S
from strandframe.operators import kmers, seqops
from strandframe.plans import views as V
from strandframe.plans.catalog import query

C = V.ctes


def _win(k: int, src: str = "seqs", step: int = 1, name: str = "win") -> str:
    return (
        f"{name} AS (SELECT name, i, substr(seq, i, {k}) AS w FROM (SELECT name, seq, "
        f"unnest(range(1, length(seq) - {k} + 2, {step})) AS i FROM {src} WHERE length(seq) >= {k}))"
    )


@query("kmer_count_regular", C(V.SEQ, _win(4)) + "SELECT name, w AS kmer, count(*) AS cnt FROM win GROUP BY ALL")
def _(spark, sf):
    return kmers.kmer_count_regular(V.sequences(spark, sf), 4)


@query(
    "kmer_count_decreasing",
    C(V.SEQ, _win(2, name="w2"), _win(3, name="w3"))
    + "SELECT name, w AS kmer, count(*) AS cnt FROM (SELECT * FROM w2 UNION ALL SELECT * FROM w3) GROUP BY ALL",
)
def _(spark, sf):
    return kmers.kmer_count_decreasing(V.sequences(spark, sf), 3)


@query(
    "kmer_count_gapped",
    C(V.SEQ, _win(5))
    + """SELECT name, kmer, count(*) AS cnt FROM (SELECT name, substr(w, 1, 1) || substr(w, 3) AS kmer FROM win
  UNION ALL SELECT name, substr(w, 1, 2) || substr(w, 4) FROM win) GROUP BY ALL""",
)
def _(spark, sf):
    return kmers.kmer_count_gapped(V.sequences(spark, sf), 5, 1)


@query(
    "kmer_count_mismatch",
    C(V.SEQ, _win(4))
    + """SELECT name, kmer, count(*) AS cnt FROM (SELECT name, substr(w, 1, 1) || 'X' || substr(w, 3) AS kmer FROM win
  UNION ALL SELECT name, substr(w, 1, 2) || 'X' || substr(w, 4) FROM win) GROUP BY ALL""",
)
def _(spark, sf):
    return kmers.kmer_count_mismatch(V.sequences(spark, sf), 4, 1)


@query(
    "kmer_count_by_region",
    C(
        V.SEQ,
        V.REGCH,
        _win(3),
        """hit AS (SELECT w.name, w.i, w.w, r.region,
  least(r."end", w.i + 2) - greatest(r."start", w.i - 1) AS ov
  FROM win w JOIN regch r ON w.name = r.name AND r."start" < w.i + 2 AND r."end" > w.i - 1)""",
        "best AS (SELECT *, row_number() OVER (PARTITION BY name, i ORDER BY ov DESC, region) AS rn FROM hit)",
    )
    + "SELECT name, w || '_' || region AS kmer, count(*) AS cnt FROM best WHERE rn = 1 GROUP BY ALL",
)
def _(spark, sf):
    return kmers.kmer_count_by_region(V.sequences(spark, sf), V.region_channels(spark, sf), 3)


@query(
    "kmer_count_vocab",
    C(V.SEQ, V.BENCH, _win(4), _win(4, "bench", name="bw"))
    + "SELECT name, w AS kmer, count(*) AS cnt FROM win WHERE w IN (SELECT w FROM bw) GROUP BY ALL",
)
def _(spark, sf):
    vocab = kmers.kmer_vocabulary(V.benchmark_sequences(spark, sf), 4)
    return kmers.kmer_count_vocab(V.sequences(spark, sf), vocab, 4)


@query(
    "sequence_composition",
    C(V.SEQ, _win(3))
    + "SELECT w AS kmer, count(*) AS cnt, count(*) / sum(count(*)) OVER () AS fraction FROM win GROUP BY w",
    floats="fraction",
)
def _(spark, sf):
    return kmers.sequence_composition(V.sequences(spark, sf), 3)


@query(
    "codon_composition",
    C(V.SEQ, _win(3, step=3))
    + "SELECT w AS kmer, count(*) AS cnt, count(*) / sum(count(*)) OVER () AS fraction FROM win GROUP BY w",
    floats="fraction",
)
def _(spark, sf):
    return kmers.codon_composition(V.sequences(spark, sf))


@query(
    "compare_compositions",
    C(
        V.SEQ,
        V.BENCH,
        _win(3),
        _win(3, "bench", name="bw"),
        "a AS (SELECT w AS kmer, count(*) / sum(count(*)) OVER () AS fraction_a FROM win GROUP BY w)",
        "b AS (SELECT w AS kmer, count(*) / sum(count(*)) OVER () AS fraction_b FROM bw GROUP BY w)",
    )
    + "SELECT kmer, fraction_a, fraction_b FROM a JOIN b USING (kmer)",
    floats="fraction_a fraction_b",
)
def _(spark, sf):
    return kmers.compare_compositions(
        kmers.sequence_composition(V.sequences(spark, sf), 3),
        kmers.sequence_composition(V.benchmark_sequences(spark, sf), 3),
    )


@query(
    "triplet_transition_probs",
    C(
        V.SEQ,
        _win(3),
        "f AS (SELECT w AS kmer, count(*) / sum(count(*)) OVER () AS fraction FROM win GROUP BY w)",
        """j AS (SELECT a.kmer AS triplet, substr(b.kmer, 3, 1) AS next_base, b.fraction AS f
  FROM f a JOIN f b ON substr(a.kmer, 2, 2) = substr(b.kmer, 1, 2))""",
    )
    + "SELECT triplet, next_base, f / sum(f) OVER (PARTITION BY triplet) AS p FROM j",
    floats="p",
)
def _(spark, sf):
    return kmers.triplet_transition_probs(kmers.sequence_composition(V.sequences(spark, sf), 3))


@query(
    "reverse_complement",
    C(V.SEQ) + "SELECT name, translate(reverse(seq), 'ACGT', 'TGCA') AS seq FROM seqs",
)
def _(spark, sf):
    return seqops.reverse_complement(V.sequences(spark, sf))


_CHARS = "chars AS (SELECT name, seq, length(seq) AS n, CAST(i - 1 AS INTEGER) AS i, substr(seq, i, 1) AS base FROM (SELECT name, seq, unnest(range(1, length(seq) + 1)) AS i FROM seqs))"


@query(
    "onehot",
    C(V.SEQ, _CHARS, "top AS (SELECT max(length(seq)) AS len FROM seqs)")
    + "SELECT name, CAST((len - n) // 2 + i AS INTEGER) AS pos, base FROM chars, top",
)
def _(spark, sf):
    return seqops.onehot_long(V.sequences(spark, sf), "center")


@query(
    "onehot_dense",
    C(V.SEQ, _CHARS)
    + """SELECT name, coalesce(string_agg(CAST(CAST(base = 'A' AS INT) AS VARCHAR) || CAST(CAST(base = 'C' AS INT) AS VARCHAR)
  || CAST(CAST(base = 'G' AS INT) AS VARCHAR) || CAST(CAST(base = 'T' AS INT) AS VARCHAR), '|' ORDER BY i), '') AS onehot
  FROM (SELECT s.name, c.i, c.base FROM seqs s JOIN chars c USING (name)) GROUP BY name
  UNION ALL SELECT name, '' FROM seqs WHERE length(seq) = 0""",
)
def _(spark, sf):
    dense = seqops.onehot(V.sequences(spark, sf))
    rows = F.transform("onehot", lambda r: F.array_join(F.transform(r, lambda x: x.cast("string")), ""))
    return dense.select("name", F.array_join(rows, "|").alias("onehot"))


@query(
    "add_region_channels",
    C(V.SEQ, V.REGCH, _CHARS)
    + """SELECT name, i AS pos, base FROM chars UNION ALL
  SELECT name, CAST(unnest(range(CAST("start" AS BIGINT), CAST("end" AS BIGINT))) AS INTEGER), region FROM regch WHERE name IN (SELECT name FROM chars)""",
)
def _(spark, sf):
    seqs = V.sequences(spark, sf)
    reg = V.region_channels(spark, sf)
    positions = reg.select("name", "region", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))
    return seqops.add_region_channels(seqops.onehot_long(seqs), positions)


@query("split_seqlets", C(V.SEQ, _win(8)) + 'SELECT name, CAST(i - 1 AS INTEGER) AS "start", w AS seqlet FROM win')
def _(spark, sf):
    return seqops.split_seqlets(V.sequences(spark, sf), 8)


@query("unique_seqlets", C(V.SEQ, _win(6)) + "SELECT DISTINCT w AS seqlet FROM win")
def _(spark, sf):
    return seqops.unique_seqlets(seqops.split_seqlets(V.sequences(spark, sf), 6))


@query(
    "realign_or_shift",
    C(V.SEQ, 'sh AS (SELECT unnest([-3, 0, 2]) AS "shift")')
    + """SELECT name, "shift", CASE WHEN "shift" >= 0 THEN repeat('N', least("shift", length(seq))) || substr(seq, 1, greatest(length(seq) - "shift", 0))
  ELSE substr(seq, least(-"shift", length(seq)) + 1) || repeat('N', least(-"shift", length(seq))) END AS seq FROM seqs, sh""",
)
def _(spark, sf):
    return seqops.shifted_copies(V.sequences(spark, sf), [-3, 0, 2])


@query(
    "realign_right",
    C(V.SEQ)
    + "SELECT name, rpad(seq, 6000, 'N') || lpad(seq, 6000, 'N') AS seq FROM seqs WHERE length(seq) <= 6000",
)
def _(spark, sf):
    return seqops.realign_right(seqops.filter_or_cut_length(V.sequences(spark, sf), 6000), 6000)


@query(
    "zero_flanks",
    C(V.SEQ)
    + """SELECT name, repeat('N', l) || substr(seq, l + 1, length(seq) - l - r) || repeat('N', r) AS seq FROM (
  SELECT *, least(4, length(seq) - l) AS r FROM (SELECT *, least(3, length(seq)) AS l FROM seqs))""",
)
def _(spark, sf):
    return V.sequences(spark, sf).select("name", S.zero_flanks(F.col("seq"), 3, 4).alias("seq"))


@query(
    "mask_positions",
    C(V.SEQ)
    + """SELECT name, CAST(m AS INTEGER) AS mask_start, substr(seq, 1, m) || repeat('N', least(20, length(seq) - m)) || substr(seq, m + 21) AS seq
  FROM (SELECT name, seq, unnest(range(0, length(seq), 100)) AS m FROM seqs WHERE length(seq) > 0)""",
)
def _(spark, sf):
    return seqops.masked_copies(V.sequences(spark, sf), 20, 100)


@query("filter_or_cut_length", C(V.SEQ) + "SELECT name, substr(seq, 1, 200) AS seq FROM seqs")
def _(spark, sf):
    return seqops.filter_or_cut_length(V.sequences(spark, sf), 200, cut=True)


@query("filter_length", C(V.SEQ) + "SELECT name, seq FROM seqs WHERE length(seq) <= 300")
def _(spark, sf):
    return seqops.filter_or_cut_length(V.sequences(spark, sf), 300)


@query(
    "combine_onehot_files",
    C(V.SEQ, V.BENCH) + "SELECT name, a.seq || b.seq AS seq FROM seqs a JOIN bench b USING (name)",
)
def _(spark, sf):
    return seqops.combine_sequences([V.sequences(spark, sf), V.benchmark_sequences(spark, sf)])


@query(
    "replay_edits",
    C(V.SEQ)
    + """SELECT name, CASE WHEN length(seq) >= 12 THEN 'TT' || substr(seq, 2, 1) || 'G' || substr(seq, 5, 4) || 'A' || substr(seq, 10) ELSE seq END AS seq FROM seqs""",
)
def _(spark, sf):
    seqs = V.sequences(spark, sf)
    # short sequences have no edits; the others at 0 (one letter to two), 3 (two letters to one) and 8, positions in the edited text
    log = seqs.select(
        "name",
        F.when(F.length("seq") < 12, "").otherwise(F.concat(
            F.lit("0,"), F.substring("seq", 1, 1), F.lit("/TT;3,"), F.substring("seq", 3, 2), F.lit("/G;8,"),
            F.substring("seq", 9, 1), F.lit("/A"),
        )).alias("edits"),
    )
    return seqops.replay_edits(seqs, log)


@query(
    "exact_motif_scan",
    C(
        V.SEQ,
        V.BENCH,
        """words AS (SELECT name AS motif, substr(seq, 1, 6) AS word, '+' AS strand FROM bench WHERE length(seq) >= 6
  UNION ALL SELECT name, translate(reverse(substr(seq, 1, 6)), 'ACGT', 'TGCA'), '-' FROM bench WHERE length(seq) >= 6)""",
        _win(6),
        """hits AS (SELECT h.name, motif, strand, i - 1 AS s, substr(seq, 1, i - 1) AS l, substr(seq, i + 6) AS r, CASE strand WHEN '+' THEN 'TA' ELSE 'TA' END AS c
  FROM win h JOIN words ON w = word JOIN seqs USING (name))""",
    )
    + """SELECT name, motif, strand, CAST(s AS INTEGER) AS "start", CAST(s + 6 AS INTEGER) AS "end",
  CAST(length(l) - length(regexp_replace(l, '(TA)+$', '')) + length(r) - length(regexp_replace(r, '^(TA)+', '')) AS INTEGER) AS context_bases FROM hits""",
)
def _(spark, sf):
    b = V.benchmark_sequences(spark, sf).filter(F.length("seq") >= 6)
    words = b.select(F.col("name").alias("motif"), F.substring("seq", 1, 6).alias("word"), F.lit("TA").alias("context"))
    return seqops.exact_motif_scan(V.sequences(spark, sf), words)
