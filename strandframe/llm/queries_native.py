"""Queries of the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.llm.catalog import query
from strandframe.llm.common import table
from strandframe.llm.line_dedup import dedup_lines
from strandframe.llm.pii import KINDS, sanitise
from strandframe.llm.quality_rules import apply_policy, rule_ledger

WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce('=' || source, '-') AS site, i, raw,
         trim(lower(regexp_replace(raw, '[\x20\x09\x0B-\x0D]+', ' ', 'g')), ' ') AS norm
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw,
               unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)),
marked AS (
  SELECT norm, min(doc_id) AS first_id FROM lines WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT site) >= 10),
kept AS (
  SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.i) FILTER (WHERE m.norm IS NULL OR l.doc_id IS NOT DISTINCT FROM m.first_id) AS text,
         count(*) FILTER (WHERE m.norm IS NOT NULL AND l.doc_id IS DISTINCT FROM m.first_id) AS n_removed
  FROM lines l LEFT JOIN marked m ON l.norm = m.norm GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, d.lang, d.source, d.n_chars,
       coalesce(k.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)"""


@query("op1_line_dedup", LINE_SQL)
def op1(spark, sf):
    return dedup_lines(table(spark, sf, "documents"))


RULE_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS w FROM documents),
grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3))),
rep AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n >= 2) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(regexp_extract_all(t, '\p{{Lu}}'))::BIGINT AS n_upper,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
         (n_lines - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep r ON w.doc_id = r.doc_id),
b AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (100 * n_upper > 40 * word_chars)::BIGINT + 16 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
    + 32 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT)::BIGINT AS fail_bits FROM m)
SELECT *, (fail_bits & 3) <> 0 AS base_failed, 'v2' AS policy, fail_bits = 0 AS kept FROM b"""


@query("op5_quality_rules", RULE_SQL)
def op5(spark, sf):
    ledger = apply_policy(rule_ledger(table(spark, sf, "documents")))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return ledger.withColumn("base_failed", base)


@query("op10_pii")
def op10(spark, sf):
    found = sanitise(table(spark, sf, "documents"))
    labelled = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    terms = F.filter("spans", lambda s: s["rank"] == len(KINDS))
    gone = F.size(F.filter(terms, lambda s: s["mask"] == "[TERM]"))
    treated = [gone.cast("long").alias("n_removed"), (F.size(terms) - gone).cast("long").alias("n_generalised"), F.sha2("clean_text", 256).alias("clean_sha256")]
    return found.select("doc_id", *counts, F.sha2(labelled(base), 256).alias("base_sha256"), labelled(F.col("spans")).alias("spans"), *treated)
