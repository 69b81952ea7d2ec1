"""What one task holds, and how often a step is made, where tables are large."""

import re

from pyspark.sql import functions as F

from strandframe.operators import attribution as A
from strandframe.operators import motifs as M
from strandframe.operators import seqops
from strandframe.plans import load_catalog
from strandframe.plans import views as V
from strandframe.sources import text


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_activations_stay_where_they_are(spark):
    rows = [(s, m, float(len(set(s)) * k + i)) for i, s in enumerate(["ACGT", "AACC", "GGTT", "ACAC"]) for k, m in enumerate(["k1", "k2"], 1)]
    act = spark.createDataFrame(rows, "seqlet string, motif string, act double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = M.pwm_from_activations(act, 0.5)
        assert "BroadcastHashJoin" in plan_of(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.motif: round(r.s, 9) for r in out.groupBy("motif", "pos").agg(F.sum("w").alias("s")).collect()} == {"k1": 1.0, "k2": 1.0}


def test_exact_scan_by_brute_force_without_a_row_per_window(spark):
    letters = "TATATAACGTTATAGGGTATATACCCTATA"
    seqs = spark.createDataFrame([("s", letters), ("none", None), ("short", "TA"), (None, "GGGTATA")], "name string, seq string")
    words = [("m1", "GGG", "TA"), ("m2", "ACGT", ""), ("m3", "GGG", None), ("m4", None, "TA"), ("m5", "CCC", "TA")]
    out = seqops.exact_motif_scan(seqs, spark.createDataFrame(words, "motif string, word string, context string"), both_strands=False)
    assert "Generate" not in plan_of(out)
    want = set()
    for name, seq in (("s", letters), ("short", "TA"), (None, "GGGTATA")):
        for motif, word, unit in words:
            for at in range(len(seq)) if word else ():
                if seq.startswith(word, at):
                    right = len(re.match("(TA)*", seq[at + len(word) :])[0]) if unit else 0
                    left = len(re.search("(TA)*$", seq[:at])[0]) if unit else 0
                    want.add((name, motif, at, at + len(word), left + right))
    got = [(r["name"], r.motif, r.start, r.end, r.context_bases) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want


def test_fasta_records_are_made_once(spark):
    records = spark.createDataFrame([(">a\nacgtacgt\nacgt\r\n",), (">b\nacg\n",), ("no line",), (None,)], "value string").distinct()
    out = text.parse_fasta(records)
    assert plan_of(out).count("regexp_replace") == 2
    assert [tuple(r) for r in out.collect()] == [("a", "ACGTACGTACGT")]


def test_masked_copies_are_added_up_where_they_are_made(spark):
    def predict(batch):
        return [[float("nan") if c == "T" else i + (c == "N") * 100.0 for i, c in enumerate(s)] for s in batch]

    seqs = spark.createDataFrame([("a", "ACGACGACGA"), ("b", "TT"), ("b", "AT"), ("c", ""), (None, "ACA")], "name string, seq string")
    out = M.masked_prediction_average(seqs, predict, 3, 2, seed=5)
    assert "Generate" not in plan_of(out)
    got = {(r["name"], r.pos): r.value for r in out.collect()}
    assert len(got) == 10 + 2 + 3
    assert all(got[("a", i)] in (i, i + 100.0) for i in range(10)) and sum(got[("a", i)] >= 100 for i in range(10)) >= 3
    # windows at the start of a short sequence mask all of it
    assert got[(None, 2)] == 102.0 and got[("b", 0)] == 100.0 and got[("b", 1)] == 101.0


def test_model_rows_are_stored_before_they_are_read_again(spark, sf):
    out = load_catalog().QUERIES["linear_predictions"](spark, sf)
    assert not any("documents" in f for f in out.inputFiles())


def test_positions_are_not_shuffled_again(spark, sf):
    dealt = [x for x in plan_of(A.strict_runs(V.profile(spark, sf), 2.0, 1, 4)).splitlines() if "Exchange" in x]
    assert not any("__chunk" in x or "island" in x for x in dealt)


def test_chunks_of_runs_are_stored(spark):
    rows = [(s, "t", i, 3.0 if i % 9 < 5 else 0.1) for s in "ab" for i in range(30)]
    p = spark.createDataFrame(rows, "seq string, track string, pos int, value double")
    for out in (A.find_motif_runs(p, 1.0), A.find_zscore_runs(p, 1.0, 3)):
        assert not any(x in plan_of(out) for x in ("Window", "Join"))


def test_lines_of_an_order_are_dealt_out_once(spark, sf):
    for name in ("feature_length_per_gene", "constitutive_introns"):
        plan = plan_of(load_catalog().QUERIES[name](spark, sf))
        assert "hashpartitioning(l_orderkey" in plan and "REPARTITION_BY_NUM" in plan and "l_linenumber" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
