from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandframe.functions import sequence as S
from strandframe.operators import kmers, seqdist, seqops


def frame(spark, seqs):
    return spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(seqs)], "name string, seq string")


EDGE = ["", "A", "ACGT", "acgt", "ACNGTAC", "TTTTTTTT", "ACGTACGTAC"]


def test_reverse_complement_twice(spark):
    df = frame(spark, EDGE)
    twice = df.select("seq", S.reverse_complement(S.reverse_complement(F.col("seq"))).alias("x")).filter("seq <> x")
    assert twice.count() == 0


def test_kmer_totals(spark):
    out = kmers.kmer_count_regular(frame(spark, EDGE), 3).groupBy("name").agg(F.sum("cnt").alias("n")).collect()
    assert {r["name"]: r["n"] for r in out} == {"s2": 2, "s4": 2, "s5": 6, "s6": 8}


def test_gapped_and_mismatch_words(spark):
    df = frame(spark, ["ACGTA"])
    assert {r["kmer"] for r in kmers.kmer_count_gapped(df, 5, 1).collect()} == {"AGTA", "ACTA"}
    assert {r["kmer"] for r in kmers.kmer_count_mismatch(df, 4, 1).collect()} == {"AXGT", "ACXT", "CXTA", "CGXA"}


def test_region_majority(spark):
    df = frame(spark, ["ACGTAC"])
    reg = spark.createDataFrame([("s0", "x", 0, 2), ("s0", "y", 2, 6)], "name string, region string, start int, end int")
    got = {r["kmer"] for r in kmers.kmer_count_by_region(df, reg, 3).collect()}
    assert got == {"ACG_x", "CGT_y", "GTA_y", "TAC_y"}


def test_shift_mask_edits(spark):
    df = frame(spark, ["ACGTAC"])
    got = {r["shift"]: r["seq"] for r in seqops.shifted_copies(df, [-2, 0, 9]).collect()}
    assert got == {-2: "GTACNN", 0: "ACGTAC", 9: "NNNNNN"}
    log = spark.createDataFrame([("s0", "1,C/T;4,A/GG")], "name string, edits string")
    assert seqops.replay_edits(df, log).first()["seq"] == "ATGTGGC"


def test_onehot_align(spark):
    df = frame(spark, ["AC", "ACGT", "N"])
    right = {(r["name"], r["pos"]): r["base"] for r in seqops.onehot_long(df, "right").collect()}
    assert right[("s0", 2)] == "A" and right[("s0", 3)] == "C" and ("s2", 3) not in right
    both = [r for r in seqops.onehot_long(df, "bidirectional").collect() if r["name"] == "s0"]
    assert sorted(r["pos"] for r in both) == [0, 1, 26, 27]


def test_exact_scan_context(spark):
    df = frame(spark, ["TATAGGGTATATAC"])
    words = spark.createDataFrame([("m", "GGG", "TA")], "motif string, word string, context string")
    got = [tuple(r) for r in seqops.exact_motif_scan(df, words).select("strand", "start", "end", "context_bases").collect()]
    assert got == [("+", 4, 7, 10)]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("ACG", max_size=9), min_size=2, max_size=25, unique=True))
def test_edit_pairs_equal_all_pairs(spark, seqs):
    got = {(r["a"], r["b"]): r["distance"] for r in seqdist.pairwise_sequence_distance(frame(spark, seqs), 2).collect()}
    names = {f"s{i}": s for i, s in enumerate(seqs)}
    want = {(a, b): edit(names[a], names[b]) for a in names for b in names if a < b}
    assert got == {k: v for k, v in want.items() if v <= 2}


def test_copies_do_not_make_pairs(spark):
    df = frame(spark, ["ACGTACGT"] * 50 + ["ACGTACGA"])
    assert seqdist.pairwise_sequence_distance(df, 1).count() == 1
    assert {r["n"] for r in seqdist.copies(df).collect()} == {1, 50}


def test_nearest_own_counts_copies(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.0, 0.0]), ("c", [3.0, 4.0])], "name string, vec array<double>")
    got = {r["name"]: r["distance"] for r in seqdist.nearest_distances(df).collect()}
    assert got == {"a": 0.0, "b": 0.0, "c": 5.0}
