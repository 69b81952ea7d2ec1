import numpy as np
import pytest

from strandframe.operators import genome as G
from strandframe.operators import intervals as I


@pytest.fixture(scope="module")
def random_sets(spark):
    rng = np.random.default_rng(5)
    a = [(c, int(s), int(s + rng.integers(1, 60))) for c in "xy" for s in rng.integers(0, 400, 40)] + [("x", 100, 101)] * 20
    b = [(f"r{i}", c, int(s), int(s + rng.integers(1, 90))) for i, (c, s) in enumerate((c, s) for c in "xyz" for s in rng.integers(0, 400, 12))]
    return a, b


def test_overlap_join_is_complete_and_unique(spark, random_sets):
    a, b = random_sets
    left = spark.createDataFrame([(i, *r) for i, r in enumerate(a)], "id long, contig string, start long, end long")
    right = spark.createDataFrame(b, "name string, chrom string, start long, end long")
    got = sorted((r["id"], r["name"]) for r in I.overlap_join(left, right, 16).collect())
    want = sorted((i, n) for i, (c, s, e) in enumerate(a) for n, c2, s2, e2 in b if c == c2 and s < e2 and s2 < e)
    assert got == want


def test_touching_intervals_do_not_overlap(spark):
    left = spark.createDataFrame([("x", 0, 10)], "contig string, start long, end long")
    right = spark.createDataFrame([("r", "x", 10, 20)], "name string, chrom string, start long, end long")
    assert I.overlap_join(left, right, 8).count() == 0


def test_covered_bases(spark, random_sets):
    a, _ = random_sets
    df = spark.createDataFrame(a, "chrom string, start long, end long")
    got = {r["chrom"]: r["bases"] for r in I.covered_bases(df, 32).collect()}
    assert got == {c: len({p for c2, s, e in a if c2 == c for p in range(s, e)}) for c in "xy"}


def test_fragment_modes(spark):
    reads = spark.createDataFrame(
        [("x", 10, 15, 40, False, True), ("x", 45, 50, -40, True, True), ("x", 10, 15, 40, False, True)],
        "contig string, start long, end long, tlen long, reverse boolean, proper boolean",
    )
    frags = I.fragments(reads, shift=(0, 0))
    assert [tuple(r) for r in frags.select("start", "end", "n").collect()] == [(10, 50, 2)]
    reg = spark.createDataFrame([("r", "x", 0, 30)], "name string, chrom string, start long, end long")
    assert {(r["offset"], r["count"]) for r in I.count_cuts_in_regions(frags, reg).collect()} == {(10, 2)}
    entire = I.count_cuts_in_regions(frags, reg, "entire").collect()
    assert sorted(r["offset"] for r in entire) == list(range(10, 30)) and {r["count"] for r in entire} == {2}
    frac = I.count_cuts_in_regions(frags, reg, "entirefraction").collect()
    assert {round(r["count"], 9) for r in frac} == {0.05}
    three = I.count_cuts_in_regions(I.fragments(reads, "read", shift=(0, 0)), reg, "3").collect()
    assert {(r["offset"], r["count"]) for r in three} == {(14, 2)}


def test_introns(spark):
    t = spark.createDataFrame([("g", "t1", 1, 100), ("g", "t2", 1, 100)], "gene string, transcript string, start long, end long")
    e = spark.createDataFrame(
        [("t1", 1, 20), ("t1", 50, 100), ("t2", 11, 30), ("t2", 60, 90)], "transcript string, start long, end long"
    )
    introns = I.derive_introns(t, e)
    assert {tuple(r) for r in introns.collect()} == {("t1", 21, 49), ("t2", 1, 10), ("t2", 31, 59), ("t2", 91, 100)}
    const = {(r["transcript"], r["start"], r["end"]) for r in I.constitutive_introns(t, introns).collect()}
    assert const == {("t1", 31, 49), ("t2", 31, 49)}


def test_region_sequences_across_chunks(spark):
    chroms = spark.createDataFrame([("c", "ACGTACGTAC")], "chrom string, seq string")
    chunks = G.genome_chunks(chroms, 4)
    reg = spark.createDataFrame(
        [("a", "c", 2, 7, "+"), ("b", "c", 0, 2, "-"), ("d", "c", 8, 12, "+"), ("m", "nope", 0, 3, "+")],
        "name string, chrom string, start long, end long, strand string",
    )
    got = {r["name"]: r["seq"] for r in G.extract_region_sequences(reg, chunks, flank=1, size=4).collect()}
    assert got == {"a": "CGTACGT", "b": "NACG", "d": "TACNNN", "m": "NNNNN"}
    tss = {r["name"]: r["seq"] for r in G.extract_region_sequences(reg.filter("name = 'b'"), chunks, flank=2, from_tss=True, size=4).collect()}
    assert tss == {"b": "ACGT"}


def _profile_by_hand(intervals, regions):
    """Sum of v on every base of a region that an interval covers."""
    out = {}
    for name, c, a, b in regions:
        for c2, s, e, v in intervals:
            for p in range(max(a, s), min(b, e)) if c == c2 else ():
                out[name, p - a] = out.get((name, p - a), 0) + v
    return out


def test_signal_on_repeated_and_empty_regions(spark):
    rng = np.random.default_rng(8)
    sig = [("x", int(s), int(s + rng.integers(1, 30)), float(rng.integers(1, 9))) for s in rng.integers(0, 200, 60)] + [("x", 4, 9, float("nan")), ("x", 3, 3, 2.0)]
    reg = [(f"r{i % 9}", "x", int(s), int(s + 1 + rng.integers(0, 70))) for i, s in enumerate(rng.integers(0, 180, 14))] + [("same", "x", 10, 40)] * 2 + [("none", "x", 20, 20), ("other", "y", 0, 50)]
    df = spark.createDataFrame(sig, "chrom string, start long, end long, value double")
    r = spark.createDataFrame(reg, "name string, chrom string, start long, end long")
    want = _profile_by_hand([x for x in sig if x[3] == x[3]], reg)
    for by_name in (False, True):
        got = {(x["name"], x["offset"]): x["value"] for x in I.signal_over_regions(df, r, 16, by_name).collect()}
        assert got == want


def test_entire_leaves_out_spanning_fragments(spark):
    rng = np.random.default_rng(9)
    frags = sorted({("x", int(s), int(s + rng.integers(1, 60))) for s in rng.integers(0, 150, 80)})
    reg = [(f"r{i}", "x", int(s), int(s + 1 + rng.integers(0, 40))) for i, s in enumerate(rng.integers(0, 150, 12))]
    reg += [("r3", "x", 60, 66), ("twin", "x", 70, 75), ("twin", "x", 70, 75)]
    f = spark.createDataFrame([(c, s, e, False, e - s, 2) for c, s, e in frags], "contig string, start long, end long, reverse boolean, length long, n long")
    r = spark.createDataFrame(reg, "name string, chrom string, start long, end long")
    for mode, weight in (("entire", lambda s, e: 2), ("entirefraction", lambda s, e: 2 / (e - s))):
        want = {}
        for name, c, a, b in reg:
            inside = [(c, s, e, weight(s, e)) for _, s, e in frags if a <= s < b or a <= e <= b]
            for k, v in _profile_by_hand(inside, [(name, c, a, b)]).items():
                want[k] = want.get(k, 0) + v
        got = {(x["name"], x["offset"]): x["count"] for x in I.count_cuts_in_regions(f, r, mode, 16).collect()}
        assert got == pytest.approx(want)


def test_pool_tracks_of_one_track_needs_no_sum(spark):
    reg = spark.createDataFrame([("a", "x", 0, 8), ("b", "x", 2, 10)], "name string, chrom string, start long, end long")
    sig = spark.createDataFrame([("x", 0, 6, 3.0), ("x", 4, 9, 2.0)], "chrom string, start long, end long, value double")
    p = I.signal_over_regions(sig, reg, by_name=True).selectExpr("*", "'t' AS track")
    rows = [sorted(map(tuple, I.pool_tracks(p, ["t"], 8, 1, one_row=one).collect())) for one in (False, True)]
    assert rows[0] == rows[1] and len(rows[0]) == 12


@pytest.mark.parametrize("mode", ["union", "strict"])
def test_reads_in_features_by_brute_force(spark, mode):
    rng = np.random.default_rng(10)
    reads = [(c, int(s), int(s + rng.integers(1, 40))) for c in "xy" for s in rng.integers(0, 300, 150)] + [("x", 30, 30), ("x", 40, 38), (None, 3, 20), ("x", None, 9)]
    feats = [(f"g{i % 17}", c, int(s), int(s + rng.integers(1, 70))) for c in "xy" for i, s in enumerate(rng.integers(0, 300, 25))]
    feats += [(None, "x", 0, 90), ("g1", None, 0, 90), ("g2", "x", 50, 45)]
    want = {}
    for c, s, e in reads:
        if c is None or s is None:
            continue
        ov = [(g, min(e, b) - max(s, a)) for g, c2, a, b in feats if c == c2 and s < b and a < e]
        genes = {g for g, o in ov if (o >= 5 if mode == "union" else o == e - s)} - {None}
        if len(genes) == 1:
            want[*genes] = want.get((*genes,), 0) + 1
    r = spark.createDataFrame(reads, "contig string, start long, end long")
    f = spark.createDataFrame(feats, "gene string, chrom string, start long, end long")
    assert {(x["gene"],): x["count"] for x in I.count_reads_in_features(r, f, mode, size=32).collect()} == want


def test_no_rows_for_pairs_of_intervals(spark):
    """A pile of different reads under a pile of regions costs their number, not their product."""
    df = lambda n, cols: spark.range(n).selectExpr(*cols)
    reg = df(1500, ["concat('r', id) AS name", "'x' AS chrom", "id % 7 AS start", "2000 + id AS end"])
    reads = df(1500, ["'x' AS contig", "100 + id % 40 AS start", "160 + id AS end"])
    for frame in (
        I.count_reads_in_features(reads, reg.withColumnRenamed("name", "gene")),
        I.count_reads_in_features(reads, reg.withColumnRenamed("name", "gene"), "strict"),
        I.signal_over_regions(reads.selectExpr("contig AS chrom", "start", "end", "1D AS value"), reg).groupBy("name").count(),
    ):
        frame.collect()
        assert max(_join_rows(frame._jdf.queryExecution().executedPlan())) <= 10_000


def _join_rows(plan):
    """Rows that the joins of an executed plan gave, 0 at least."""
    rows, todo = [0], [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        if "Join" in name:
            rows.append(p.metrics().apply("numOutputRows").value())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return rows
