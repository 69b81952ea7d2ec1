import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.functions.special import t_two_sided_np
from strandframe.operators import attribution as A
from strandframe.operators import motifs as M
from strandframe.operators import similarity as SIM


def long(spark, mats):
    rows = [(k, i, "ACGT"[j], float(m[i, j])) for k, m in mats.items() for i in range(len(m)) for j in range(4)]
    return spark.createDataFrame(rows, "motif string, pos int, base string, w double")


@pytest.fixture(scope="module")
def mats():
    """One seed motif and noisy, shifted, partly reverse-complemented copies of other lengths."""
    rng = np.random.default_rng(1)
    seed = np.zeros((12, 4))
    seed[np.arange(12), rng.integers(0, 4, 12)] = 1
    out = {"seed": seed}
    for i in range(10):
        n = int(rng.integers(8, 15))
        m = rng.random((n, 4)) * 0.25
        off = int(rng.integers(-3, 3))
        for p in range(n):
            if 0 <= p + off < 12:
                m[p] += seed[p + off]
        m /= m.sum(1, keepdims=True)
        out[f"m{i}"] = m[::-1, ::-1] if i % 2 else m
    return out


def direct(p, q, metric, min_overlap=4, pad=0.25):
    """Write out both padded matrices for every alignment and take the plain formula."""
    best = None
    for rc in (False, True):
        a = p[::-1, ::-1] if rc else p
        k = min(min_overlap, len(a), len(q))
        for o in range(-(len(a) - k), len(q) - k + 1):
            lo, hi = min(0, o), max(len(q), len(a) + o)
            x, y = np.full((hi - lo, 4), pad), np.full((hi - lo, 4), pad)
            x[o - lo : o - lo + len(a)] = a
            y[-lo : -lo + len(q)] = q
            if metric == "mse":
                s = -((x - y) ** 2).mean()
            elif metric == "cosine":
                s = (x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum())
            else:
                s = np.corrcoef(x.ravel(), y.ravel())[0, 1]
                if metric == "logp":
                    n = x.size
                    t = s * np.sqrt(n - 2) / np.sqrt(max(1 - (s - 1e-7) ** 2, 1e-16))
                    s = np.sign(s) * -np.log10(t_two_sided_np(np.array(t), np.array(n - 1.0)) + 1e-20)
            if best is None or s > best[0] + 1e-12:
                best = (float(s), o, rc)
    return best


@pytest.mark.parametrize("metric", ["correlation", "cosine", "mse"])
def test_alignment_against_written_out_padding(spark, mats, metric):
    m = long(spark, mats)
    for r in SIM.motif_similarity(m, m, metric).collect():
        s, o, rc = direct(mats[r["a"]], mats[r["b"]], metric)
        assert r["dist"] == pytest.approx(-s if metric == "mse" else 1 - s, abs=1e-6)
        assert (r["offset"], r["revcomp"]) == (o, rc)


def test_alignment_by_p_value(spark, mats):
    few = {k: mats[k] for k in list(mats)[1:6]}
    m = long(spark, few)
    for r in SIM.motif_similarity_pvalue(m, m).collect():
        if r["a"] != r["b"]:
            s, o, rc = direct(few[r["a"]], few[r["b"]], "logp")
            assert r["logp"] == pytest.approx(s, rel=1e-6) and (r["offset"], r["revcomp"]) == (o, rc)


def test_blocks_equal_broadcast_and_mirror(spark, mats):
    m = long(spark, mats)
    a = {(r["a"], r["b"]): r for r in SIM.motif_similarity(m, m).collect()}
    b = {(r["a"], r["b"]): r for r in SIM.motif_similarity(m, m, bound=3).collect()}
    assert a.keys() == b.keys() and all(abs(a[k]["dist"] - b[k]["dist"]) < 1e-9 for k in a)
    lengths = spark.createDataFrame([(k, len(v)) for k, v in mats.items()], "motif string, len int")
    half = SIM.motif_similarity(m, m).filter("a < b")
    for r in SIM.mirror_pairs(half, lengths).filter("a > b").collect():
        k = (r["a"], r["b"])
        assert (a[k]["offset"], a[k]["revcomp"]) == (r["offset"], r["revcomp"])


def test_pwm_scan_partial_window(spark):
    w = np.array([[1.0, 0, 0, 0], [0, 2.0, 0, 0]])
    seqs = spark.createDataFrame([("s", "ACGACNA")], "name string, seq string")
    got = {r["window"]: r["score"] for r in M.pwm_scan(seqs, long(spark, {"m": w}), "Max", 4, 4).collect()}
    assert got == {0: 3.0, 1: 0.0}


def test_motifs_of_other_lengths(spark):
    bank = long(spark, {"two": np.array([[1.0, 0, 0, 0], [0, 2.0, 0, 0]]), "five": np.eye(4)[[0, 1, 2, 3, 0]]})
    seqs = spark.createDataFrame([("short", "GAC"), ("long", "ACGTAC"), ("tiny", "A")], "name string, seq string")
    got = {(r["name"], r["motif"]): r["score"] for r in M.pwm_scan(seqs, bank).collect()}
    assert got == {("short", "two"): 3.0, ("long", "two"): 3.0, ("long", "five"): 5.0}
    seqlets = spark.createDataFrame([("ACGTA",), ("CGT",), ("TACGTAT",)], "seqlet string")
    got = {(r["seqlet"], r["motif"]): r["act"] for r in M.kernel_activation(seqlets, bank).collect()}
    assert len(got) == 6 and {k: v for k, v in got.items() if k[1] == "five"} == {("ACGTA", "five"): 5.0, ("CGT", "five"): 3.0, ("TACGTAT", "five"): 5.0}


def test_consensus_of_shifted_copies(spark):
    core = np.eye(4)[[0, 1, 2, 3, 0, 1]]
    mats = {"a": core, "b": core[1:], "c": core[::-1, ::-1]}
    m = long(spark, mats)
    clusters = spark.createDataFrame([(k, 0) for k in mats], "motif string, cluster int")
    pairs = SIM.motif_similarity(m, m, min_overlap=4)
    out = M.consensus_motif(m, clusters, pairs, norm="mean", remove_low=0.05).toPandas()
    wide = out.pivot(index="pos", columns="base", values="w").fillna(0).to_numpy()
    assert np.allclose(wide, core) or np.allclose(wide, core[::-1, ::-1])


def test_iupac_and_kmer(spark):
    m = np.array([[0.5, 0, 0.5, 0], [0.25] * 4, [0, 0.9, 0.1, 0]])
    df = long(spark, {"m": m})
    assert M.motif_to_iupac(df).first()["iupac"] == "RNC"
    assert M.motif_to_kmer(df).first()["kmer"] == "AAC"


def test_mutation_scan_centres(spark):
    df = spark.createDataFrame([("s", "ACA")], "name string, seq string")

    def scorer(s):
        return s.select("name", F.lit("t").alias("track"), F.length(F.regexp_replace("seq", "[^A]", "")).cast("double").alias("score"))

    out = M.mutation_scan(df, scorer).toPandas()
    assert np.allclose(out.groupby("pos")["effect"].sum(), 0)
    assert out[(out.pos == 1) & (out.base == "A")]["effect"].iloc[0] == pytest.approx(0.75)


# ----------------------------------------------------------------------- runs
def profile(spark, seqs):
    rows = [(k, "t", i, float(v)) for k, vs in seqs.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "seq string, track string, pos int, value double")


def runs(spark, v, **kw):
    out = A.find_motif_runs(profile(spark, {"s": v}), **kw).collect()
    return sorted(list(r["positions"]) for r in out)


def test_run_rules(spark):
    # one gap is bridged, two are not
    assert runs(spark, [3, 3, 0, 3, 3, 0, 0, 3, 3, 3, 3], cut=1, max_gap=1, min_size=4, smooth=False) == [[0, 1, 3, 4], [7, 8, 9, 10]]
    # a change of sign inside the gap starts its own run
    assert runs(spark, [3, 3, 3, -3, -3, -3], cut=1, max_gap=1, min_size=3, smooth=False) == [[0, 1, 2], [3, 4, 5]]
    # a weak position whose neighbourhood passes is no gap
    assert runs(spark, [4, 4, 0, 4, 0, 4, 4], cut=1, max_gap=1, min_size=5) == [[0, 1, 3, 5, 6]]
    assert runs(spark, [0, 0, 0], cut=1) == []


def runs_by_rule(v, mean, cut, gap, least):
    """The rule position by position, one run after the other."""
    found, t = [], 0
    while strong := [i for i in range(t, len(v)) if abs(v[i]) > cut]:
        s = np.sign(v[strong[0]])
        members = [i for i in strong if v[i] * s > 0]
        breaks = [i for i in range(strong[0], len(v)) if i not in members and s * mean[i] < cut]
        run = members[:1]
        for q in members[1:]:
            if sum(run[-1] < b < q for b in breaks) > gap:
                break
            run.append(q)
        if len(run) >= least:
            found.append(run)
        behind = [b for b in breaks if b > run[-1]]
        if len(behind) <= gap:
            break
        t = behind[gap] - gap
    return found


def zscore_runs_by_rule(sign, least):
    found, t = [], 0
    while strong := [i for i in range(t, len(sign)) if sign[i]]:
        start = strong[0]
        others = [i for i in range(start, len(sign)) if sign[i] != sign[start]]
        if len(others) < 2:
            break
        one, end = others[:2]
        long = end - 1 - start >= least
        if long:
            found.append([start, end - 1, sign[start]])
        t = end if long else one + 1
    return found


def test_motif_runs_equal_the_rule(spark, monkeypatch):
    """Chunks of 16 positions, smooth and rough profiles with overlapping signs."""
    monkeypatch.setattr(A, "CHUNK", 16)
    rng = np.random.default_rng(2)
    seqs = {f"s{i}": np.round(np.convolve(rng.normal(size=220), np.ones(3), "valid"), 3) for i in range(6)}
    seqs |= {f"r{i}": np.round(rng.normal(size=90) * 2, 3) for i in range(6)}
    total = 0
    for gap, smooth in ((1, True), (2, True), (4, True), (1, False), (0, False)):
        got = A.find_motif_runs(profile(spark, seqs), 1.2, gap, 3, smooth).toPandas()
        for k, v in seqs.items():
            h = gap if smooth else 0
            mean = [v[max(0, i - h) : i + h + 1].mean() for i in range(len(v))]
            want = runs_by_rule(v, mean, 1.2, gap, 3)
            total += len(want)
            assert sorted(list(p) for p in got[got.seq == k]["positions"]) == sorted(want)
    assert total > 100


def test_long_runs_cross_chunks(spark, monkeypatch):
    """One stretch over a hundred chunks: the winner's reach and a run's state go from chunk to chunk."""
    monkeypatch.setattr(A, "CHUNK", 64)
    n = 6_400
    pos = spark.range(n).select(F.lit("s").alias("seq"), F.lit("t").alias("track"), F.col("id").cast("int").alias("pos"))
    mixed = pos.withColumn("value", F.when(F.col("pos") % 3 == 2, -2.0).otherwise(2.0))
    got = [r["positions"] for r in A.find_motif_runs(mixed, 1.0, 1, 1, smooth=False).collect()]
    assert got == [[i for i in range(n) if i % 3 != 2]]
    steps = pos.withColumn("value", F.when(F.col("pos") % 4 == 3, 0.0).otherwise(2.0))
    got = sorted((r["start"], r["end"]) for r in A.find_zscore_runs(steps, 1.0, 3).collect())
    assert got == [(i, i + 6) for i in range(0, n - 8, 8)] + [(n - 8, n - 2)]


def test_zscore_runs_equal_the_rule(spark, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 16)
    rng = np.random.default_rng(4)
    seqs = {f"s{i}": np.convolve(rng.normal(size=300), np.ones(4), "valid") for i in range(4)} | {"r": rng.normal(size=200)}
    got = A.find_zscore_runs(profile(spark, seqs), 1.0, 3).toPandas()
    for k, v in seqs.items():
        z = v / np.sqrt((v**2).mean())
        want = zscore_runs_by_rule([int(np.sign(x)) if abs(x) >= 1.0 else 0 for x in z], 3)
        mine = got[got.seq == k][["start", "end", "direction"]].to_numpy().tolist()
        assert sorted(mine) == sorted(want) and want


def test_seqlets(spark):
    rows = [("s", "t", i, b, 1.0 if (b == "A" and 2 <= i <= 6) else 0.01) for i in range(10) for b in "ACGT"]
    attr = spark.createDataFrame(rows, "seq string, track string, pos int, base string, value double")
    ref = spark.createDataFrame([("s", i, "A") for i in range(10)], "seq string, pos int, base string")
    s = A.extract_seqlets(attr, ref, 1.5, 1, 4).collect()
    assert [(r["name"], r["start"], r["end"], r["max"]) for r in s] == [("s_t_2-6", 2, 6, 1.0)]


def test_motif_sequence_matrix_missing_condition(spark):
    rows = [("c", "s", "x", 3.0), ("c", "s", "x", -5.0), ("c", "s", "y", 1.0), ("c", "q", "z", -2.0)]
    e = spark.createDataFrame(rows, "cluster string, seq string, condition string, effect double")

    def one(stat):
        return {r["seq"]: r["value"] for r in A.motif_sequence_matrix(e, stat).collect()}

    assert one("max") == {"s": 3.0, "q": -2.0}
    assert one("absmax") == {"s": -5.0, "q": -2.0}
    assert one("maxdiff") == {"s": 6.0, "q": 2.0}
    assert one("sum") == {"s": -4.0, "q": -2.0}
    assert one("count") == {"s": 2.0, "q": 1.0}


