import numpy as np
import pytest

from strandframe.operators import attribution as A


def written_out(values, z_cut, min_size):
    """Runs of one sequence: one interruption is bridged, a second one ends the run."""
    z = np.asarray(values) / np.sqrt(np.mean(np.square(values)))
    sign = np.where(np.abs(z) >= z_cut, np.sign(z), 0).astype(int)
    out, t, n = [], 0, len(z)
    while t < n:
        if not sign[t]:
            t += 1
            continue
        s, f = sign[t], t
        while f < n and sign[f] == s:
            f += 1
        e = f + 1
        while e < n and sign[e] == s:
            e += 1
        if e >= n:  # open at the end
            break
        if e - 1 - t >= min_size:
            out.append((t, e - 1, s))
            t = e
        else:
            t = f + 1
    return out


def test_short_sequences_need_no_join_and_no_row_of_a_position(spark, monkeypatch):
    rng = np.random.default_rng(15)
    seqs = {f"s{i}": rng.choice([-2.0, 0.5, 2.0], size=int(rng.integers(1, 300)), p=[0.3, 0.2, 0.5]).tolist() for i in range(12)}
    rows = [(name, "t", i, v) for name, values in seqs.items() for i, v in enumerate(values)]
    profile = spark.createDataFrame(rows, "seq string, track string, pos int, value double")
    with monkeypatch.context() as m:
        m.setattr(A, "_entered", None)  # not reached
        out = A.find_zscore_runs(profile, 1.0, 3)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        got = {tuple(r) for r in out.collect()}
    assert "Join" not in plan and "Window" not in plan
    want = {(name, "t", int(b), int(e), int(s)) for name, values in seqs.items() for b, e, s in written_out(values, 1.0, 3)}
    assert got == want and len(want) > 20


@pytest.mark.parametrize("length", [A.CHUNK - 1, A.CHUNK, A.CHUNK + 1, 2 * A.CHUNK + 5])
def test_short_and_long_sequences_give_the_same_runs(spark, length):
    values = np.random.default_rng(length).choice([-2.0, 0.5, 2.0], size=length, p=[0.2, 0.1, 0.7]).tolist()
    profile = spark.createDataFrame([("a", "t", i, v) for i, v in enumerate(values)] + [("b", "t", i, v) for i, v in enumerate(values[:50])], "seq string, track string, pos int, value double")
    got = sorted((r["start"], r["end"], r["direction"]) for r in A.find_zscore_runs(profile, 1.0, 4).collect() if r["seq"] == "a")
    assert got == written_out(values, 1.0, 4)
