"""Runs by grammar compression against the definition written out."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from strandframe.llm.periodic_runs import find_runs, kept_words, periodic_runs, repaired
from strandframe.llm.queries import QUERIES
from test_llm_operators import LONG, ODD, docs_of


def plain_runs(w, min_length=6, min_exponent=4):
    out = {}
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_exponent * q) and j > i:
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def random_words(rng):
    w = []
    for _ in range(rng.randrange(8)):
        unit = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.randrange(1, 12))]
        w += (unit * rng.randrange(1, 9))[: rng.randrange(1, 60)]
    return w * rng.randrange(1, 7) if rng.random() < 0.3 else w


def test_runs_equal_the_definition():
    rng = random.Random(5)
    for _ in range(120):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 20))]
        assert find_runs(texts) == [plain_runs(t) for t in texts]
    texts = [random_words(rng) for _ in range(40)]
    assert find_runs(texts, 12, 6) == [plain_runs(t, 12, 6) for t in texts]
    with pytest.raises(ValueError):
        find_runs([["a"]], 6, 3)


def test_hard_words():
    morse, fib = ["a"], ["a", "b"]
    for _ in range(9):
        morse = morse + [{"a": "b", "b": "a"}[c] for c in morse]
        fib = [x for c in fib for x in ({"a": ["a", "b"], "b": ["a"]}[c])]
    blocks = (["a"] * 30 + ["b"]) * 12
    nested = ((["x", "y"] * 5 + ["z"]) * 6 + ["w"]) * 5
    texts = [morse, fib, blocks, nested, ["a"] * 700, ["a", "b"] * 300 + ["a"] * 9, [], ["a"]]
    assert find_runs(texts) == [plain_runs(t) for t in texts]


def test_grammar_spells_the_words_and_leaves_no_pair_twice():
    rng = random.Random(8)
    texts = [random_words(rng) for _ in range(30)]
    ids, owner, base = [], [], 0
    for k, t in enumerate(texts):
        own = {w: base + i for i, w in enumerate(dict.fromkeys(t))}
        base += len(own)
        ids += [own[w] for w in t]
        owner += [k] * len(t)
    g = repaired(np.array(ids), np.array(owner))

    def spell(s):
        return [s] if s < g.base else spell(int(g.left[s - g.base])) + spell(int(g.right[s - g.base]))

    assert [w for s in g.symbols.tolist() for w in spell(s)] == ids
    for k, (a, at) in enumerate(zip(range(g.base, g.base + len(g.left)), g.first.tolist())):
        assert ids[at : at + int(g.size[a])] == spell(a)
    pairs, last = Counter(), None
    for i in range(len(g.symbols) - 1):
        if owner[g.starts[i]] != owner[g.starts[i + 1]]:
            continue
        pair = (int(g.symbols[i]), int(g.symbols[i + 1]))
        if pair == last and pair[0] == pair[1]:
            last = None  # overlaps the one before
            continue
        pairs[pair] += 1
        last = pair
    assert max(pairs.values()) == 1


def test_query_equals_the_definition(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = Counter()
    for r in rows:
        w = (r.text or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w) if n < 1200 else find_runs([w])[0]
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in runs)]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want[r.doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha(lines.encode()), sha(b" ".join(kept))] += 1
    df = QUERIES["op11_periodic_runs"](spark, sf)
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r) for r in df.collect()) == want
    assert sum(k[1] for k in want) > 10


def test_odd_rows(spark):
    ids = [None, 1, 2, 3, 4, 4, 5]
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs_of(spark, ODD, ids)).collect())
    w = [(t or "").split() for t in ODD]
    assert got == sorted((str(i), len(x), plain_runs(x), " ".join(kept_words(x, plain_runs(x)))) for i, x in zip(ids, w))
    assert kept_words(LONG.split(), [(0, 30_000, 1)]) == ["word"]
    assert periodic_runs(docs_of(spark, ["x"]).limit(0)).count() == 0
