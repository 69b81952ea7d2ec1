"""Stages of the pipeline, each on its own input, against versions written out in plain Python."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline

BREAK = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, kept boolean"


def words(text):
    return [w for w in BREAK.split(text or "") if w]


def passes_rules(text):
    text, w = text or "", words(text)
    n, chars = len(w), sum(map(len, w))
    windows = Counter(zip(w, w[1:], w[2:]))
    repeated = {k + d for k, g in enumerate(zip(w, w[1:], w[2:])) if windows[g] > 1 for d in (0, 1, 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return not (
        n < 50 or 100 * len(repeated) > 50 * n or 10 * len(re.findall(r"[#*$%&|<>]", text)) > n
        or 100 * sum(c.isupper() for c in text) > 40 * chars or 100 * (len(lines) - len(set(lines))) > 50 * len(lines) or not 2 * n <= chars <= 20 * n
    )


def without_boilerplate(rows):
    norm = lambda line: re.sub(r"[\x20\x09\x0B-\x0D]+", " ", line).lower().strip(" ")
    sites, first = defaultdict(set), {}
    for i, text, source in rows:
        for line in (text or "").split("\n"):
            sites[norm(line)].add(source)
            first[norm(line)] = min(i, first.get(norm(line), i))
    marked = {x for x, s in sites.items() if x and len(s) >= 10}
    out = {}
    for i, text, _ in rows:
        kept = None if text is None else "\n".join(x for x in text.split("\n") if norm(x) not in marked or first[norm(x)] == i)
        if kept == text or words(kept):
            out[i] = kept
    return out


def one_of_each_group(texts):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if (w := words(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))) else set() for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            where[g].add(i)
    for i, s in sets.items():
        for j in set().union(*(where[g] for g in s)) if s else ():
            if j < i and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) == i}


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(stage(spark, tables[-1], sf).cache())
    return tables


def by_id(table):
    rows = table.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: r for r in rows}


def test_quality_stage(stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    assert set(after) == {i for i, r in before.items() if passes_rules(r.text)} and all(after[i] == before[i] for i in after)


def test_line_stage(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    want = without_boilerplate([(i, r.text, r.source) for i, r in before.items()])
    assert {i: r.text for i, r in after.items()} == want
    assert all(r.n_chars == len(r.text) for i, r in after.items() if r.text != before[i].text)


def test_near_duplicate_stage(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    assert set(after) == one_of_each_group({i: r.text for i, r in before.items()})


def test_benchmark_stage(spark, sf, stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = lambda w: {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
    items = [plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    long = set().union(*map(runs, items))
    eight = {tuple(w[k : k + 8]) for w in items for k in range(max(len(w) - 7, 1))}
    for i, r in before.items():
        w = plain(r.text)
        if runs(w) & long:
            assert i not in after, i  # thirteen words in a row
        if i not in after:
            short = {tuple(w[k : k + m]) for m in {len(x) for x in eight} for k in range(len(w) - m + 1)}
            assert short & eight, i  # nothing goes without a window of an item


def test_packing_stage(spark, sf, stages):
    before = by_id(stages[4])
    bins, got = defaultdict(list), Counter()
    for r in corpus_pipeline.run(spark, sf).collect():
        bins[r.bin_id].append((r.offset, r.n_tokens))
        got[r.doc_id] += r.n_tokens
    assert got == {i: len(words(r.text)) + 1 for i, r in before.items()}
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 4096


def test_stages_on_empty_tables_and_clashing_columns(spark, sf):
    text = " ".join(f"word{k}" for k in range(60))
    rows = spark.createDataFrame([(1, text, "en", "s", 1, "r", "k", True), (1, text, "en", "s", 1, "r", "k", True), (None, text + " more", None, None, None, None, None, None), (2, None, "en", "s", 1, "r", "k", False)], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf)
        assert out.columns == rows.columns and stage(spark, rows.limit(0), sf).count() == 0
        assert all(r.text and r.row in ("r", None) for r in out.collect() if r.doc_id != 2)
    assert corpus_pipeline.STAGES[-1][1](spark, rows, sf).count() == 4
    assert corpus_pipeline.STAGES[-1][1](spark, rows.limit(0), sf).count() == 0
