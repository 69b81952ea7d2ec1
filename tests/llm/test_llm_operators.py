"""Text operators against brute force, round trips and hand-made corner cases."""


import math
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

import check
from strandframe.llm.chat_format import format_conversations, locate_turns, marked_template, read_marked, unescape
from strandframe.llm.components import components
from strandframe.llm.decontaminate import contaminated
from strandframe.llm.html_text import extract_main_text, main_blocks
from strandframe.llm.line_dedup import dedup_lines
from strandframe.llm.lm_score import learn, score_texts
from strandframe.llm.near_dup import near_duplicates
from strandframe.llm.packing import best_fit, pack
from strandframe.llm.pii import sanitise
from strandframe.llm.quality_rules import ablations, apply_policy, rule_bit, rule_ledger
from strandframe.llm.queries import QUERIES, SQL
from strandframe.llm.token_file import read_segment, read_token_files, write_segment, write_token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long, t string, id long, h long, row string"
LONG = "word " * 30_000


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k else None, 0, "x", 1, 2, "r") for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


ODD = [None, "", "  \n ", "one", LONG, "one", "a b c d e f"]


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", ["op1_line_dedup", "op5_quality_rules"])
def test_native_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = QUERIES[name](spark, sf)
    mine = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(SQL[name])
    assert mine == check.rows_of([d[0] for d in res.description], res.fetchall())


# ---- line dedup


def test_line_dedup_exact_near_the_threshold(spark):
    rows = [(i, f"Own {i}\n Common  LINE \nother", f"s{i}") for i in range(10)] + [(20 + i, "nine sites\nmine %d" % i, f"s{i}") for i in range(9)]
    rows += [(40, "nine sites", "s1"), (41, None, "s1"), (42, "", None), (None, "common line", "s3")]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].text == "Own 0\n Common  LINE \nother" and got[0].n_removed == 0
    assert all(got[i].text == f"Own {i}" and got[i].n_removed == 2 for i in range(1, 10))
    assert got[20].text == "nine sites\nmine 0" and got[40].text == "nine sites"
    assert got[41].text is None and got[42].text == "" and got[None].text == ""


def test_line_dedup_odd_rows(spark):
    df = docs_of(spark, ODD, [1, 1, None, 2, 3, 2, 5])
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "n_removed"] and out.count() == len(ODD)
    assert dedup_lines(df.limit(0)).count() == 0


# ---- quality rules


def test_ledger_counts_and_ablations(spark):
    rep = "x y z " * 30
    got = {r.doc_id: r for r in rule_ledger(docs_of(spark, [rep, *ODD], range(8))).collect()}
    assert got[0].n_words == 90 and got[0].n_repeat_words == 90 and got[0].fail_bits & rule_bit("repeated_windows")
    assert got[1].n_words == 0 and got[1].fail_bits == rule_bit("few_words")
    assert got[5].n_repeat_words == 30_000
    ledger = spark.createDataFrame([(1, 1), (2, 3), (3, 4), (4, 0), (5, 1)], "doc_id long, fail_bits long")
    rows = {(r.policy, r.rule): r for r in ablations(ledger, {"p": ("few_words", "repeated_windows")}).collect()}
    first = rows["p", "few_words"]
    assert (first.n_docs, first.n_rejected, first.n_hit, first.n_only) == (5, 3, 3, 2)
    assert rows["p", "repeated_windows"].n_only == 0
    assert [r.kept for r in apply_policy(ledger, "v1").orderBy("doc_id").collect()] == [False, False, True, True, False]
    assert rule_ledger(docs_of(spark, ["x"]).limit(0)).count() == 0


# ---- personal data


def test_repeated_windows_among_equal_hash_bits(spark):
    # two windows whose hashes agree in the low 40 bits, the other one between two copies of the first
    seed, known = xxhash.xxh64_intdigest(b"b", xxhash.xxh64_intdigest(b"a", 42)), {}
    for k in range(8_000_000):
        at = xxhash.xxh64_intdigest(b"%d" % k, seed) & ((1 << 40) - 1)
        if at in known:
            break
        known[at] = k
    x, y = known[at], k
    assert x != y
    texts = [f"a b {x} a b {y} a b {x}", f"a b {y} a b {x} a b {y}", f"a b {x} a b {y}"]
    got = {r.doc_id: r.n_repeat_words for r in rule_ledger(docs_of(spark, texts)).collect()}
    assert got == {0: 6, 1: 6, 2: 0}


def base_spans(t):
    out = []
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]
    for rank, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            odd = sum(int(c) for c in digits[::-1][::2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[::-1][1::2])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card" and (not 12 <= len(digits) <= 19 or odd % 10):
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_base_spans(spark, texts):
    hard = [
        "é a.b@c.d.e_f@g.h 1.2.3.4.5 999.1.1.1 x", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (743) 555-3824 +12 1.2.3.4", "a@b a@b.c.@d.e",
        "1" * 20_000, "1 " * 20_000, "a" * 50_000 + "@x.y", None, "", "00000000000000000000001.2.3.4",
    ]
    every = [*texts.values(), *hard]
    got = {r.doc_id: r for r in sanitise(docs_of(spark, every)).collect()}
    for i, t in enumerate(every):
        assert [(s.start, s.rank, s.kind, s.end) for s in got[i].spans if s.kind != "term"] == base_spans(t or ""), i
    assert got[len(texts) + 1].clean_text == "[CARD] and 4111-1111-1111-1112"


def test_disclosing_terms(spark):
    telling = [f"Line {w} by Zorblax of zorba@corp.example and more {w} text" for w in ("red", "blue", "green", "grey")]
    rows = telling + [f"plain {w} more text by of and line {k}" for k, w in enumerate(("red", "blue", "green", "grey") * 30)]
    got = {r.doc_id: r for r in sanitise(docs_of(spark, rows)).collect()}
    assert {s.value for s in got[0].spans if s.kind == "term"} == {"Zorblax"}
    assert got[0].clean_text == "Line red by [TERM] of [EMAIL] and more red text"
    assert all(not got[i].spans for i in range(4, len(rows)))
    assert sanitise(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_disclosing_terms_of_repeated_and_neighbouring_lines(spark):
    words = [f"w{k}x w{k}y w{k}z" for k in range(200)]
    contact = [f"{w} alpha\nContact John Smith at john@x.com\n{w} beta" for w in words[:5]]
    above = [f"{w} alpha\nMary Jones\nSales\n\nmary@y.com" for w in words[5:10]]
    bare = ["zoe@z.com"] * 2 + [f"Zoe {w}\nzoe@z.com" for w in words[10:13]]
    copies = [f"{words[13]} Unique Person\nsole@q.com"] * 6
    plain = [f"{w} alpha beta contact at sales" for w in words[20:]]
    rows = [*contact, *above, *bare, *copies, *plain]
    got = {r.doc_id: {s.value for s in r.spans if s.kind == "term"} for r in sanitise(docs_of(spark, rows)).collect()}
    assert all(got[i] == {"John", "Smith"} for i in range(5))
    assert all(got[i] == {"Mary", "Jones"} for i in range(5, 10))
    assert got[10] == got[11] == set() and all(got[i] == {"Zoe"} for i in range(12, 15))
    assert not any(got[i] for i in range(15, len(rows)))


def test_terms_by_the_rule_written_out(spark):
    """Every term next to any level of an entity, from counts in plain Python; the shared part of values acts too."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(160):
        text = " ".join(rng.choice(words, 12))
        if k % 4 == 0:
            text += f" Acme staff{k}@acme.example" + (" Dana" if k % 8 == 0 else "")
        if k % 9 == 0:
            text += f" host 10.1.2.{k}"
        if k % 16 == 0:
            text += f" call +1 555 123 {1000 + k}"
        rows.append(text)
    rows += rows[:5]
    levels = lambda kind, v: {"=" + v.lower(), "*" + kind, {"email": "~email " + v.lower().split("@")[-1], "ip": "~ip " + ".".join(v.split(".")[:3]), "phone": "~phone " + re.sub("[^0-9]", "", v)[:5]}[kind]}
    found, terms = [], []
    for t in rows:
        spans = base_spans(t)
        found.append(set().union(*(levels(k, t[a:e]) for a, _, k, e in spans)))
        rest = "".join(" " if any(a <= i < e for a, _, _, e in spans) else c for i, c in enumerate(t))
        terms.append({w for w in re.split(r"[^\w']+|_", rest.lower()) if re.search("[a-z]", w)})
    n_t = Counter(w for ws in terms for w in ws)
    docs, texts = Counter(), defaultdict(set)
    for t, es, ws in zip(rows, found, terms):
        for e in es:
            for w in ws:
                docs[e, w] += 1
                texts[e, w].add(t)
    taken = {(e, w) for (e, w), n in docs.items() if n / n_t[w] * len(texts[e, w]) / (len(texts[e, w]) + 1.64**2) >= 0.5}
    got = {r.doc_id: {s.value.lower() for s in r.spans if s.kind == "term"} for r in sanitise(docs_of(spark, rows)).collect()}
    assert got == {i: {w for w in ws if any((e, w) in taken for e in es)} for i, (es, ws) in enumerate(zip(found, terms))}
    assert "acme" in got[4] and "dana" in got[0] and got[1] == set()


def test_an_entity_without_terms_counts(spark):
    # 36 of the 40 documents with the address hold nothing else; counted as 4, the address would be given away by Quill.
    rows = [f"Quill w{k}x q@q.com" for k in range(4)] + ["q@q.com"] * 36 + ["Quill w4x"] + [f"v{k}x" for k in range(59)]
    assert not any(s.kind == "term" for r in sanitise(docs_of(spark, rows)).collect() for s in r.spans)


# ---- chat formatting


def test_chat_round_trip(spark):
    said = [r"\### Assistant: </turn> ok", "####", "\\", "<</turn>", "", "é\n### user: x</turn>\n"]
    rows = [(1, k, "assistant" if k % 2 else "user", s, 7) for k, s in enumerate(said)] + [(1, 3, None, None, 7), (None, 0, "a:b", "x", 7), (2, None, "user", None, 7)]
    out = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted long")).collect()
    got = {r.conv_id: r for r in out}
    turns = sorted((t, r or "", s or "") for c, t, r, s, _ in rows if c == 1)
    assert read_marked(got[1].formatted) == [(r, s) for _, r, s in turns]
    assert [unescape(got[1].formatted[m.text_start : m.text_end]) for m in got[1].turns] == [s for _, _, s in turns]
    assert read_marked(got[None].formatted) == [("a:b", "x")] and got[1].rewritten_at == -1


def test_chat_templates_that_rewrite():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    drops_old = lambda ts: "".join(f"[{r}]{t if k == len(ts) - 1 or r == 'user' else '-'}\n" for k, (r, t) in enumerate(ts))
    text, spans, at = locate_turns(drops_old, turns)
    assert at == 2 and spans == [] and text == "[user]a\n[assistant]-\n[user]c\n"
    closing = lambda ts: "".join(f"<{r}>{t}" for r, t in ts) + "<eos>"
    text, spans, at = locate_turns(closing, turns)
    assert at == -1 and [text[s[2] : s[3]] for s in spans] == ["a", "b", "c"]
    assert locate_turns(marked_template, [])[1] == []


# ---- near duplicates


def brute_components(sets, percent=80):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = defaultdict(set)
    for i, s in sets.items():
        for v in s:
            lists[v].add(i)
    done = set()
    for members in lists.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in done:
                    done.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * len(sets[a] | sets[b]):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def compare_near(spark, texts, size):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    want = brute_components(sets)
    got = {r.doc_id: r for r in near_duplicates(docs_of(spark, list(texts.values()), list(texts)), size=size).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), c, i == c) for i, c in want.items()}


def test_near_dup_on_the_given_documents(spark, texts):
    compare_near(spark, texts, 4)


def test_near_dup_in_one_group_of_edited_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for i in range(150):
        words = list(base)
        for k in rng.choice(120, rng.integers(0, 9), replace=False):
            words[k] = f"e{rng.integers(0, 4)}"
        texts[i] = " ".join(words) + f" own{i} " + " ".join(f"o{i}x{k}" for k in range(rng.integers(0, 12)))
    compare_near(spark, texts, 4)


def test_near_dup_odd_rows(spark):
    rows = near_duplicates(docs_of(spark, ODD, [1, 2, None, 7, 3, 4, None]), size=4).collect()
    got = {(r.doc_id, r.n_shingles): r for r in rows}
    assert got[1, 0].component_id == 1 and got[7, 1].component_id == 4 and got[3, 1].n_shingles == 1
    assert got[None, 3].component_id is None and got[None, 3].kept and len(rows) == len(ODD)
    assert near_duplicates(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 100: 90}


# ---- benchmark decontamination


def test_components_in_two_steps(spark):
    rng = np.random.default_rng(3)
    links = [tuple(map(int, rng.integers(0, 300, 2))) for _ in range(260)]
    links = [(a, b) for a, b in links if a != b]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    whole = {r.node: r.label for r in components(frame(links)).collect()}
    steps = {r.node: r.label for r in components(frame(links[90:]), components(frame(links[:90]))).collect()}
    assert steps == whole and len(set(whole.values())) > 1
    assert {r.node: r.label for r in components(frame([]), components(frame(links))).collect()} == whole


def test_contamination(spark):
    item = "If Anna buys 12 apples and later Anna sells 5 apples for 3 dollars each how much does she earn today"
    other = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tree nearby"
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "short item"), (5, "...")], "item_id long, text string")
    swapped = item.replace("Anna", "Peter").replace("12", "40").replace("5", "8")
    mixed = item.replace("12", "40").replace("later Anna", "later Clara")
    texts = [f"see {item} end", f"so {swapped}. ok", mixed, f"x {other[:60]} y", "a short item here", None, "", other + " " + LONG]
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs_of(spark, texts), bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (7, 2), (4, 4)} | ({(2, 1)} & set(got))
    assert got[0, 1].verbatim and not got[1, 1].verbatim and got[1, 1].n_changed >= 3
    assert (2, 1) not in got or got[2, 1].coverage < 1
    assert contaminated(docs_of(spark, texts).limit(0), bench).count() == 0
    assert contaminated(docs_of(spark, texts), bench.limit(0)).count() == 0


def test_contamination_of_dense_numbers(spark):
    item = "Compute 12 + 7 * 3 - 5 given 4 and 9 with 2.5 kg of 11 at 6 % over 8 years for 3 people in 10 towns"
    other = "intro words here. Compute 41 + 8 * 6 - 9 given 5 and 7 with 3.5 kg of 13 at 1 % over 4 years for 6 people in 22 towns and more"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    table = " ".join(str(k * 7) for k in range(300))
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs_of(spark, [other, table, item.lower(), "given 4 and 9 years"]), bench).collect()}
    assert set(got) == {(0, 1), (2, 1)} and got[0, 1].coverage > 0.9 and not got[0, 1].verbatim and got[2, 1].verbatim


def test_windows_of_texts_together_are_those_of_each():
    from strandframe.llm import decontaminate as D

    texts = ["Anna has 3 red apples and 4 kg. Ben gives 2 to Mary in May at noon", "", "1 2 3 4 5 6 7 8 9 kg m 3 x", "one two three", "Tom. Tom Tom a b c d e F g h 3 m"]
    every = D.templates(texts)
    for width in (3, 8):
        together = [sorted(zip(*(x.tolist() for x in map(np.concatenate, zip(*D.template_windows(every, width, 8))))))]
        alone = []
        for k, t in enumerate(texts):
            made = D.templates([t])
            found = list(D.template_windows(made, width, 8))
            base = int(every.begins[k])
            for a, b, c, h in zip(*(x.tolist() for x in map(np.concatenate, zip(*found)))) if found else ():
                alone.append((a + base, b + base, c, h))
                assert made.filled(a, b, c) == every.filled(a + base, b + base, c) and made.as_is(a, b, c) == every.as_is(a + base, b + base, c)
        assert together == [sorted(alone)]


def test_contamination_with_names_at_sentence_starts(spark):
    item = "Tom has 5 red apples. Mary has 3 green apples. Peter gives 2 pears to Tom and Anna eats 4 apples. How many apples are left?"
    names = {"Tom": "Lukas", "Mary": "Ida", "Peter": "Olga", "Anna": "Bruno", "5": "15", "3": "13", "2": "7", "4": "6"}
    other = re.sub(r"\w+", lambda m: names.get(m[0], m[0]), item)
    story = "If Anna buys pears and later Peter sells them to Clara how much does Anna earn in the end today"
    bench = spark.createDataFrame([(1, item), (2, story), (3, "Nice item")], "item_id long, text string")
    texts = [other, other.replace(".", ""), item.lower(), story.lower(), story, "Other item. " + LONG, "Ida has red hair. " + LONG]
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs_of(spark, texts), bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 2)}
    assert all(r.coverage == 1 for r in got.values())
    assert not got[0, 1].verbatim and got[2, 1].verbatim and got[3, 2].verbatim


def test_contamination_by_a_run_beside_a_place_with_more_windows(spark):
    words = [f"item{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    scattered = [w if k not in (10, 21) else "other" for k, w in enumerate(words[:32])]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    run, more = " ".join(words[:13]), " ".join(scattered)
    texts = [f"{run} {LONG} {more}", run, more]
    got = {r.doc_id: r for r in contaminated(docs_of(spark, texts), bench).collect()}
    assert set(got) == {0, 1}
    assert (got[0].n_found, got[0].longest_run) == (6, 13)


# ---- language model


def test_scores(spark, texts):
    every = {**texts, 10**6: "", 10**6 + 1: "ZZZ yyy"}
    got = {r.doc_id: r for r in score_texts(docs_of(spark, list(every.values()), list(every))).collect()}
    tokens = {i: t.encode().lower().split() + [None] for i, t in every.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in every}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_model_is_a_distribution(spark):
    """Probabilities of all words and the unseen one after a fixed context add up to one, at two and three words."""
    train = {i: t for i, t in enumerate(["a b a c", "a b b", "c a b a", "b a", "c c a b"] * 6) if zlib.crc32(str(i).encode()) % 7 != 2}
    test_ids = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    for order in (2, 3):
        probes = {i: ("a b " + w).strip() for i, w in zip(test_ids, ("a", "b", "c", "zz"))}
        end = {next(i for i in range(2000, 3000) if zlib.crc32(str(i).encode()) % 7 == 2): "a b"}
        every = {**train, **probes, **end}
        got = {r.doc_id: r.score for r in score_texts(docs_of(spark, list(every.values()), list(every)), order=order).collect()}
        assert all(math.isfinite(s) and s < 0 for s in got.values())
    assert 0.2 < learn([(3, 0, 10.0), (3, None, 5.0), (3, 32, 5.0)])[3] < 1
    assert score_texts(docs_of(spark, ["x"]).limit(0)).count() == 0
    assert score_texts(docs_of(spark, ODD, [None, 1, 2, 3, 4, 4, 5])).count() == len(ODD)


# ---- token files


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_segment_round_trip(planes):
    ids = np.random.default_rng(1).integers(0, 2**32, 10_000, dtype=np.uint64).astype("<u4")
    data = write_segment(ids, block=777, planes=planes)
    assert (read_segment(data) == ids).all() and (read_segment(data, 700, 900) == ids[700:900]).all()
    assert len(read_segment(write_segment(ids[:0]))) == 0
    with pytest.raises(ValueError):
        read_segment(data[:-3] + b"\0\0\0")


def test_token_files(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = [*ODD, "x<|endoftext|> y", "It's  a b\n\n c.́ 漢字 ½"]
    ids = [5, 3, None, 2, 1, 2, 9, 8, 7]
    write_token_files(docs_of(spark, texts, ids), str(tmp_path / "t"), path, segment_ids=1000, block=700)
    got = read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(ids, key=lambda i: -1 if i is None else i)
    want = Counter((i, struct.pack(f"<{len(e) + 1}I", *e, 2)) for i, e in zip(ids, (tok.encode(t or "", add_special_tokens=False).ids for t in texts)))
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    assert [r.start for r in got] == list(np.cumsum([0] + [len(r.ids) // 4 for r in got[:-1]]))
    write_token_files(docs_of(spark, texts).limit(0), str(tmp_path / "e"), path)
    assert read_token_files(spark, str(tmp_path / "e")).count() == 0


# ---- packing


def test_best_fit_against_a_plain_search():
    rng = np.random.default_rng(2)
    pieces = sorted(((int(rng.integers(1, 100)), f"s{rng.integers(0, 3)}", int(rng.integers(0, 40)) or None) for _ in range(300)), key=lambda p: -p[0])
    bins, want = [], []
    for n, s, c in pieces:
        fits = [(100 - sum(x[0] for x in b), k) for k, b in enumerate(bins) if sum(x[0] for x in b) + n <= 100
                and sum(x[0] for x in b if x[1] == s) < 50 and (c is None or all(x[2] != c for x in b))]
        k = min(fits)[1] if fits else len(bins)
        if k == len(bins):
            bins.append([])
        want.append((k, len(bins[k]), sum(x[0] for x in bins[k])))
        bins[k].append((n, s, c))
    assert best_fit(pieces, 100, 0.5) == want


def test_pack_keeps_every_piece(spark):
    from pyspark.sql import functions as F

    df = docs_of(spark, ODD, [1, 1, None, 2, 3, 2, 5])
    rows = pack(df, F.when(F.col("text").isNull(), None).otherwise(F.length("text")), F.lit(None), capacity=1000, shard_pieces=8).collect()
    got = Counter()
    bins = defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.n_tokens
        bins[r.bin_id].append((r.offset, r.n_tokens))
    assert got == Counter({1: 0, None: 4, 2: 6, 3: len(LONG), 5: 11})
    for spans in bins.values():
        spans.sort()
        assert sum(n for _, n in spans) <= 1000 and all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert pack(df.limit(0), F.lit(1), F.lit(None)).count() == 0


# ---- pages

P = "Some long enough paragraph, with commas, about the matter at hand &amp; more."
T = P.replace("&amp;", "&")


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<body><nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>{P}<p>short</p></article><footer>f</footer>", ["Head", T, "short"]),
        (f"<div class=sidebar><p>{P}</p></div><div id=content><p>{P}</p><p>x <b>y</b><br>z</p><div class='comment-list'><p>{P}</p></div></div>", [T, "x y z"]),
        (f"<div><div class='cookie-notice'>{P}</div><form><p>{P}</p></form><p>{P}</p><ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul></div>", [T]),
        ("<script>var t='</p>';</script><style>x</style><!-- c --><p>1 < 2 &lt;b&gt;</p>", ["1 < 2 <b>"]),
        ("plain", ["plain"]), ("", []), ("<div><p>" * 3000 + P, [T]), ("<!-- open", []), ("<p a='x>y</p>", ["y"]),
        (f"<article><header><h1>Head</h1><p>{P}</p></header><p class='notice-period'>{P}</p><div class=share-prices>{P}</div></article>", ["Head", T, T, T]),
        (f"<article><p>{P}</p><div class='comment-box'>{P}</div><div class='related-work'><p>{P}</p></div></article>", [T, T, T]),
        (f"<article><p>{P}</p><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>", [T, "so x=2 holds"]),
        (f"<article><p>{P}{P}</p><section class=comments><p>{P}</p></section><div class='share-bar-top'><a href=1>Share</a></div><div class='box-newsletter'>{P}<input></div></article>", [T + T]),
        (f"<article><p>{P}</p><p>x <a href='a>b'>y</a> \"z</p></article>", [T, 'x y "z']),
    ],
)
def test_main_blocks(html, want):
    assert main_blocks(html) == want


@pytest.mark.parametrize("html", ["<a" * 200_000, '<a "' * 200_000, "<a '>\"" * 100_000, '<p "">' * 50_000 + "'", "<script>" + "</script " * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<div>" * 50_000 + "</p>" * 50_000, "<li><b>" * 50_000])
def test_scanner_is_linear(html):
    begin = time.time()
    main_blocks(html)
    assert time.time() - begin < 3


def test_pages_equal_a_parser_based_version(spark, sf):
    """The given pages: text of their one article by the standard library's event parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.blocks, self.text = 0, [], []

        def cut(self):
            words = " ".join("".join(self.text).split())
            self.blocks += [words] if words else []
            self.text = []

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.depth += 1
            if tag == "br":
                self.text.append(" ")
            elif tag not in ("b", "a", "i", "em", "strong", "span"):
                self.cut()

        def handle_endtag(self, tag):
            if tag not in ("b", "a", "i", "em", "strong", "span"):
                self.cut()
            if tag == "article":
                self.depth -= 1

        def handle_data(self, data):
            if self.depth:
                self.text.append(data)

    def plain(html):
        one = Article()
        one.feed(html)
        one.close()
        one.cut()
        return "\n".join(one.blocks)

    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r.text for r in QUERIES["op9_html_text"](spark, sf).collect()}
    assert got == {r.page_id: plain(r.html or "") for r in rows}


def test_pages(spark):
    rows = [(1, "u", None, "x"), (1, "u", "", "x"), (None, None, f"<p>{P}</p>", "x")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, T, len(T)), (1, "", 0), (1, "", 0)]


# ---- pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}
    again = corpus_pipeline.run(spark, sf).collect()
    key = lambda rows: sorted(map(str, rows))
    assert key(again) == key(packed)


def test_pipeline_near_dup_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline

    text = " ".join(f"w{k}" for k in range(60))
    rows = spark.createDataFrame([Row(doc_id=i, text=t, source="s") for i, t in [(1, text), (1, text), (2, text), (None, text), (3, text + " end"), (4, "own")]])
    assert corpus_pipeline.near_dup_stage(spark, rows, "").count() == 2


