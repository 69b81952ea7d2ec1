"""Compiled transducers against the tokenizers library."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers
from strandframe.llm import token_machine as tm
from strandframe.llm.queries import QUERIES
from strandframe.llm.token_counts import count_tokens
from test_llm_operators import LONG, ODD, docs_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(1)
    letters = "aab stmdrvel'''  \n\t!?.,09½漢é　\xa0\x85\x1c ABC\x00́😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(4000)]
    return [*texts, "x<|endoftext|> y", "  <|endoftext|><|endoftext|>  ", "<|endof", "text|>", "'r", "it'll've", "", "a" * 5000, LONG]


def test_counts_and_ids_equal_the_library(samples):
    m, want = tm.machine(PATH), library(samples)
    texts = pa.array(samples, pa.string())
    assert m.token_counts(texts).tolist() == [len(w) for w in want]
    ids, lengths = m.token_ids(texts)
    assert ids.tolist() == [i for w in want for i in w] and lengths.tolist() == [len(w) for w in want]
    part = texts.slice(7, 50)
    assert m.token_counts(part).tolist() == [len(w) for w in want[7:57]]
    assert m.token_counts(texts.slice(0, 0)).tolist() == []


def test_chunk_maps_compose_to_the_walk_over_all():
    rng = np.random.default_rng(3)
    step, border, maps, read, product = tm.splitter()
    classes = rng.integers(0, 11, 5000).astype(np.uint8)
    classes[rng.integers(0, 5000, 40)] += tm.FIRST
    classes[0] = classes[0] % tm.FIRST + tm.FIRST
    state, want = tm.FRESH, np.zeros(5000, bool)
    for k, c in enumerate(classes.tolist()):
        want[k] |= bool(border[state * tm.WIDTH + c] & tm.HERE)
        if border[state * tm.WIDTH + c] & tm.BACK:
            want[k - 1] = True
        state = int(step[state * tm.WIDTH + c])
    last = border[state * tm.WIDTH + tm.FIRST + tm.OTHER] & tm.BACK
    want[-1] |= bool(last)
    assert (tm.borders(classes) == want).all()
    elements = rng.integers(0, len(maps), 37).astype(np.uint16)
    whole = [0]
    for e in elements[:-1]:
        whole.append(int(product[whole[-1], e]))
    assert tm.scanned(elements, product).tolist() == whole


def test_merger_starts_over_when_full(monkeypatch, samples):
    monkeypatch.setattr(tm, "REMEMBERED", 50)
    m, want = tm.Machine(PATH), library(samples)
    for lo in range(0, 400, 40):
        some = samples[lo : lo + 40]
        assert m.token_counts(pa.array(some)).tolist() == [len(w) for w in want[lo : lo + 40]]
        assert m.token_ids(pa.array(some))[0].tolist() == [i for w in want[lo : lo + 40] for i in w]


def test_new_pieces_are_not_split_again(samples):
    m, every = tm.Machine(PATH), [*samples, "<|endoftext|>", *map(chr, range(0x500)), *(chr(k) for k in range(0x10000, 0x10FFFF, 997))]
    texts, want = pa.array(every, pa.string()), library(every)
    m.pieces(texts)  # learns the classes of all characters
    m.tokenizer = None
    ids, lengths = m.token_ids(texts)
    assert ids.tolist() == [i for w in want for i in w] and lengths.tolist() == [len(w) for w in want]


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        tm.Machine(public_tokenizers.path("word_bpe_49k.json"))


def test_query_equals_the_library(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = library([r.text or "" for r in rows])
    got = Counter(tuple(r) for r in QUERIES["op12_token_counts"](spark, sf).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    assert got == Counter((r.doc_id, len((r.text or "").encode()), len(w), len(w) > 512) for r, w in zip(rows, want))


def test_odd_rows(spark):
    ids = [None, 1, 2, 3, 4, 4, 5]
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(docs_of(spark, ODD, ids), PATH).collect())
    assert got == Counter((i, len((t or "").encode()), len(w)) for i, t, w in zip(ids, ODD, library([t or "" for t in ODD])))
    assert count_tokens(docs_of(spark, ["x"]).limit(0), PATH).count() == 0
