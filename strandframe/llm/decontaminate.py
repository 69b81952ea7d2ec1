"""Benchmark items inside documents, also with other numbers, names and units.

Texts become templates: numbers and units are typed placeholders.  A capitalised word
may be a name, also where it begins a sentence, or a word to be met as it is, so a
window has a hash for each choice.  Hashes of template windows are joined; matches of
one document and item on neighbouring diagonals are put together, and the values in
their placeholders must translate one to one from item to document.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import STEP, key_filter, may_hold, mix, stored, text_of, window_sums

TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,]\d+)*|[.!?:\n]|[%$€£]")
PLAIN, NUMBER, NAME, END, UNIT, SIGN = range(6)
# Units that make a placeholder when they follow a number.
UNITS = set(
    "m km cm mm kg g mg t lb lbs oz ft in inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers gram grams "
    "kilogram kilograms ton tons tonnes liter liters litre litres ml l gallon gallons second seconds minute minutes hour hours day days week weeks "
    "month months year years s min h dollar dollars cent cents euro euros pound pounds percent degree degrees volt volts watt watts joule joules".split()
)
KINDS = np.uint64(7)
STEP_BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
INSIDE, FIRST = 1, 2  # a capitalised word inside a sentence and at its start
CHUNK = 1 << 14  # windows whose choices are held at once
TOGETHER = 200_000  # tokens of texts whose windows are made at once; bounds memory only


class Codes(dict):
    """Hash of the lower-case token with its kind in the low three bits, remembered per worker."""

    def __missing__(self, token: str) -> int:
        if token in ".!?:\n":
            kind = END
        elif token in "%$€£":
            kind = SIGN
        elif token[0].isdigit():
            kind = NUMBER
        elif token.lower() in UNITS:
            kind = UNIT
        elif token[0].isupper() and token[1:].islower():
            kind = NAME
        else:
            kind = PLAIN
        code = self[token] = xxhash.xxh3_64_intdigest(token.lower().encode("utf-8", "surrogatepass")) & ~7 | kind
        return code


_codes = Codes()


@dataclass
class Templates:
    """Tokens of some texts one after the other: literal hash, kind of placeholder (0: none), whether it may be a name
    (0: no, INSIDE, FIRST), and the end of its text.  A unit needs a number before it, a currency or percent sign always is one."""

    tokens: list[str]
    places: np.ndarray  # of the words among all tokens
    codes: np.ndarray
    slot: np.ndarray
    name: np.ndarray
    begins: np.ndarray  # first word of each text
    ends: np.ndarray

    def token(self, k: int) -> str:
        return self.tokens[self.places[k]]

    def filled(self, a: int, b: int, bits: int) -> list[str]:
        """``place=value`` of the placeholders of words a to b, by place in the text; ``bits`` are the words taken as names."""
        first = self.begins[np.searchsorted(self.begins, a, "right") - 1]
        return [f"{k - first}={self.token(k).lower()}" for k in range(a, b) if self.slot[k] or bits >> (k - a) & 1]

    def as_is(self, a: int, b: int, bits: int) -> list[str]:
        """Possible names that are met as they are; they translate to themselves."""
        return [self.token(k).lower() for k in range(a, b) if self.name[k] and not bits >> (k - a) & 1]


def templates(texts: list[str]) -> Templates:
    if len(_codes) > 1_000_000:
        _codes.clear()
    each = [TOKEN.findall(t) for t in texts]
    tokens = list(chain.from_iterable(each))
    codes = np.fromiter(map(_codes.__getitem__, tokens), np.uint64, len(tokens))
    size = np.fromiter(map(len, each), np.int64, len(each))
    kind = (codes & KINDS).astype(np.uint8)
    word = kind != END
    new = np.zeros(len(kind) + 1, bool)
    new[np.cumsum(size) - size] = True  # the first token of a text
    new = new[:-1]
    after_end = np.ones(len(kind), bool)
    after_end[1:] = ~word[:-1]
    places = np.flatnonzero(word)
    first, start = (after_end | new)[places], np.append(0, np.cumsum(word))[np.append(0, np.cumsum(size))]
    codes, kind = codes[places] & ~KINDS, kind[places]
    before = np.zeros(len(kind), np.uint8)
    before[1:] = kind[:-1]
    inner = start[:-1][start[:-1] < len(kind)]
    before[inner] = 0
    slot = kind.copy()
    slot[kind == NAME] = PLAIN
    slot[(kind == UNIT) & (before != NUMBER)] = PLAIN
    slot[kind == SIGN] = UNIT
    name = np.where(kind == NAME, np.where(first, FIRST, INSIDE), 0).astype(np.uint8)
    return Templates(tokens, places, codes, slot, name, start[:-1], start[1:])


def template_windows(t: Templates, width: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(starts, ends, choices, hashes)``: one hash per window and choice of the words taken as names, these as bits from the start.

    Half of the words of a window stay plain at least, and half of ``size`` where a sentence
    start is taken as a name.  A window with more numbers and units goes on until half of
    ``width`` words are plain, and has the hash of its literal tokens as well.
    """
    n = len(t.codes) - width + 1
    if n <= 0:
        return
    typed = np.where(t.slot > 0, t.slot.astype(np.uint64), t.codes)
    sums = window_sums(typed, width)
    holes = np.append(0, np.cumsum(t.slot > 0))
    holes = holes[width:] - holes[:-width]
    # windows inside one text
    end = np.repeat(t.ends, t.ends - t.begins)
    inside = np.flatnonzero(np.arange(n) + width <= end[:n])
    dense = 2 * holes[inside] > width
    at = inside[dense]
    if len(at):
        literal = window_sums(t.codes, width)[at]
        yield at, at + width, np.zeros(len(at), np.int64), (mix(literal) ^ np.uint64(width)).astype(np.int64)
        plain = np.cumsum(t.slot == 0)
        stop = np.searchsorted(plain, np.append(0, plain)[at] + (width + 1) // 2) + 1
        ok = stop <= end[at]
        at, stop = at[ok], stop[ok]
        if len(at):
            power = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(typed), STEP_BACK)))
            prefix = np.append(np.uint64(0), np.cumsum(typed * power[:-1]))
            # a window's sum from prefixes, times STEP to the power of its last place
            scale = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(typed), STEP)))
            acc = (prefix[stop] - prefix[at]) * scale[stop - 1]
            yield at, stop, np.zeros(len(at), np.int64), (mix(acc) ^ (stop - at).astype(np.uint64)).astype(np.int64)
    power = [np.uint64(pow(int(STEP), width - 1 - k, 1 << 64)) for k in range(width)]
    change = np.uint64(NAME) - t.codes
    inside = inside[~dense]
    for lo in range(0, len(inside), CHUNK):
        at = inside[lo : lo + CHUNK]
        acc, plain, bits, starts = sums[at], (width - holes[at]).astype(np.int32), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        for k in range(width):
            kind = t.name[at + k]
            more = np.flatnonzero(kind)
            begins = starts[more] | (kind[more] == FIRST)
            ok = 2 * (plain[more] - 1) >= np.where(begins, size, width)
            more, begins = more[ok], begins[ok]
            if len(more):
                acc = np.concatenate([acc, acc[more] + change[at[more] + k] * power[k]])
                plain = np.concatenate([plain, plain[more] - 1])
                bits = np.concatenate([bits, bits[more] | 1 << k])
                starts = np.concatenate([starts, begins])
                at = np.concatenate([at, at[more]])
        yield at, at + width, bits, mix(acc).astype(np.int64)


def item_windows(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``item, n_windows, width, p, w, slots, same`` of every item, place and choice of names; one shorter than ``size`` is a single window."""
    picked = benchmark.select(F.col(id_col).alias("item"), text_of(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], defaultdict(list)
            for i, text in enumerate(batch.column("t").to_pylist()):
                made = templates([text])
                width = min(size, len(made.codes))
                if width == 0:
                    continue
                found = [x.tolist() for x in map(np.concatenate, zip(*template_windows(made, width, size)))]
                n_windows = max(found[0]) + 1
                for p, stop, bits, w in zip(*found):
                    ids.append(i)
                    for k, v in (("n", n_windows), ("width", width), ("p", p), ("w", w), ("slots", made.filled(p, stop, bits)), ("same", made.as_is(p, stop, bits))):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(pa.array(ids, pa.int64())), pa.array(out["n"], pa.int32()), pa.array(out["width"], pa.int32()),
                 pa.array(out["p"], pa.int32()), pa.array(out["w"], pa.int64()), pa.array(out["slots"], pa.list_(pa.string())), pa.array(out["same"], pa.list_(pa.string()))],
                names=["item", "n_windows", "width", "p", "w", "slots", "same"],
            )

    return picked.mapInArrow(run, f"item {picked.schema['item'].dataType.simpleString()}, n_windows int, width int, p int, w long, slots array<string>, same array<string>")


def document_windows(docs: DataFrame, widths: list[int], size: int, bits: bytes, id_col: str, text_col: str) -> DataFrame:
    """``id, h, q, w, slots`` of the windows that pass the filter; ``h`` tells texts of one id apart."""
    picked = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), text_of(text_col).alias("t"))
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            rows, qs, ws, slots = [], [], [], []
            texts = batch.column("t").to_pylist()
            lo = 0
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= 6 * TOGETHER):
                    held += len(texts[hi])
                    hi += 1
                made = templates(texts[lo:hi])
                for width in widths:
                    for found in template_windows(made, width, size):
                        met = np.flatnonzero(may_hold(bitmap, found[3]))
                        starts, stops, chosen, hashes = (x[met] for x in found)
                        owner = np.searchsorted(made.begins, starts, "right") - 1
                        rows += (owner + lo).tolist()
                        qs += (starts - made.begins[owner]).tolist()
                        ws += hashes.tolist()
                        slots += [made.filled(a, b, c) for a, b, c in zip(starts.tolist(), stops.tolist(), chosen.tolist())]
                lo = hi
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("h").take(at), pa.array(qs, pa.int32()), pa.array(ws, pa.int64()), pa.array(slots, pa.list_(pa.string()))],
                names=["id", "h", "q", "w", "slots"],
            )

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, h long, q int, w long, slots array<string>")


def judge(hits: list[dict], n_windows: int, width: int, slack: int, min_coverage: float, min_run: int) -> tuple[int, int, int, int]:
    """(item windows found, longest run in words, placeholders compared, placeholders changed) of the best place that passes a limit.

    Hits on one diagonal are one place; a place counts as far as its values translate
    one to one, and takes in others no more than ``slack`` words apart.  Of the choices of
    names in a window the one with most names that do is used.
    """
    places: dict[int, dict[int, list[tuple]]] = defaultdict(lambda: defaultdict(list))
    for h in hits:
        places[h["q"] - h["p"]][h["p"]].append((list(h["item_slots"]), list(h["doc_slots"]), list(h["same"])))
    sound: dict[int, tuple[set[int], set, set]] = {}
    for d, found in places.items():
        there, back, kept, slots, changed = {}, {}, set(), set(), set()
        for p in sorted(found):
            for choice in sorted(found[p], key=lambda c: (-len(c[0]), c)):
                pairs = [(a.split("=", 1), b.split("=", 1)[1]) for a, b in zip(*choice[:2])]
                own = set(choice[2])
                every = [(a, b) for (_, a), b in pairs] + [(a, a) for a in own]
                if all(there.get(a, b) == b and back.get(b, a) == a and (a == b or not own & {a, b}) for a, b in every):
                    for a, b in every:
                        there[a], back[b] = b, a
                    for (k, a), b in pairs:
                        slots.add(k)
                        if a != b:
                            changed.add(k)
                    kept.add(p)
                    break
        sound[d] = (kept, slots, changed)
    best = (0, 0, 0, 0)
    for d in sorted(sound):
        near = [v for e, v in sound.items() if abs(e - d) <= slack]
        found = set().union(*(v[0] for v in near))
        run = longest = 0
        for p in range(n_windows):
            run = run + 1 if p in found else 0
            longest = max(longest, run)
        words = longest + width - 1 if longest else 0
        if len(found) / n_windows >= min_coverage or words >= min_run:
            best = max(best, (len(found), words, len(set().union(*(v[1] for v in near))), len(set().union(*(v[2] for v in near)))))
    return best


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 8,
    min_coverage: float = 0.5,
    min_run: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document and item found in it.

    Columns: ``id_col, item_col, n_windows, n_found, coverage, longest_run, n_slots,
    n_changed, verbatim``.  A pair counts with ``min_coverage`` of the item's windows or
    ``min_run`` words in a row.  Null and empty texts match nothing; an item without a
    word is never found; repeated rows of a document count once, texts that share an id
    are judged apart and the better result is kept.
    """
    items = stored(item_windows(benchmark, size, item_col, item_text_col), "item-windows")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # at most ``size`` values
    hits = document_windows(docs, widths, size, key_filter(items, "w"), id_col, text_col)
    met = hits.withColumnRenamed("slots", "doc_slots").join(items.withColumnRenamed("slots", "item_slots"), "w")
    pairs = (
        met.where(F.size("doc_slots") == F.size("item_slots"))
        .groupBy(F.struct("id", "h", "item", "n_windows", "width").alias("key"))
        .agg(F.collect_set(F.struct("p", "q", "item_slots", "doc_slots", "same")).alias("hits"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, *judge(hs, k["n_windows"], k["width"], size, min_coverage, min_run)) for k, hs in zip(batch["key"], batch["hits"])]
            yield pd.DataFrame(out, columns=["key", "n_found", "longest_run", "n_slots", "n_changed"])

    judged = pairs.mapInPandas(run, f"key {pairs.schema['key'].dataType.simpleString()}, n_found long, longest_run long, n_slots long, n_changed long")
    coverage = F.col("n_found") / F.col("key.n_windows")
    value = F.struct("n_found", "longest_run", "n_slots", "n_changed")
    taken = judged.where((coverage >= min_coverage) | (F.col("longest_run") >= min_run))
    best = taken.groupBy(F.col("key.id").alias("id"), F.col("key.item").alias("item"), F.col("key.n_windows").cast("long").alias("n_windows")).agg(F.max(value).alias("v"))
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "n_windows", "v.n_found", (F.col("v.n_found") / F.col("n_windows")).alias("coverage"),
        "v.longest_run", "v.n_slots", "v.n_changed", (F.col("v.n_changed") == 0).alias("verbatim"),
    )
