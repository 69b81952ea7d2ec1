"""Periodic runs of words by grammar compression.

The word ids of every text are compressed by Re-Pair: in each round pairs of neighbours
that occur twice or more become nonterminals, the most frequent of overlapping ones
first, until no pair is left twice.  A run that lies inside a nonterminal's text either
crosses the border between its two parts or lies inside one of them, so runs are
computed once per nonterminal, at its border, in the first text it stands for, and once
per border of the remaining sequence.  Those of nonterminals are translated to all their
derivation positions; intervals of one period that overlap are parts of one run and are
merged, and what is found is the set of maximal runs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import text_of

TOGETHER = 300_000  # words compressed at a time; bounds memory only
RUNS = "array<struct<start:long,length:long,period:long>>"


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group number, size of the group) per element."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.cumsum(new) - 1
    out, size = np.empty(len(keys), np.int64), np.bincount(number)
    out[order] = number
    return out, size[out]


@dataclass
class Grammar:
    """Rules ``base + k -> left[k] right[k]`` with the word where their first text begins, and the sequence left over."""

    base: int
    left: np.ndarray
    right: np.ndarray
    first: np.ndarray
    size: np.ndarray  # words of every symbol
    symbols: np.ndarray
    starts: np.ndarray  # word at which each symbol of the sequence begins


def repaired(words: np.ndarray, text: np.ndarray) -> Grammar:
    """Re-Pair of many texts at once; no word id may stand in two texts, so neither does a pair or a rule.

    A round replaces every pair whose count, then number, is highest among the pairs it
    overlaps; of a row of equal symbols every second pair counts.
    """
    base = int(words.max()) + 1 if len(words) else 0
    symbols, starts, owner = words.astype(np.int64), np.arange(len(words)), text
    lefts, rights, firsts = [], [], []
    size = np.ones(base, np.int64)
    fresh = np.ones(len(symbols), bool)  # whose pair with the next may have become frequent
    while len(symbols) > 1:
        total = len(size)
        live = np.flatnonzero((fresh[:-1] | fresh[1:]) & (owner[:-1] == owner[1:]))
        if not len(live):
            break
        pair = symbols[live] * total + symbols[live + 1]
        number, count = groups(pair)
        often = count > 1
        live, number, count = live[often], number[often], count[often]
        if not len(live):
            break
        waiting = live
        # of a row of one pair with itself, every second place
        streak = np.ones(len(live), bool)
        streak[1:] = (live[1:] != live[:-1] + 1) | (number[1:] != number[:-1])
        begin = np.maximum.accumulate(np.where(streak, np.arange(len(live)), 0))
        odd = (np.arange(len(live)) - begin) % 2 == 1
        live, number, count = live[~odd], number[~odd], count[~odd]
        number, count = groups(number)
        often = count > 1
        live, number, count = live[often], number[often], count[often]
        if not len(live):
            break
        rank = count * (number.max() + 1) + number
        at = np.full(len(symbols) + 1, -1, np.int64)
        at[live] = rank
        before, after = at[live - 1], at[live + 1]
        before[live == 0] = -1
        best = (rank > before) & (rank > after)
        chosen, kind = live[best], number[best]
        kind, many = groups(kind)
        again = many > 1
        # a pair that is highest once only waits; the symbols around it stay as they are
        chosen, kind = chosen[again], kind[again]
        fresh = np.zeros(len(symbols), bool)
        fresh[waiting] = True
        if not len(chosen):
            # every highest pair is highest once: replace all places of the most frequent pair of each text
            top = np.full(int(owner[-1]) + 1, -1, np.int64)
            np.maximum.at(top, owner[live], rank)
            mine = rank == top[owner[live]]
            chosen, kind = live[mine], number[mine]
        _, kind = np.unique(kind, return_inverse=True)
        n_new = int(kind.max()) + 1
        first = np.zeros(n_new, np.int64)
        first[kind[::-1]] = chosen[::-1]
        lefts.append(symbols[first])
        rights.append(symbols[first + 1])
        firsts.append(starts[first])
        size = np.concatenate([size, size[symbols[first]] + size[symbols[first + 1]]])
        symbols = symbols.copy()
        symbols[chosen] = total + kind
        fresh[chosen] = True
        keep = np.ones(len(symbols), bool)
        keep[chosen + 1] = False
        symbols, starts, owner, fresh = symbols[keep], starts[keep], owner[keep], fresh[keep]
    join = lambda parts: np.concatenate([np.empty(0, np.int64), *parts])
    return Grammar(base, join(lefts), join(rights), join(firsts), size, symbols, starts)


class Levels:
    """Names of all windows of 1, 2, 4 ... words that occur twice or more in their text; -1 for the others."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.n = len(words)
        number, size = groups(words)
        self.names = [np.where(size > 1, number, -1)]
        self.sorted: list[tuple[np.ndarray, np.ndarray] | None] = [None]
        self.text = text

    def level(self, k: int) -> np.ndarray:
        while len(self.names) <= k:
            half, width = self.names[-1], 1 << (len(self.names) - 1)
            out = np.full(self.n, -1, np.int64)
            live = np.flatnonzero(half[: max(self.n - width, 0)] >= 0)
            live = live[(half[live + width] >= 0) & (self.text[live] == self.text[live + width])]
            if len(live):
                number, size = groups(half[live] * self.n + half[live + width])
                out[live[size > 1]] = number[size > 1]
            self.names.append(out)
            self.sorted.append(None)
        return self.names[k]

    def next_same(self, k: int, at: np.ndarray, least: np.ndarray, step: int) -> np.ndarray:
        """Nearest place at distance ``least`` or more after (step 1) or before (-1) each place with the same window; -1 if none."""
        names = self.level(k)
        if self.sorted[k] is None:
            live = np.flatnonzero(names >= 0)
            key = names[live] * (2 * self.n) + live
            order = np.argsort(key)
            self.sorted[k] = key[order], live[order]
        keys, places = self.sorted[k]
        want = names[at] * (2 * self.n) + np.clip(at + step * least, -1, 2 * self.n - 1)
        found = np.searchsorted(keys, want, "left" if step > 0 else "right") - (0 if step > 0 else 1)
        ok = (found >= 0) & (found < len(keys))
        out = np.full(len(at), -1, np.int64)
        hit = places[found[ok]]
        same = names[hit] == names[at[ok]]
        out[np.flatnonzero(ok)[same]] = hit[same]
        return out


def reach(words: np.ndarray, a: int, b: int, limit: int, step: int) -> int:
    """How many words from ``a`` and from ``b`` on agree in direction ``step``, at most ``limit``."""
    done, span = 0, 16
    while done < limit:
        m = min(span, limit - done)
        if step > 0:
            same = words[a + done : a + done + m] == words[b + done : b + done + m]
        else:
            same = (words[a - done - m + 1 : a - done + 1] == words[b - done - m + 1 : b - done + 1])[::-1]
        wrong = int(same.argmin())
        if not same[wrong]:
            return done + wrong
        done, span = done + m, span * 4
    return limit


def border_runs(words: np.ndarray, levels: Levels, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, min_length: int, min_exponent: int) -> dict[int, list[tuple[int, int, int]]]:
    """``(start, end, period)`` of runs inside words ``lo`` to ``hi`` that cross ``mid``, by border.

    A run of four periods or more has a square, two periods, to the left or right of the
    border that begins or ends there.  Squares are found by period from one power of two
    to the next: a window of that power must occur again at the period, and one that ends
    with the square as well.  After a square of period d that reaches over L words, only
    periods over L - d can begin another one that is not a multiple of d.
    """
    found: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)
    half = max(min_exponent // 2, 1)
    for step in (1, -1):
        room = (hi - mid if step > 0 else mid - lo) // half
        k, least, which = 0, np.ones(len(mid), np.int64), np.arange(len(mid))
        while len(which):
            width = 1 << k
            names = levels.level(k)
            anchor = mid if step > 0 else mid - width
            which = which[room[which] >= width]
            which = which[names[anchor[which]] >= 0]
            pending = which
            while len(pending):
                at = anchor[pending]
                other = levels.next_same(k, at, np.maximum(least[pending], width), step)
                period = np.where(other >= 0, (other - at) * step, 0)
                ok = (period > 0) & (period < 2 * width) & (period <= room[pending])
                pending, period = pending[ok], period[ok]
                if not len(pending):
                    break
                least[pending] = period + 1
                if step > 0:
                    x = mid[pending] + period - width
                    y = x + period
                else:
                    x = mid[pending] - period
                    y = x - period
                square = (names[x] >= 0) & (names[x] == names[y])
                for b, q in zip(pending[square].tolist(), period[square].tolist()):
                    m, s, e = int(mid[b]), int(lo[b]), int(hi[b])
                    right = m + reach(words, m, m + q, e - m - q, 1) + q if step > 0 else m + reach(words, m - q, m, e - m, 1)
                    left = m - reach(words, m - 1, m + q - 1, m - s, -1) if step > 0 else m - q - reach(words, m - q - 1, m - 1, m - q - s, -1)
                    least[b] = max(least[b], (right - m if step > 0 else m - left) - q + 1)
                    if left < m < right and right - left >= max(min_length, min_exponent * q):
                        old = found[b].get((left, right))
                        found[b][left, right] = q if old is None else min(q, old)
            k += 1
    return {b: [(s, e, q) for (s, e), q in runs.items()] for b, runs in found.items()}


def merged(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Maximal ``(start, length, period)`` by start and period; intervals of one period that share a period are one run."""
    whole: dict[tuple[int, int], int] = {}
    last = None
    for q, s, e in sorted((q, s, e) for s, e, q in runs):
        if last and last[0] == q and s <= last[2] - q:
            last[2] = max(last[2], e)
            continue
        if last:
            whole.setdefault((last[1], last[2]), last[0])
        last = [q, s, e]
    if last:
        whole.setdefault((last[1], last[2]), last[0])
    return sorted((s, e - s, q) for (s, e), q in whole.items())


def derived(grammar: Grammar, rules: set[int]) -> dict[int, np.ndarray]:
    """Words at which each of the rules begins in any derivation."""
    parents: dict[int, list[tuple[int, int]]] = defaultdict(list)
    wanted, todo = set(rules), np.array(sorted(rules), np.int64)
    while len(todo):
        more = set()
        for part, skipped in ((grammar.left, 0 * grammar.left), (grammar.right, grammar.size[grammar.left])):
            for r in np.flatnonzero(np.isin(part, todo + grammar.base)).tolist():
                parents[int(part[r]) - grammar.base].append((r, int(skipped[r])))
                more.add(r)
        todo = np.array(sorted(more - wanted), np.int64)
        wanted |= more
    places: dict[int, np.ndarray] = {}
    inside = np.flatnonzero(np.isin(grammar.symbols, np.array(sorted(wanted), np.int64) + grammar.base))
    top = defaultdict(list)
    for s, at in zip((grammar.symbols[inside] - grammar.base).tolist(), grammar.starts[inside].tolist()):
        top[s].append(at)
    for r in sorted(wanted, reverse=True):  # a rule's parents have higher numbers
        places[r] = np.concatenate([np.array(top[r], np.int64), *(places[p] + off for p, off in parents[r])])
    return {r: places[r] for r in rules}


def find_runs(texts: list[list], min_length: int = 6, min_exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """Maximal runs ``(start, length, period)`` of every list of words, by start and period.

    The period is the smallest, and a run has ``min_length`` words and ``min_exponent``
    periods or more (two at least, so that it holds a square).
    """
    if min_exponent < 4:
        raise ValueError("runs need four periods or more: two on one side of any border inside")
    ids, sizes, base = [], [], 0
    for words in texts:
        own = dict.fromkeys(words)
        own = dict(zip(own, range(base, base + len(own))))
        base += len(own)
        ids.extend(map(own.__getitem__, words))
        sizes.append(len(words))
    words = np.array(ids, np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(words):
        return out
    text = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    begins = ends - np.array(sizes)
    grammar = repaired(words, text)
    owner = text[grammar.starts]
    inner = np.flatnonzero(np.append(False, owner[1:] == owner[:-1]))
    top_mid = grammar.starts[inner]
    rule_len = grammar.size[grammar.base :]
    lo = np.concatenate([begins[text[top_mid]], grammar.first])
    mid = np.concatenate([top_mid, grammar.first + grammar.size[grammar.left]])
    hi = np.concatenate([ends[text[top_mid]], grammar.first + rule_len])
    found = border_runs(words, Levels(words, text), lo, mid, hi, min_length, min_exponent)
    n_top = len(top_mid)
    places = derived(grammar, {b - n_top for b in found if b >= n_top})
    every: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for b, runs in found.items():
        shifts = [0] if b < n_top else (places[b - n_top] - grammar.first[b - n_top]).tolist()
        for s, e, q in runs:
            for d in shifts:
                every[int(text[s + d])].append((s + d, e + d, q))
    for t, runs in every.items():
        out[t] = [(s - int(begins[t]), n, q) for s, n, q in merged(runs)]
    return out


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        change[s + q] += 1
        change[s + n] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, runs, collapsed`` per input row.

    ``runs`` holds the maximal runs (start, length, period; in words from 0) by start and
    period, ``collapsed`` the words that no run contains after its first period, joined
    by one space.  A null, empty or blank text has no words, no runs and an empty
    ``collapsed``.  Rows are independent: repeated ids give one row each, an empty table
    none, other columns are ignored.  No text is moved between tasks.
    """
    picked = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode().split() for t in batch.column("t").to_pylist()]  # bytes split at the six breaks
            runs, at = [], 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= TOGETHER):
                    held += len(texts[end])
                    end += 1
                runs += find_runs(texts[at:end], min_length, min_exponent)
                at = end
            flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3)
            fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
            bounds = pa.array(np.append(0, np.cumsum([len(r) for r in runs])), pa.int32())
            collapsed = pa.array([b" ".join(kept_words(w, r)) for w, r in zip(texts, runs)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(bounds, fields), collapsed],
                names=["id", "n_words", "runs", "collapsed"],
            )

    schema = f"id {picked.schema['id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string"
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
