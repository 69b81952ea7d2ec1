"""A byte-level BPE file compiled to two deterministic transducers.

The splitter reads character classes; its transitions carry the piece borders they emit,
up to one character late.  Its state maps form a finite monoid that is compiled once, so
the map of a chunk of text is one element of it, found by one look-up a character, and
chunk maps are composed by a parallel prefix scan over a composition table.  The merger
reads the bytes of a piece; its states and transitions are compiled when first met, and
each transition carries the change in the number of tokens.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

# Character classes.  The letters of contractions have classes of their own.
LETTER, DIGIT, SPACE, GAP, OTHER, QUOTE, ONE, R, V, E, L = range(11)
LETTERS = {LETTER, ONE, R, V, E, L}
CONTRACTED = {ord(c): k for k, letters in ((ONE, "stmd"), (R, "r"), (V, "v"), (E, "e"), (L, "l")) for c in letters}
FIRST = 16  # added to the class of the first character of a text
PAD, WIDTH = 31, 32
# States of the splitter.
FRESH, WORD, NUMBER, MARKS, SPACE1, GAP1, SPACES, GAPS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(12)
PENDING = {QUOTED_R: E, QUOTED_V: E, QUOTED_L: L}
N_STATES = 12
HERE, BACK = 1, 2  # a border before this character, before the last one
CHUNK = 256  # characters of a chunk
TOGETHER = 1 << 23  # bytes split at a time; bounds memory only
REMEMBERED = 1_000_000  # pieces and transitions a worker remembers; bounds memory only


def _opened(c: int) -> int:
    """State after the first character of a piece."""
    if c in LETTERS:
        return WORD
    return {DIGIT: NUMBER, SPACE: SPACE1, GAP: GAP1, OTHER: MARKS, QUOTE: QUOTED}[c]


def _moved(state: int, c: int) -> tuple[int, int]:
    """(next state, borders emitted) of the splitter."""
    if c == PAD:
        return state, 0
    if c >= FIRST:
        return _opened(c - FIRST), HERE | (BACK if state in PENDING else 0)
    marks = c in (OTHER, QUOTE)
    if state == FRESH:
        return _opened(c), HERE
    if state in (SPACE1, GAP1, SPACES, GAPS):
        if c in (SPACE, GAP):
            return (SPACES if c == SPACE else GAPS), 0
        back = BACK if state in (SPACES, GAPS) else 0
        if state in (SPACE1, SPACES):  # the last space belongs to what follows
            return (MARKS if marks else _opened(c)), back
        return _opened(c), HERE | back
    if state == QUOTED:
        if c == ONE:
            return FRESH, 0
        if c in (R, V, L):
            return {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[c], 0
        return (MARKS, 0) if marks else (_opened(c), HERE)
    if state in PENDING:
        if c == PENDING[state]:
            return FRESH, 0
        state, border = _moved(WORD, c)
        return state, border | BACK
    same = {WORD: c in LETTERS, NUMBER: c == DIGIT, MARKS: marks}[state]
    return (state, 0) if same else (_opened(c), HERE)


@cache
def splitter() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Next states and borders by state and class, the state maps, the map after one more class, and the product of two maps."""
    step, border = np.zeros((N_STATES, WIDTH), np.uint8), np.zeros((N_STATES, WIDTH), np.uint8)
    classes = [*range(11), *range(FIRST, FIRST + 11), PAD]
    for s in range(N_STATES):
        for c in classes:
            step[s, c], border[s, c] = _moved(s, c)
    number, maps, at = {tuple(range(N_STATES)): 0}, [tuple(range(N_STATES))], 0
    while at < len(maps):
        for c in classes:
            after = tuple(int(step[s, c]) for s in maps[at])
            if after not in number:
                number[after] = len(maps)
                maps.append(after)
        at += 1
    table = np.array(maps, np.uint8)
    read = np.zeros((len(maps), WIDTH), np.uint16)
    for c in classes:
        read[:, c] = [number[tuple(m)] for m in step[table, c].tolist()]
    product = np.zeros((len(maps), len(maps)), np.uint16)
    for k, m in enumerate(table):
        product[:, k] = [number[tuple(x)] for x in m[table].tolist()]
    return step.ravel(), border.ravel(), table, read.ravel(), product


def scanned(elements: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Products of all elements before each place, in log2 rounds."""
    out = np.concatenate([np.zeros(1, elements.dtype), elements[:-1]]) if len(elements) else elements
    gap = 1
    while gap < len(out):
        out = np.concatenate([out[:gap], product[out[:-gap], out[gap:]]])
        gap *= 2
    return out


def borders(classes: np.ndarray) -> np.ndarray:
    """True before each character that begins a piece; the first character of each text has its class plus FIRST."""
    step, border, maps, read, product = splitter()
    n = len(classes)
    width = min(CHUNK, max(16, int(n**0.5) // 2))
    lanes = -(-(n + 1) // width)
    flat = np.full(lanes * width, PAD, np.uint8)
    flat[:n] = classes
    flat[n] = FIRST + OTHER  # ends what is pending
    rows = np.ascontiguousarray(flat.reshape(lanes, width).T)
    element = np.zeros(lanes, np.uint16)
    for c in rows:
        element = read.take(element * np.uint16(WIDTH) + c)
    state = maps[scanned(element, product), FRESH].astype(np.uint16)
    out = np.empty((width, lanes), np.uint8)
    for k, c in enumerate(rows):
        code = state * np.uint16(WIDTH) + c
        border.take(code, out=out[k])
        state = step.take(code).astype(np.uint16)
    found = np.ascontiguousarray(out.T).ravel()[: n + 1]
    here = (found[:n] & HERE).astype(bool)
    here |= (found[1:] & BACK).astype(bool)
    return here


class Merger:
    """Token counts of pieces: a transducer over bytes, compiled state by state.

    A state is the longest end of the bytes read that begins a token, with the last token
    and the number of tokens of every prefix that ends in or just before it.
    """

    def __init__(self, vocab: dict[bytes, int], merges: dict[tuple[bytes, bytes], int]):
        self.vocab, self.merges = vocab, merges
        self.begins = {t[:k] for t in vocab for k in range(1, len(t))}
        self.longest = max(map(len, vocab), default=1)
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.moves: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[bytes | None, bytes], bool] = {}
        self.start = self._state((b"", (None,), (0,)))

    def _state(self, key: tuple) -> int:
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
        return self.states[key]

    def merged(self, piece: bytes) -> list[bytes]:
        """Tokens of a piece by the merge rule itself."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.merges.get(p, 1 << 60) for p in zip(parts, parts[1:])]
            least = min(ranks)
            if least == 1 << 60:
                break
            out, k = [], 0
            while k < len(parts):
                if k < len(ranks) and ranks[k] == least:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def _fit(self, before: bytes | None, token: bytes) -> bool:
        """Does the merge rule leave ``before`` and ``token`` as two tokens side by side (alone: as one)?"""
        key = (before, token)
        if key not in self.fits:
            want = [token] if before is None else [before, token]
            self.fits[key] = self.merged(b"".join(want)) == want
        return self.fits[key]

    def _compiled(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change of the count): the one token that may end here after the last token of its prefix."""
        tail, last, count = self.keys[state]
        grown = tail + bytes([byte])
        for size in range(len(grown), 0, -1):
            token = grown[-size:]
            if token in self.vocab:
                before = last[len(tail) + 1 - size]
                if self._fit(before, token) and self._fit(None, token):
                    break
        else:
            raise ValueError("the vocabulary lacks a byte")
        total = count[len(tail) + 1 - size] + 1
        last, count = (*last, token), (*count, total)
        keep = next((k for k in range(min(len(grown), self.longest - 1), 0, -1) if grown[-k:] in self.begins), 0)
        base = count[-1]
        key = (grown[len(grown) - keep :], last[-keep - 1 :], tuple(c - base for c in count[-keep - 1 :]))
        return self._state(key), total - self.keys[state][2][-1]

    def count(self, piece: bytes) -> int:
        if len(self.keys) > REMEMBERED:
            self._reset()
        state, total = self.start, 0
        for byte in piece:
            move = self.moves.get(state << 8 | byte)
            if move is None:
                move = self.moves[state << 8 | byte] = self._compiled(state, byte)
            state = move[0]
            total += move[1]
        return total


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Machine:
    """Pieces, token counts and ids of texts as the tokenizers library gives them for a byte-level BPE file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        if model.get("type") != "BPE" or not plain or spec.get("normalizer") or any(model.get(o) for o in options):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens with options")
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        names = {t["content"] for t in spec["added_tokens"]}
        vocab = {raw(t): i for t, i in model["vocab"].items() if t not in names}
        merges = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            merges.setdefault((raw(a), raw(b)), rank)
        self.merger = Merger(vocab, merges)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = np.zeros(256, "<u4")
        self.letters[[*letter.values()]] = [*map(ord, letter)]
        self.finder = re.compile(b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.kinds = np.full(0x110000, 255, np.uint8)
        self._learn(np.arange(128))
        self.counts: dict[bytes, int] = {}
        self.numbers: dict[bytes, int] = {}
        self.flat, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def _learn(self, points: np.ndarray) -> None:
        """Classes of code points, asked of the file's own splitting: what joins a letter, a digit, a mark?"""
        alone = lambda s: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(s)) == 1
        for p in points.tolist():
            c = chr(p)
            if c in " '":
                kind = SPACE if c == " " else QUOTE
            elif p in CONTRACTED:
                kind = CONTRACTED[p]
            else:
                kind = LETTER if alone("a" + c) else DIGIT if alone("1" + c) else OTHER if alone("!" + c) else GAP
            self.kinds[p] = kind

    def _classes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Class per character and the byte each begins at (None: one byte each)."""
        if not len(data) or data.max() < 0x80:
            return self.kinds.take(data), None
        at = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[at]
        kinds = self.kinds[:256].take(lead)
        wide = np.flatnonzero(lead >= 0xC0)
        size = 2 + (lead[wide] >= 0xE0).astype(np.int8) + (lead[wide] >= 0xF0)
        value = lead[wide].astype(np.int32) & (0x7F >> size)
        for k in (1, 2, 3):
            more = size > k
            value[more] = value[more] << 6 | data[at[wide[more]] + k] & 0x3F
        found = self.kinds.take(value)
        if (found == 255).any():
            self._learn(np.unique(value[found == 255]))
            found = self.kinds.take(value)
        kinds[wide] = found
        return kinds, at

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pieces of a string array without nulls as one binary array, and where each text's pieces begin (one more entry than texts)."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        kinds, at = self._classes(data)
        n, place = len(kinds), (lambda b: b) if at is None else (lambda b: np.searchsorted(at, b))
        begins = np.unique(offsets[:-1][np.diff(offsets) > 0])
        kinds[place(begins)] += FIRST
        inside = []
        if self.finder is not None:
            owner = np.append(begins, len(data))
            for m in self.finder.finditer(data.tobytes()):
                if owner[np.searchsorted(owner, m.start(), "right")] < m.end():
                    continue  # runs over the end of its text
                a, b = int(place(m.start())), int(place(m.end()))
                inside.append((a, b))
                for k in (a, b):
                    if k < n and kinds[k] < FIRST:
                        kinds[k] += FIRST
        cut = borders(kinds)
        for a, b in inside:
            cut[a + 1 : b] = False
        starts = np.flatnonzero(cut)
        starts = (starts if at is None else at[starts]).astype(np.int32)
        bounds = np.append(starts, np.int32(len(data)))
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        return found, np.searchsorted(starts, offsets)

    def token_counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of a string array without nulls."""
        out = [np.empty(0, np.int64)]
        for some in parted(texts):
            found, first = self.pieces(some)
            coded = found.dictionary_encode()
            known = self.counts
            if len(known) > REMEMBERED:
                known.clear()
            pieces = listed(coded.dictionary)
            for p in set(pieces).difference(known):
                known[p] = 1 if p in self.special else self.merger.count(p)
            counts = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces)).take(coded.indices.to_numpy())
            total = np.append(0, np.cumsum(counts))
            out.append(total[first[1:]] - total[first[:-1]])
        return np.concatenate(out)

    def _encoded(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece, of the library's model: its own splitting of a piece would leave it whole."""
        spelled = self.letters.take(np.frombuffer(b"".join(pieces), np.uint8)).tobytes().decode("utf-32-le")
        ids, end = [], 0
        for p in pieces:
            begin, end = end, end + len(p)
            ids.append([self.special[p]] if p in self.special else [t.id for t in self.model.tokenize(spelled[begin:end])])
        return ids

    def token_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array without nulls, one text after the other, and the number of each text's ids."""
        ids, lengths = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for some in parted(texts):
            found, first = self.pieces(some)
            coded = found.dictionary_encode()
            pieces = listed(coded.dictionary)
            if len(self.numbers) > REMEMBERED:
                self.numbers, self.flat, self.ends = {}, self.flat[:0], self.ends[:1]
            number = np.fromiter(map(self.numbers.get, pieces, repeat(-1)), np.int64, len(pieces))
            new = np.flatnonzero(number < 0)
            if len(new):
                number[new] = np.arange(len(self.numbers), len(self.numbers) + len(new))
                fresh = [pieces[k] for k in new.tolist()]
                rows = self._encoded(fresh)
                self.numbers.update(zip(fresh, number[new].tolist()))
                self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(rows), "<u4")])
                self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))])
            begin, used = self.ends[number], coded.indices.to_numpy()
            size = (self.ends[number + 1] - begin).take(used)
            total = np.append(0, np.cumsum(size))
            at = np.repeat(begin.take(used) - total[:-1], size)
            at += np.arange(total[-1])
            ids.append(self.flat.take(at))
            lengths.append(total[first[1:]] - total[first[:-1]])
        return np.concatenate(ids), np.concatenate(lengths)


def listed(pieces: pa.Array) -> list[bytes]:
    """A binary array without nulls as Python values."""
    ends = np.frombuffer(pieces.buffers()[1], np.int32)[: len(pieces) + 1].tolist() if len(pieces) else []
    data = pieces.buffers()[2].to_pybytes() if len(pieces) else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def parted(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about TOGETHER bytes; a longer text is alone."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TOGETHER, "right")) - 1)
        yield texts.slice(at, end - at)
        at = end


_machines: dict[str, Machine] = {}


def machine(path: str) -> Machine:
    """The compiled file, once per Python worker."""
    if path not in _machines:
        _machines[path] = Machine(path)
    return _machines[path]
