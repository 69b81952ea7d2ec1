"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of order 1 to ``order`` are mixed from the bottom up.  The
weight of an order depends on how often its context was seen (one weight per power of
two) and is learned by expectation-maximisation on a part of the training documents whose
counts are taken out of the estimates meanwhile.

Counting and looking up are one exchange: documents are packed into blocks of tokens; each
block sends its distinct n-gram hashes, with its own counts, to the buckets they belong to;
a bucket adds up and answers every block in the order asked.  So an n-gram on a third of
all pages is one entry per block, and nothing as large as the model sits in one place.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import hash_words, mix, shuffle_width, stored, text_of

BLOCK_TOKENS = 1_000_000
BUCKET_BYTES = 16 << 20
KEY_BYTES = 6  # of a packed n-gram hash
START = np.uint64(0x5BD1E995A5A5A5A5)
END_WORD = b" "  # no word holds a space
STEP = 16  # bins per octave for the likelihood ratios that the weights are learned from
LEVELS = 64  # context-frequency buckets: powers of two

_words: dict[bytes, int] = {}


def packed(values: np.ndarray) -> bytes:
    """Length and byte planes under zstandard; kind of integer is up to the reader."""
    flat = np.ascontiguousarray(values)
    planes = flat.view(np.uint8).reshape(len(flat), flat.dtype.itemsize).T.tobytes()
    return struct.pack("<I", len(flat)) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    n = struct.unpack_from("<I", data)[0]
    planes = zstandard.ZstdDecompressor().decompress(data[4:]) if n else b""
    return np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, n).T.copy().view(kind).reshape(n)


def token_blocks(docs: DataFrame, fold: Column, id_col: str, text_col: str) -> DataFrame:
    """``block, ids, folds, lengths, words, tokens``: whole documents, about ``BLOCK_TOKENS`` per row."""
    picked = docs.select(F.col(id_col).alias("id"), fold.cast("int").alias("fold"), text_of(text_col).alias("t"))
    kind = picked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        local, parts, at, lengths, size = {}, [], [], [], 0
        ids, folds = [], []

        def flush():
            words = hash_words(list(local), _words)
            id_array = pa.concat_arrays(ids) if ids else None
            row = [
                pa.array([base + seq], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(id_array)], pa.int32()), id_array),
                pa.array([np.concatenate(folds)], pa.list_(pa.int32())), pa.array([lengths], pa.list_(pa.int32())),
                pa.array([packed(words)], pa.binary()), pa.array([packed(np.concatenate(parts))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(row, names=["block", "ids", "folds", "lengths", "words", "tokens"])

        for batch in batches:
            begin = 0
            for i, text in enumerate(batch.column("t").to_pylist()):
                tokens = text.encode("utf-8", "surrogatepass").lower().split()
                tokens.append(END_WORD)
                parts.append(np.array([local.setdefault(t, len(local)) for t in tokens], np.uint32))
                lengths.append(len(tokens))
                size += len(tokens)
                if size >= BLOCK_TOKENS or i == batch.num_rows - 1:
                    ids.append(batch.column("id").slice(begin, i + 1 - begin))
                    folds.append(batch.column("fold").slice(begin, i + 1 - begin).to_numpy(zero_copy_only=False))
                    begin = i + 1
                if size >= BLOCK_TOKENS:
                    yield flush()
                    local, parts, lengths, size, ids, folds, seq = {}, [], [], 0, [], [], seq + 1
        if lengths:
            yield flush()

    return picked.mapInArrow(run, f"block long, ids array<{kind}>, folds array<int>, lengths array<int>, words binary, tokens binary")


def ngram_keys(words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that ends at each token; before a document stands START."""
    h = words[tokens]
    place = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    acc = h.copy()
    for back in range(1, order):
        before = np.full(len(h), START, np.uint64)
        before[back:] = h[: len(h) - back]
        before[place < back] = START
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + before
    return mix(acc + np.uint64(order))


def asked(row: dict, order: int, bucket_bits: int, dev_fold: int, test_fold: int) -> Iterator[tuple]:
    """Per order and bucket: the block's distinct hashes and its counts in training and development documents."""
    words, tokens = unpacked(row["words"], "<u8"), unpacked(row["tokens"], "<u4")
    lengths = np.array(row["lengths"], np.int64)
    fold = np.repeat(np.array(row["folds"], np.int64), lengths)
    for o in range(1, order + 1):
        keys, inverse = np.unique(ngram_keys(words, tokens, lengths, o), return_inverse=True)
        train = np.bincount(inverse, fold != test_fold, len(keys)).astype(np.uint32)
        dev = np.bincount(inverse, fold == dev_fold, len(keys)).astype(np.uint32)
        edges = np.searchsorted(keys >> np.uint64(64 - bucket_bits), np.arange((1 << bucket_bits) + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            cut = slice(edges[b], edges[b + 1])
            gaps = np.diff(keys[cut], prepend=np.uint64(0))
            yield row["block"], b, o, packed(gaps), packed(train[cut]), packed(dev[cut])


def answered(requests: list[tuple]) -> Iterator[tuple]:
    """Answers for one bucket and order: (block, counts), then (None, tokens, distinct, tokens without development)."""
    keys = [np.cumsum(unpacked(r[1], "<u8"), dtype=np.uint64) for r in requests]
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    train = np.bincount(inverse, np.concatenate([unpacked(r[2], "<u4") for r in requests]), len(every)).astype(np.int64)
    dev = np.bincount(inverse, np.concatenate([unpacked(r[3], "<u4") for r in requests]), len(every)).astype(np.int64)
    at = 0
    for (block, *_), k in zip(requests, keys):
        own = inverse[at : at + len(k)]
        at += len(k)
        yield block, packed(train[own]) , packed(dev[own])
    yield None, int(train.sum()), int((train > 0).sum()), int((train - dev).sum())


ANSWERS = "block long, bucket int, ord int, train binary, dev binary, n long, v long, n_base long"


def exchange(blocks: DataFrame, order: int, bucket_bits: int, dev_fold: int, test_fold: int) -> DataFrame:
    """Answers of all buckets to all blocks; rows without a block carry the totals of a bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for o in asked(row, order, bucket_bits, dev_fold, test_fold):
                    yield pa.RecordBatch.from_pylist([dict(zip(("block", "bucket", "ord", "keys", "train", "dev"), o))], schema=ask_schema)

    ask_schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("ord", pa.int32()), ("keys", pa.binary()), ("train", pa.binary()), ("dev", pa.binary())])
    answer_schema = pa.schema(
        [("block", pa.int64()), ("bucket", pa.int32()), ("ord", pa.int32()), ("train", pa.binary()), ("dev", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("n_base", pa.int64())]
    )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(key, held):
            rows = []
            for block, *values in answered(held):
                names = ("train", "dev") if block is not None else ("n", "v", "n_base")
                rows.append({"block": block, "bucket": key[0], "ord": key[1], **dict(zip(names, values))})
            return pa.RecordBatch.from_pylist(rows, schema=answer_schema)

        now, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["bucket"], r["ord"])
                if key != now and held:
                    yield close(now, held)
                    held = []
                now = key
                held.append((r["block"], r["keys"], r["train"], r["dev"]))
        if held:
            yield close(now, held)

    requests = blocks.mapInArrow(ask, "block long, bucket int, ord int, keys binary, train binary, dev binary")
    dealt = requests.repartition(max(1 << bucket_bits, shuffle_width(blocks.sparkSession)), "bucket", "ord").sortWithinPartitions("bucket", "ord")
    return dealt.mapInArrow(answer, ANSWERS)


def token_counts(row: dict, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Place of each token in its document, and per order the counts of the n-gram that ends there."""
    words, tokens = unpacked(row["words"], "<u8"), unpacked(row["tokens"], "<u4")
    lengths = np.array(row["lengths"], np.int64)
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    train, dev = [], []
    for o in range(1, order + 1):
        inverse = np.unique(ngram_keys(words, tokens, lengths, o), return_inverse=True)[1]
        got = sorted((a for a in row["answers"] if a["ord"] == o), key=lambda a: a["bucket"])
        train.append(np.concatenate([unpacked(a["train"], "<i8") for a in got])[inverse])
        dev.append(np.concatenate([unpacked(a["dev"], "<i8") for a in got])[inverse])
    return place, train, dev


def contexts(place: np.ndarray, counts: list[np.ndarray], n_docs: int, order: int) -> np.ndarray:
    """How often the context of each token was seen: the n-gram that ends one token before, or a document's start."""
    out = np.full(len(place), n_docs, np.int64)
    out[1:] = counts[order - 2][:-1]
    # At the first token of a document the context is START alone.
    out[place == 0] = n_docs
    return out


def level(seen: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(seen.astype(np.float64))[1], LEVELS - 1)


def mixed(place: np.ndarray, counts: list[np.ndarray], totals: dict, weights: list[np.ndarray], upto: int) -> np.ndarray:
    """Interpolated probability of every token with the orders up to ``upto``."""
    p = np.full(len(place), 1.0 / (totals["v"] + 1))
    for o in range(1, upto + 1):
        seen = np.full(len(place), totals["n"], np.int64) if o == 1 else contexts(place, counts, totals["docs"], o)
        lam = np.where(seen > 0, weights[o - 1][level(seen)], 0.0)
        p = lam * counts[o - 1] / np.maximum(seen, 1) + (1 - lam) * p
    return p


def learn(bins: list[tuple[int, int | None, float]]) -> np.ndarray:
    """Weights per level by expectation-maximisation over (level, log-ratio bin, weight); a null bin is ratio 0.

    A level without held-out tokens takes the weight of the nearest level below that has some.
    """
    out, last = np.zeros(LEVELS), 0.5
    for b in range(LEVELS):
        rows = [(r, w) for lv, r, w in bins if lv == b]
        if rows:
            ratio = np.array([0.0 if r is None else 2.0 ** (r / STEP) for r, _ in rows])
            weight = np.array([w for _, w in rows])
            lam = 0.5
            for _ in range(500):
                new = float((weight * lam * ratio / (lam * ratio + 1 - lam)).sum() / weight.sum())
                new = min(max(new, 1e-6), 1 - 1e-6)
                done, lam = abs(new - lam) < 1e-9, new
                if done:
                    break
            last = lam
        out[b] = last
    return out


def held_out_bins(dev_rows: DataFrame, totals: dict, weights: list[np.ndarray], order: int) -> list[tuple]:
    """Held-out tokens by context level and likelihood ratio of order ``order`` to the mixture below.

    At most ``LEVELS`` times some thousand rows, whatever the corpus; bins are 1/16 octave wide.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place = unpacked(row["place"], "<i8")
                counts = [unpacked(c, "<i8") for c in row["counts"]]
                below = mixed(place, counts, totals, weights, order - 1)
                seen = np.full(len(place), totals["n"], np.int64) if order == 1 else contexts(place, counts, totals["docs"], order)
                ok = seen > 0
                ml = counts[order - 1][ok] / seen[ok]
                with np.errstate(divide="ignore"):
                    ratio = np.round(np.log2(ml / below[ok]) * STEP)
                cell = np.where(ml > 0, ratio, -1e6).astype(np.int64)
                pairs, n = np.unique(np.stack([level(seen[ok]), cell]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64()), pa.array(n, pa.int64())], names=["lv", "bin", "n"])

    rows = dev_rows.mapInArrow(run, "lv long, bin long, n long").groupBy("lv", "bin").agg(F.sum("n").alias("n")).collect()
    return [(r["lv"], None if r["bin"] == -1_000_000 else r["bin"], float(r["n"])) for r in rows]


def score_texts(
    docs: DataFrame,
    order: int = 2,
    folds: int = 7,
    test_fold: int = 2,
    dev_fold: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    Documents are dealt into ``folds`` by crc32 of the id as text (a null id as empty
    text).  The model learns from all folds but ``test_fold``; ``dev_fold`` is the part of
    these that the mixture weights are learned on.  ``base_score`` is add-one smoothing of
    single words.  A null text is empty and scores its end token only.  Without training
    documents every token has the probability of an unseen word.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
    blocks = stored(token_blocks(docs, fold, id_col, text_col), "token-blocks")
    in_fold = lambda f: F.size(F.filter("folds", f))
    size = blocks.agg(
        F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(in_fold(lambda x: x != test_fold)), F.lit(0)).alias("docs"),
        F.coalesce(F.sum(in_fold(lambda x: x == dev_fold)), F.lit(0)).alias("dev_docs"),
    ).first()
    wanted = max(shuffle_width(spark), size["tokens"] * order * KEY_BYTES // BUCKET_BYTES, 2)
    answers = stored(exchange(blocks, order, int(wanted - 1).bit_length(), dev_fold, test_fold), "answers")
    t = answers.where(F.col("block").isNull() & (F.col("ord") == 1)).agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("n_base").alias("n_base")).first()
    n, v, n_base = t["n"] or 0, t["v"] or 0, t["n_base"] or 0
    per_block = answers.where(F.col("block").isNotNull()).groupBy("block").agg(F.collect_list(F.struct("ord", "bucket", "train", "dev")).alias("answers"))
    joined = stored(blocks.join(per_block, "block"), "answered-blocks")

    def dev_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place, train, dev = token_counts(row, order)
                mine = np.repeat(np.array(row["folds"]) == dev_fold, np.array(row["lengths"], np.int64))
                if mine.any():
                    counts = [packed((a - b)[mine]) for a, b in zip(train, dev)]
                    yield pa.RecordBatch.from_arrays([pa.array([packed(place[mine])], pa.binary()), pa.array([counts], pa.list_(pa.binary()))], names=["place", "counts"])

    dev_rows = stored(joined.mapInArrow(dev_part, "place binary, counts array<binary>"), "held-out-counts")
    weights: list[np.ndarray] = []
    base = {"n": n_base, "v": v, "docs": size["docs"] - size["dev_docs"]}
    for o in range(1, order + 1):
        weights.append(learn(held_out_bins(dev_rows, base, weights, o)))
    totals = {"n": n, "v": v, "docs": size["docs"]}
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                place, train, _ = token_counts(row, order)
                lengths = np.array(row["lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                add = lambda x, starts=starts: np.add.reduceat(x, starts)
                p = mixed(place, train, totals, weights, order)
                columns = [
                    batch.column("ids")[k].values, pa.array(np.array(row["folds"]) == test_fold), pa.array(lengths), pa.array(add((train[0] > 0).astype(np.int64))),
                    pa.array(np.full(len(lengths), n)), pa.array(add(np.log10((train[0] + 1) / (n + v + 1)))), pa.array(add(np.log10(p))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return joined.mapInArrow(score, schema).withColumnRenamed("id", id_col)
