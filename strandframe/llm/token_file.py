"""Token ids in bit-plane files.

A segment holds whole documents.  Its ids are cut into blocks of a fixed number; a block
is transposed into byte or bit planes, each plane is compressed on its own, and a chunk
index at the head of the segment says where each block and plane lies.  Segments are
rows of a Parquet table, so Spark's committer decides which task attempt counts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.llm.common import shuffle_width, text_of
from strandframe.llm.token_machine import machine, parted
from strandframe.session import maybe_broadcast

MAGIC = b"BPS1"


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """Byte planes (4) or bit planes (32) of 32-bit ids, lowest first."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [octets[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def from_planes(raw: list[bytes], n: int) -> np.ndarray:
    if len(raw) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in raw], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in raw], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def write_segment(ids: np.ndarray, block: int = 65_536, planes: str = "byte", level: int = 3) -> bytes:
    """Magic, counts and chunk index (ids, checksum, plane sizes per block), then the planes."""
    pack = zstandard.ZstdCompressor(level=level)
    index, body = [], []
    for at in range(0, len(ids), block):
        part = ids[at : at + block]
        done = [pack.compress(p) for p in to_planes(part, planes)]
        index.append(struct.pack(f"<II{len(done)}I", len(part), zlib.crc32(part.tobytes()), *map(len, done)))
        body += done
    n_planes = 4 if planes == "byte" else 32
    return b"".join([MAGIC, struct.pack("<QIII", len(ids), block, n_planes, len(index)), *index, *body])


def read_segment(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` of a segment; only the blocks that hold them are unpacked."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    n, block, n_planes, n_blocks = struct.unpack_from("<QIII", data, 4)
    last = n if last is None else min(last, n)
    entry = struct.Struct(f"<II{n_planes}I")
    at = 24 + n_blocks * entry.size
    unpack, out, begin = zstandard.ZstdDecompressor(), [], 0
    for b in range(n_blocks):
        count, crc, *sizes = entry.unpack_from(data, 24 + b * entry.size)
        if begin < last and begin + count > first:
            raw, p = [], at
            for size in sizes:
                raw.append(unpack.decompress(data[p : p + size]))
                p += size
            ids = from_planes(raw, count)
            if zlib.crc32(ids.tobytes()) != crc:
                raise ValueError(f"block {b} is damaged")
            out.append(ids[max(0, first - begin) : last - begin])
        begin += count
        at += sum(sizes)
    return np.concatenate(out) if out else np.empty(0, "<u4")


SEGMENT = "part int, segment int, doc_ids array<{id}>, lengths array<long>, n_ids long, payload binary"


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = 65_536,
    planes: str = "byte",
    segment_ids: int = 1 << 20,
) -> None:
    """Encode all texts, append ``end_id`` to each and write segments below ``path``.

    Documents are in ascending order of id over parts and segments (null ids first; rows
    of one id by the hash of the text).  A null text is empty: its only id is ``end_id``.
    An empty table writes an empty table of segments.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    spark = docs.sparkSession
    ordered = keyed.withColumn("h", F.xxhash64("t")).repartitionByRange(shuffle_width(spark), "id", "h").sortWithinPartitions("id", "h")
    sized = ordered.select(F.spark_partition_id().alias("part"), "id", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, held = 0, 0, 0
        ids, parts, lengths = [], [], []

        def flush():
            flat, doc_ids, counts = np.concatenate(parts), pa.concat_arrays(ids), np.concatenate(lengths)
            payload = write_segment(flat, block, planes)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([segment], pa.int32()), one_list(doc_ids), one_list(pa.array(counts, pa.int64())),
                    pa.array([len(flat)], pa.int64()), pa.array([payload], pa.binary()),
                ],
                names=["part", "segment", "doc_ids", "lengths", "n_ids", "payload"],
            )

        for batch in batches:
            at = 0
            for texts in parted(batch.column("t").cast(pa.string())):
                flat, counts = machine(tokenizer).token_ids(texts)
                part = batch.column("part")[0].as_py()
                ids.append(batch.column("id").slice(at, len(texts)))
                lengths.append(counts + 1)
                parts.append(np.insert(flat, np.cumsum(counts), np.uint32(end_id)))
                at, held = at + len(texts), held + len(parts[-1])
                if held >= segment_ids:
                    yield flush()
                    segment, ids, parts, lengths, held = segment + 1, [], [], [], 0
        if ids:
            yield flush()

    sized.mapInArrow(run, SEGMENT.format(id=kind)).write.option("compression", "none").parquet(path)


def one_list(values: pa.Array) -> pa.Array:
    """A list array of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def segment_starts(segments: DataFrame) -> DataFrame:
    """``part, segment, first``: ids before each segment, from totals per part and then inside the part."""
    counts = segments.select("part", "segment", "n_ids")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per part
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_first"))
    inside = W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    own = counts.select("part", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("own"))
    return own.join(parts, "part").select("part", "segment", (F.col("part_first") + F.col("own")).alias("first"))


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, ids`` (ids as little-endian 32-bit binary) of every document, from the files."""
    segments = spark.read.parquet(path)
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    starts = maybe_broadcast(segment_starts(segments))  # else a shuffled join
    placed = segments.drop("n_ids").join(starts, ["part", "segment"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = read_segment(batch.column("payload")[k].as_py())
                lengths = np.array(batch.column("lengths")[k].as_py(), np.int64)
                ends = np.cumsum(lengths)
                raw = ids.tobytes()
                doc_ids = batch.column("doc_ids")[k].values
                starts = ends - lengths + batch.column("first")[k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(starts, pa.int64()), pa.array([raw[4 * (e - n) : 4 * e] for n, e in zip(lengths, ends)], pa.binary())],
                    names=["id", "start", "ids"],
                )

    return placed.select("payload", "lengths", "doc_ids", "first").mapInArrow(run, f"id {kind}, start long, ids binary").withColumnRenamed("id", id_col)
