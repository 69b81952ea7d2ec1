"""Words, line hashes and stored intermediate tables shared by the text operators."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.session import ensure_checkpoint_dir

# White space that separates words: space and the five ASCII control characters.
BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str) -> Column:
    """The text column with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of words; empty for a text without any."""
    return F.array_remove(F.split(text, BREAK), "")


def settled(df: DataFrame) -> DataFrame:
    """The same rows through a generator of one row each.

    The optimiser moves no expression across it, so what ``df`` computes is computed
    once per row, however often the columns are used above.
    """
    return df.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` that driver and executors all see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage and makes task-dependent values (row order, partition ids) final:
    a lost executor costs a re-read, never another result.  The folder lies under the
    checkpoint folder and is removed with it.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


FILTER_BITS = 1 << 23  # one megabyte, whatever the number of keys


def key_filter(keys: DataFrame, col: str, bits: int = FILTER_BITS) -> bytes:
    """Bitmap of a long column: bit ``value mod bits`` is set for each key.

    Fixed size, so it may be sent to every task; a row whose bit is unset has no
    partner, one whose bit is set is joined as usual.
    """
    place = F.pmod(F.col(col), F.lit(bits))
    held = (
        keys.where(F.col(col).isNotNull())
        .select((place / 64).cast("long").alias("w"), F.expr(f"shiftleft(1L, CAST(pmod({col}, {bits}) % 64 AS INT))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    out = np.zeros(bits // 64, np.int64)
    rows = held.collect()  # at most bits / 64 rows
    if rows:
        out[[r["w"] for r in rows]] = [r["b"] for r in rows]
    return out.tobytes()


def may_hold(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True for keys that can be in the filter; ``bitmap`` is ``key_filter`` as bytes."""
    place = keys.astype(np.int64) % (len(bitmap) * 8)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def hash_words(tokens: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words; ``known`` is the worker's memory of hashes, cleared when large."""
    if len(known) > 1_000_000:
        known.clear()
    try:
        return np.array([known[t] for t in tokens], np.uint64)
    except KeyError:
        for t in tokens:
            if t not in known:
                known[t] = xxhash.xxh3_64_intdigest(t)
    return np.array([known[t] for t in tokens], np.uint64)


STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit hash spread over the whole word."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_sums(h: np.ndarray, size: int) -> np.ndarray:
    """Sum per window of ``size`` consecutive word hashes: the hash at place k times STEP to the power size - 1 - k."""
    n = len(h) - size + 1
    acc = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        acc = acc * STEP + h[k : k + len(acc)]
    return acc


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` consecutive word hashes."""
    return mix(window_sums(h, size))
