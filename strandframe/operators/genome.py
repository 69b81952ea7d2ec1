"""Region sequences from a chunked genome ``(chrom, chunk_no, seq)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.sequence import pieces, reverse_complement

CHUNK = 65_536


def genome_chunks(chroms: DataFrame, size: int = CHUNK) -> DataFrame:
    """``(chrom, seq)`` to fixed-size chunks."""
    return chroms.select("chrom", F.posexplode(pieces(F.col("seq"), size)).alias("chunk_no", "seq"))


def windows_from_genome(regions: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """Sequence of each ``(name, chrom, start, end)`` window; bases outside the chromosome are ``N``.

    Windows that lie on several chunks are put together from ordered pieces.
    """
    r = regions.filter("end > start").withColumn(
        "chunk_no",
        F.explode(F.sequence(F.floor(F.col("start") / size).cast("int"), F.floor((F.col("end") - 1) / size).cast("int"))),
    )
    j = r.join(chunks.select("chrom", "chunk_no", F.col("seq").alias("chunk")), ["chrom", "chunk_no"], "left")
    base = F.col("chunk_no").cast("bigint") * size
    lo = (F.greatest(F.col("start"), base) - base).cast("int")
    hi = (F.least(F.col("end"), base + size) - base).cast("int")
    piece = F.rpad(F.coalesce(F.substr("chunk", lo + 1, hi - lo), F.lit("")), hi - lo, F.lit("N"))
    keys = [c for c in regions.columns]
    g = j.withColumn("piece", F.struct("chunk_no", piece.alias("s"))).groupBy(*keys).agg(F.sort_array(F.collect_list("piece")).alias("p"))
    return g.select(*keys, F.array_join(F.transform("p", lambda x: x["s"]), "").alias("seq"))


def extract_region_sequences(
    regions: DataFrame, chunks: DataFrame, flank: int = 0, extend_to: int | None = None, from_tss: bool = False,
    one_index: bool = False, size: int = CHUNK, save_positions: bool = False,
) -> DataFrame:
    """Sequences of regions with flanks, centred extension or strand-aware TSS windows.

    Plain regions keep the strand as is.  With ``from_tss`` a minus-strand region is the
    reverse complement around its end, and strand ``.`` gives a forward and a ``.rev`` row.
    """
    off = 1 if one_index else 0
    s, e = F.col("start") - off, F.col("end") - off
    if from_tss:
        fwd = F.struct(F.col("name").alias("name"), (s - flank).alias("start"), (s + flank).alias("end"), F.lit(False).alias("rc"))
        rev = F.struct(F.col("name").alias("name"), (e - flank).alias("start"), (e + flank).alias("end"), F.lit(True).alias("rc"))
        rev2 = F.struct(
            F.concat(F.col("name"), F.lit(".rev")).alias("name"), (e - flank).alias("start"), (e + flank).alias("end"), F.lit(True).alias("rc")
        )
        parts = F.when(F.col("strand") == "+", F.array(fwd)).when(F.col("strand") == "-", F.array(rev)).otherwise(F.array(fwd, rev2))
        w = regions.select("chrom", F.inline(parts))
    else:
        extra = F.lit(extend_to) - (F.col("end") - F.col("start")) if extend_to else F.lit(0)
        before = F.floor(extra / 2)
        w = regions.select(
            "name", "chrom", (s - before - flank).alias("start"), (e + extra - before + flank).alias("end"), F.lit(False).alias("rc")
        )
    out = windows_from_genome(w, chunks, size)
    seq = F.when(F.col("rc"), reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq")
    return out.select("name", *(["chrom", "start", "end"] if save_positions else []), seq)


def assemble_transcripts(exons: DataFrame, chunks: DataFrame, flank: int = 0, size: int = CHUNK) -> DataFrame:
    """Exons ``(name, chrom, start, end, strand)`` joined in order; minus strand reverse-complemented and prepended."""
    w = exons.select("name", "chrom", "strand", "start", (F.col("start") - flank).alias("ws"), (F.col("end") + flank).alias("we"))
    got = windows_from_genome(
        w.select("name", "chrom", "strand", F.col("start").alias("order"), F.col("ws").alias("start"), F.col("we").alias("end")), chunks, size
    )
    plus = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order", "seq"))), lambda x: x["seq"]), "")
    g = got.groupBy("name", "strand").agg(plus.alias("seq"))
    return g.select("name", F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))
