"""Writers: each ``format_*`` gives lines as a DataFrame, each ``write_*`` saves them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASES = ["A", "C", "G", "T"]


def wide_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pivot a long matrix to one column per name of an explicit list."""
    return df.groupBy("row").pivot("col", columns).agg(F.sum("value"))


def write_matrix(df: DataFrame, path: str, columns: list[str], digits: int | None = None, sep: str = "\t") -> None:
    wide = wide_matrix(df, columns)
    if digits is not None:
        wide = wide.select("row", *[F.round(c, digits).alias(c) for c in columns])
    # the header of each part file is a comment line for readers
    wide.withColumnRenamed("row", "# row").write.mode("overwrite").csv(path, sep=sep, header=True)


def format_fasta(seqs: DataFrame) -> DataFrame:
    """One record string per sequence."""
    return seqs.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq")).alias("value"))


def write_fasta(seqs: DataFrame, path: str) -> None:
    format_fasta(seqs).write.mode("overwrite").text(path)


def motif_rows(motifs: DataFrame) -> DataFrame:
    """Long motif cells to ``(motif, m)`` with rows in position order and A, C, G, T columns."""
    cell = [F.max(F.when(F.col("base") == b, F.col("w"))).alias(b) for b in BASES]
    pos = motifs.groupBy("motif", "pos").agg(*cell)
    row = F.array(*[F.coalesce(F.col(b), F.lit(0.0)) for b in BASES])
    return pos.groupBy("motif").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", row.alias("r")))), lambda x: x["r"]).alias("m")
    )


def format_motifs(motifs: DataFrame, digits: int = 4, bias: DataFrame | None = None) -> DataFrame:
    """One MEME block string per motif; ``bias`` ``(motif, bias)`` adds ``bias= x``."""
    m = motif_rows(motifs)
    if bias is not None:
        m = m.join(bias, "motif", "left")
        extra = F.concat(F.lit(" bias= "), F.col("bias").cast("string"))
    else:
        extra = F.lit("")
    lines = F.array_join(
        F.transform("m", lambda r: F.array_join(F.transform(r, lambda x: F.format_number(x, digits)), "\t")), "\n"
    )
    head = F.concat(
        F.lit("MOTIF "), F.col("motif"), F.lit("\nletter-probability matrix: alength= 4 w= "), F.size("m").cast("string"), extra, F.lit("\n")
    )
    return m.select(F.concat(head, lines, F.lit("\n")).alias("value"))


def write_motifs(motifs: DataFrame, path: str, digits: int = 4, bias: DataFrame | None = None) -> None:
    format_motifs(motifs, digits, bias).write.mode("overwrite").text(path)


def format_tomtom(matches: DataFrame, cutoff: float | None = None) -> DataFrame:
    """Tab lines of passing pairs: query, target, offset, p, correlation, q, orientation."""
    m = matches if cutoff is None else matches.filter(F.col("q") <= cutoff)
    cols = ["query", "target", "offset", "p", "correlation", "q", "orientation"]
    return m.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in cols]).alias("value"))


def write_tomtom(matches: DataFrame, path: str, cutoff: float | None = None) -> None:
    cols = ["query", "target", "offset", "p", "correlation", "q", "orientation"]
    m = matches if cutoff is None else matches.filter(F.col("q") <= cutoff)
    m.select(*cols).write.mode("overwrite").csv(path, sep="\t", header=True)


def format_folds(folds: DataFrame) -> DataFrame:
    """Fold lines ``# Set_i`` and names; a set is written in parts of bounded size."""
    part = F.pmod(F.xxhash64("name"), F.lit(4096))
    g = folds.groupBy("fold", part.alias("part")).agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("names"))
    return g.select(F.concat(F.lit("# Set_"), F.col("fold").cast("string"), F.lit("\n"), F.col("names")).alias("value"))


def write_folds(folds: DataFrame, path: str) -> None:
    format_folds(folds).write.mode("overwrite").text(path)


def motif_bed(seqlets: DataFrame, regions: DataFrame, labels: DataFrame) -> DataFrame:
    """BED rows of seqlets: coordinates moved by the region start, name from the cluster label."""
    j = seqlets.join(regions.select(F.col("name").alias("seq"), "chrom", F.col("start").alias("rs")), "seq")
    j = j.join(labels, "cluster", "left")
    return j.select(
        "seq", "track", "chrom", (F.col("rs") + F.col("start")).alias("start"), (F.col("rs") + F.col("end") + 1).alias("end"),
        F.coalesce("label", F.col("cluster").cast("string")).alias("name"), F.col("max").alias("score"),
    )


def write_motif_bed(bed: DataFrame, path: str) -> None:
    """One folder per (sequence, track)."""
    bed.write.mode("overwrite").partitionBy("seq", "track").csv(path, sep="\t")
