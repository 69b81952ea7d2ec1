"""Readers.  Each ``read_x(spark, path)`` is ``parse_x`` on text lines or records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandframe.functions.sequence import onehot


def _fields(lines: DataFrame, sep: str = "\t") -> DataFrame:
    """Split non-empty, non-comment lines into an array ``f``."""
    v = F.regexp_replace("value", r"[\r\n]+$", "")
    keep = (v != "") & ~F.startswith(v, F.lit("#"))
    pattern = r"\s+" if sep == "whitespace" else sep
    return lines.filter(keep).select(F.split(v, pattern).alias("f"))


def _f(i: int) -> Column:
    return F.get("f", F.lit(i))


# ---------------------------------------------------------------- matrices
def parse_matrix(
    lines: DataFrame, columns: list[str], sep: str = "\t", name_column: int = 0, data_start: int = 1, fill: float | None = None,
) -> DataFrame:
    """Text matrix lines to ``(row, col, value)``; quotes are stripped, unreadable cells are null or ``fill``."""
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in columns]).alias("col"), F.slice("f", data_start + 1, 2**30).alias("text"))
    row = F.regexp_replace(_f(name_column), r"[\"']", "")
    value = F.col("p.text").try_cast("double")
    if fill is not None:
        value = F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(fill))
    out = _fields(lines, sep).select(row.alias("row"), F.explode(pairs).alias("p"))
    return out.filter(F.col("p.col").isNotNull()).select("row", F.col("p.col").alias("col"), value.alias("value"))


def matrix_header(lines: DataFrame, sep: str = "\t", data_start: int = 1) -> list[str]:
    """Column names: from a first line with ``#``, trimmed from the left to the data width; else numbers.

    Two lines reach the driver.
    """
    top = [r[0] for r in lines.limit(2).collect()]
    width = len(top[-1].split(sep)) - data_start
    if top[0].startswith("#"):
        names = top[0].lstrip("#").strip().split(sep)
        return [n.strip().strip("\"'") for n in names][-width:]
    return [str(i) for i in range(width)]


def read_matrix(spark: SparkSession, path: str, sep: str = "\t", **options) -> DataFrame:
    # a CSV writer quotes the first header cell, which begins with the comment mark
    lines = spark.read.text(path).select(F.regexp_replace("value", r'^"(#[^"]*)"', "$1").alias("value"))
    return parse_matrix(lines, matrix_header(lines, sep), sep, **options)


# --------------------------------------------------------------- sequences
def parse_fasta(records: DataFrame, min_length: int = 10, upper: bool = True) -> DataFrame:
    """FASTA records (text between ``>``) to ``(name, seq)``; multi-line sequences are joined."""
    r = F.regexp_replace("value", "^>", "")
    body = F.regexp_replace(F.expr("substring(__r, length(substring_index(__r, '\\n', 1)) + 2)"), r"[\r\n\s]+", "")
    # a generator keeps its rows as values, so neither the record nor the joined text is made again for each place that names it
    out = records.select(F.explode(F.array(r)).alias("__r")).filter(F.instr("__r", "\n") > 0)
    out = out.select(F.inline(F.array(F.struct(F.trim(F.substring_index("__r", "\n", 1)).alias("name"), body.alias("seq")))))
    out = out.filter(~F.lower("seq").contains("sequenceunavailable") & (F.length("seq") > min_length))
    return out.select("name", (F.upper("seq") if upper else F.col("seq")).alias("seq"))


def read_fasta(spark: SparkSession, path: str, min_length: int = 10, upper: bool = True) -> DataFrame:
    return parse_fasta(spark.read.option("lineSep", ">").text(path), min_length, upper)


def sequences_onehot(seqs: DataFrame) -> DataFrame:
    """Names and dense encodings for a model boundary."""
    return seqs.select("name", onehot(F.col("seq")).alias("onehot"))


def parse_genome(lines: DataFrame, size: int) -> DataFrame:
    """Genome lines ``(chrom, line_no, value)`` to chunks ``(chrom, chunk_no, seq)``.

    FASTA lines of a chromosome have one width (the last may be shorter), so the
    offset of a line is its number times the width and no chromosome-wide sort is
    needed.  A file with uneven lines raises.
    """
    body = lines.filter(~F.startswith("value", F.lit(">")) & (F.length("value") > 0))
    shape = body.groupBy("chrom").agg(
        F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.max(F.length("value")).alias("width"),
    )
    j = body.join(shape, "chrom")
    even = (F.length("value") == F.col("width")) | (F.col("line_no") == F.col("last"))
    at = F.when(even, (F.col("line_no") - F.col("first")) * F.col("width")).otherwise(F.raise_error(F.lit("uneven FASTA lines")).cast("bigint"))
    j = j.select("chrom", F.upper("value").alias("s"), at.cast("bigint").alias("at"))
    ids = F.sequence(F.floor(F.col("at") / size).cast("int"), F.floor((F.col("at") + F.length("s") - 1) / size).cast("int"))
    p = j.select("chrom", "s", "at", F.explode(ids).alias("chunk_no"))
    lo = F.greatest(F.lit(0), F.col("chunk_no").cast("bigint") * size - F.col("at")).cast("int")
    hi = F.least(F.length("s").cast("bigint"), (F.col("chunk_no").cast("bigint") + 1) * size - F.col("at")).cast("int")
    p = p.select("chrom", "chunk_no", F.struct("at", F.substr("s", lo + 1, hi - lo).alias("s")).alias("x"))
    seq = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["s"]), "")
    return p.groupBy("chrom", "chunk_no").agg(seq.alias("seq"))


def read_genome(spark: SparkSession, path: str, size: int = 65_536) -> DataFrame:
    """One chromosome per (gzip) FASTA file; the file stem is the chromosome."""
    chrom = F.regexp_extract(F.input_file_name(), r"([^/]+?)\.(fa|fasta)(\.gz)?$", 1)
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    raw = spark.read.text(path).select(chrom.alias("chrom"), block.alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    # the ids run on inside a file split only: lines before each split come from the counts per split
    splits = raw.groupBy("block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("block.file").orderBy("block.start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("block", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    lines = raw.join(splits, "block").select("chrom", (F.col("before") + F.col("id") - F.col("first")).alias("line_no"), "value")
    return parse_genome(lines, size)


# ------------------------------------------------- annotation, regions, reads
def parse_gtf(lines: DataFrame) -> DataFrame:
    """GTF lines to typed columns; every attribute comes from its own line."""
    def attr(key: str) -> Column:
        return F.nullif(F.regexp_extract(_f(8), rf'{key} "?([^";]+)"?', 1), F.lit(""))

    return _fields(lines).filter(F.size("f") >= 9).select(
        _f(0).alias("chrom"), _f(3).try_cast("bigint").alias("start"), _f(4).try_cast("bigint").alias("end"),
        attr("gene_name").alias("gene_name"), _f(2).alias("feature"), _f(6).alias("strand"),
        F.coalesce(attr("gene_type"), attr("gene_biotype")).alias("gene_type"), _f(1).alias("source"),
        attr("gene_id").alias("gene_id"), attr("transcript_id").alias("transcript_id"),
    )


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    return parse_gtf(spark.read.text(path))


def parse_regions(lines: DataFrame, layout: str = "bed", offset: int = 0) -> DataFrame:
    """``bed``: chrom start end name score strand; ``named``: name chrom start end strand.  ``offset`` 1 for 1-based starts."""
    f = _fields(lines, "whitespace")
    if layout == "bed":
        cols = (_f(3), _f(0), _f(1), _f(2), F.coalesce(_f(5), F.lit(".")))
    else:
        cols = (_f(0), _f(1), _f(2), _f(3), F.coalesce(_f(4), F.lit(".")))
    name, chrom, start, end, strand = cols
    return f.select(
        name.alias("name"), chrom.alias("chrom"), (start.try_cast("bigint") - offset).alias("start"), end.try_cast("bigint").alias("end"),
        strand.alias("strand"),
    )


def read_regions(spark: SparkSession, path: str, layout: str = "bed", offset: int = 0) -> DataFrame:
    return parse_regions(spark.read.text(path), layout, offset)


def parse_alignments(lines: DataFrame) -> DataFrame:
    """Tabular export: read, flag, contig, start, end, mapq, template length."""
    flag = _f(1).try_cast("int")
    return _fields(lines).select(
        _f(0).alias("read"), _f(2).alias("contig"), _f(3).try_cast("bigint").alias("start"), _f(4).try_cast("bigint").alias("end"),
        _f(6).try_cast("bigint").alias("tlen"), (flag.bitwiseAND(16) != 0).alias("reverse"), (flag.bitwiseAND(2) != 0).alias("proper"),
        _f(5).try_cast("int").alias("mapq"), flag.alias("flag"),
    )


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.endswith(".parquet") else parse_alignments(spark.read.text(path))


def parse_signal(lines: DataFrame) -> DataFrame:
    """bedGraph lines; a value that is NaN or unreadable counts as 0."""
    v = _f(3).try_cast("double")
    ok = _fields(lines, "whitespace").filter(~_f(0).isin("track", "browser"))
    return ok.select(
        _f(0).alias("chrom"), _f(1).try_cast("bigint").alias("start"), _f(2).try_cast("bigint").alias("end"),
        F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)).alias("value"),
    )


def read_signal(spark: SparkSession, path: str) -> DataFrame:
    return parse_signal(spark.read.text(path))


def parse_region_annotation(lines: DataFrame) -> DataFrame:
    """``gene region location length`` to sparse ``(gene, region, pos)``; location is ``a-b`` or ``p1,p2,...``."""
    loc = F.col("loc")
    span = F.sequence(F.substring_index(loc, "-", 1).cast("int"), F.substring_index(loc, "-", -1).cast("int") - 1)
    listed = F.transform(F.split(loc, ","), lambda x: x.cast("int"))
    f = _fields(lines, "whitespace").select(_f(0).alias("gene"), _f(1).alias("region"), _f(2).alias("loc"))
    return f.select("gene", "region", F.explode(F.when(loc.contains("-"), span).otherwise(listed)).alias("pos"))


def read_region_annotation(spark: SparkSession, path: str) -> DataFrame:
    return parse_region_annotation(spark.read.text(path))


# ------------------------------------------------------------------- motifs
def _motif_blocks(records: DataFrame) -> DataFrame:
    r = F.regexp_replace("value", r"^\s*(MOTIF|Motif)\s+", "")
    blocks = records.select(r.alias("r")).filter(F.instr("r", "\n") > 0)
    name = F.split(F.trim(F.substring_index("r", "\n", 1)), r"\s+")[0]
    number = r"-?[0-9]+\.?[0-9]*([eE][-+]?[0-9]+)?"
    rows = F.filter(F.transform(F.split("r", "\n"), lambda x: F.trim(x)), lambda x: x.rlike(rf"^({number}\s+){{3,4}}{number}$"))
    bias = F.nullif(F.regexp_extract("r", rf"bias=\s*({number})", 1), F.lit("")).cast("double")
    return blocks.select(name.alias("motif"), rows.alias("rows"), bias.alias("bias")).filter(F.size("rows") > 0)


def parse_motifs(records: DataFrame) -> DataFrame:
    """MEME or tab-text motif records to ``(motif, pos, base, w)``; a leading position number is dropped."""
    b = _motif_blocks(records).select("motif", F.posexplode("rows").alias("pos", "line"))
    vals = F.slice(F.split("line", r"\s+"), F.lit(-4), F.lit(4))
    cells = F.arrays_zip(F.array(*[F.lit(x) for x in "ACGT"]).alias("base"), F.transform(vals, lambda x: x.cast("double")).alias("w"))
    return b.select("motif", "pos", F.inline(cells))


def parse_motif_bias(records: DataFrame) -> DataFrame:
    return _motif_blocks(records).select("motif", "bias")


def motif_records(spark: SparkSession, path: str, marker: str = "MOTIF ") -> DataFrame:
    """The file split on its block marker: ``MOTIF `` for MEME, ``Motif\t`` for tab text."""
    return spark.read.option("lineSep", marker).text(path)


def read_motifs(spark: SparkSession, path: str, marker: str = "MOTIF ") -> DataFrame:
    return parse_motifs(motif_records(spark, path, marker))


def parse_tomtom(lines: DataFrame) -> DataFrame:
    """Match lines to ``(query, target, p, q)``; header, comments and short lines are skipped."""
    f = _fields(lines).filter((F.size("f") >= 6) & _f(3).try_cast("double").isNotNull())
    return f.select(_f(0).alias("query"), _f(1).alias("target"), _f(3).try_cast("double").alias("p"), _f(5).try_cast("double").alias("q"))


def read_tomtom(spark: SparkSession, path: str) -> DataFrame:
    return parse_tomtom(spark.read.text(path))


# ------------------------------------------------------------ counts, design
def parse_counts(lines: DataFrame, design: DataFrame, count_column: int = 1) -> DataFrame:
    """Count lines ``(file, value)`` with a design ``(sample, file, read_type)`` to
    ``(row, col, datatype, value)``; names with ``_`` in front are skipped, genes must occur in
    every file of their data type, NA becomes null."""
    f = lines.select("file", F.split("value", "\t").alias("f")).filter(~F.startswith(_f(0), F.lit("_")))
    t = f.select("file", _f(0).alias("row"), F.nullif(_f(count_column), F.lit("NA")).try_cast("double").alias("value"))
    j = t.join(F.broadcast(design.select("file", F.col("sample").alias("col"), F.col("read_type").alias("datatype"))), "file")
    n = design.groupBy(F.col("read_type").alias("datatype")).agg(F.count_distinct("file").alias("files"))
    full = j.groupBy("datatype", "row").agg(F.count_distinct("file").alias("k")).join(F.broadcast(n), "datatype")
    full = full.filter(F.col("k") == F.col("files")).select("datatype", "row")
    return j.join(full, ["datatype", "row"], "left_semi").select("row", "col", "datatype", "value")


def read_counts(spark: SparkSession, design: DataFrame, paths: list[str], count_column: int = 1) -> DataFrame:
    lines = spark.read.text(paths).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    return parse_counts(lines, design, count_column)


def build_design(sheet: DataFrame) -> DataFrame:
    """Two rows per sample ``(sample, cell, treatment, replicate)``: exonic and intronic, with a cleaned replicate."""
    rep = F.regexp_replace("replicate", "[^A-Za-z0-9]", "")
    types = F.explode(F.array(*[F.struct(F.lit(t).alias("read_type"), F.lit(e).alias("ext")) for t, e in (("exonic", "exon"), ("intronic", "intron"))]))
    return sheet.withColumn("t", types).select(
        "sample", F.concat_ws(".", "sample", "t.ext", F.lit("txt")).alias("file"), F.col("t.read_type").alias("read_type"),
        rep.alias("batch"), F.concat_ws("_", "treatment", "cell").alias("condition"),
    )


# -------------------------------------------------------------------- folds
def parse_folds(records: DataFrame) -> DataFrame:
    """Records of a ``# Set_i`` file (text after the marker) to ``(name, fold)``."""
    r = F.regexp_replace("value", r"^# Set_", "")
    rest = F.expr("substring(r, length(regexp_extract(r, '^(\\\\d+)', 1)) + 1)")
    out = records.select(r.alias("r")).filter(F.col("r").rlike(r"^\d+")).select(
        F.regexp_extract("r", r"^(\d+)", 1).cast("int").alias("fold"), F.explode(F.split(F.trim(rest), r"\s+")).alias("name")
    )
    return out.filter(F.col("name") != "").select("name", "fold")


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    return parse_folds(spark.read.option("lineSep", "# Set_").text(path))
