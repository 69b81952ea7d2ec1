import gzip

import pytest

from strandframe.sources import sinks, text


def test_fasta_file(spark, tmp_path):
    p = tmp_path / "a.fasta"
    p.write_text(">s1 \nacgtacgtac\ngtac\n>short\nACGT\n>gone\nSequence unavailable\n>s2\nNNNNACGTACGT\n")
    got = {r["name"]: r["seq"] for r in text.read_fasta(spark, str(p)).collect()}
    assert got == {"s1": "ACGTACGTACGTAC", "s2": "NNNNACGTACGT"}
    out = str(tmp_path / "out")
    sinks.write_fasta(text.read_fasta(spark, str(p)), out)
    assert {r["name"] for r in text.read_fasta(spark, out).collect()} == {"s1", "s2"}


def test_genome_file(spark, tmp_path):
    seq = "acgtn" * 21
    with gzip.open(tmp_path / "chr7.fa.gz", "wt") as f:
        f.write(">chr7\n" + "\n".join(seq[i : i + 10] for i in range(0, len(seq), 10)) + "\n")
    got = {r["chunk_no"]: r["seq"] for r in text.read_genome(spark, str(tmp_path), 32).collect() if r["chrom"] == "chr7"}
    assert "".join(got[i] for i in range(4)) == seq.upper() and [len(got[i]) for i in range(4)] == [32, 32, 32, 9]


def test_uneven_genome_raises(spark):
    lines = spark.createDataFrame([("c", 0, "ACG"), ("c", 1, "ACGTA"), ("c", 2, "ACGTA")], "chrom string, line_no long, value string")
    with pytest.raises(Exception, match="uneven"):
        text.parse_genome(lines, 4).collect()


def test_matrix_file(spark, tmp_path):
    p = tmp_path / "m.tsv"
    p.write_text("# name\tx\ty\n\"g1\"\t1\tNA\ng2\t2.5\tnan\n")
    got = {(r["row"], r["col"]): r["value"] for r in text.read_matrix(spark, str(p), fill=-1.0).collect()}
    assert got == {("g1", "x"): 1.0, ("g1", "y"): -1.0, ("g2", "x"): 2.5, ("g2", "y"): -1.0}


def test_motif_files(spark, tmp_path):
    rows = [("m1", i, b, w) for i, r in enumerate([[0.1, 0.2, 0.3, 0.4], [1, 0, 0, 0]]) for b, w in zip("ACGT", map(float, r))]
    m = spark.createDataFrame(rows, "motif string, pos int, base string, w double")
    out = str(tmp_path / "meme")
    bias = spark.createDataFrame([("m1", -1.5)], "motif string, bias double")
    sinks.write_motifs(m, out, 6, bias)
    got = sorted(tuple(r) for r in text.read_motifs(spark, out).collect())
    assert got == sorted(rows)
    assert text.parse_motif_bias(text.motif_records(spark, out)).first()["bias"] == -1.5
    tab = tmp_path / "a.pwm"
    tab.write_text("Motif\tk1\nPos\tA\tC\tG\tT\n1\t0.5\t0.5\t0\t0\n2\t0\t0\t1e-1\t0.9\n\nMotif\tk2\n1\t1\t0\t0\t0\n")
    got = {(r["motif"], r["pos"], r["base"]): r["w"] for r in text.read_motifs(spark, str(tab), "Motif\t").collect()}
    assert got[("k1", 1, "G")] == 0.1 and got[("k2", 0, "A")] == 1.0 and len(got) == 12


def test_annotation_and_regions(spark, tmp_path):
    g = tmp_path / "a.gtf"
    g.write_text('#c\nchr1\tsrc\tgene\t10\t20\t.\t+\t.\tgene_id "G1.2"; gene_name "N"; gene_type "pc";\nchr1\tsrc\texon\t10\t12\t.\t-\t.\tgene_id "G2"; transcript_id "T";\n')
    got = [tuple(r) for r in text.read_gtf(spark, str(g)).orderBy("gene_id").collect()]
    assert got[0] == ("chr1", 10, 20, "N", "gene", "+", "pc", "src", "G1.2", None) and got[1][-1] == "T" and got[1][3] is None
    b = tmp_path / "a.bed"
    b.write_text("chr1\t11\t20\tr1\t0\t-\n")
    assert tuple(text.read_regions(spark, str(b), offset=1).first()) == ("r1", "chr1", 10, 20, "-")
    n = tmp_path / "n.bed"
    n.write_text("r1 chr1 5 9\n")
    assert tuple(text.read_regions(spark, str(n), "named").first()) == ("r1", "chr1", 5, 9, ".")


def test_folds_file(spark, tmp_path):
    p = tmp_path / "folds.txt"
    p.write_text("# Set_0\na b\n# Set_1\nc\n")
    assert sorted(tuple(r) for r in text.read_folds(spark, str(p)).collect()) == [("a", 0), ("b", 0), ("c", 1)]
    out = str(tmp_path / "out")
    sinks.write_folds(text.read_folds(spark, str(p)), out)
    assert text.read_folds(spark, out).count() == 3


def test_tomtom_and_counts(spark, tmp_path):
    t = tmp_path / "t.tsv"
    t.write_text("Query\tTarget\toff\tp-value\tE\tq-value\n#x\nq1\tT1\t0\t0.01\t1\t0.05\nshort\n")
    assert tuple(text.read_tomtom(spark, str(t)).first()) == ("q1", "T1", 0.01, 0.05)
    (tmp_path / "s1.txt").write_text("g1\t3\ng2\tNA\n__x\t9\n")
    (tmp_path / "s2.txt").write_text("g1\t4\ng2\t1\ng3\t1\n")
    d = spark.createDataFrame([("s1", "s1.txt", "exonic"), ("s2", "s2.txt", "exonic")], "sample string, file string, read_type string")
    got = {(r["row"], r["col"]): r["value"] for r in text.read_counts(spark, d, [str(tmp_path / "s1.txt"), str(tmp_path / "s2.txt")]).collect()}
    assert got == {("g1", "s1"): 3.0, ("g1", "s2"): 4.0, ("g2", "s1"): None, ("g2", "s2"): 1.0}


def test_region_annotation(spark, tmp_path):
    p = tmp_path / "r.txt"
    p.write_text("g utr 0-3 10\ng cds 5,7 10\n")
    got = sorted((r["region"], r["pos"]) for r in text.read_region_annotation(spark, str(p)).collect())
    assert got == [("cds", 5), ("cds", 7), ("utr", 0), ("utr", 1), ("utr", 2)]


def test_matrix_writer_and_bed(spark, tmp_path):
    df = spark.createDataFrame([("r", "x", 1.26)], "row string, col string, value double")
    sinks.write_matrix(df, str(tmp_path / "m"), ["x", "y"], 1)
    assert spark.read.csv(str(tmp_path / "m"), sep="\t", header=True).first()["x"] == "1.3"
    s = spark.createDataFrame([("q", "t", 3, 6, 1, 0.5)], "seq string, track string, start int, end int, cluster int, max double")
    r = spark.createDataFrame([("q", "chr1", 100)], "name string, chrom string, start long")
    lab = spark.createDataFrame([(1, "c1(A)")], "cluster int, label string")
    bed = sinks.motif_bed(s, r, lab)
    assert (bed.first()["start"], bed.first()["end"], bed.first()["name"]) == (103, 107, "c1(A)")
    sinks.write_motif_bed(bed, str(tmp_path / "bed"))
    assert (tmp_path / "bed" / "seq=q" / "track=t").is_dir()
