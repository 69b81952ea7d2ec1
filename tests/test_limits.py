"""No bound on words, rounds or file splits; files read back as written."""

from pyspark.sql import functions as F

from strandframe.operators import joins as J
from strandframe.operators.cluster import connected_components
from strandframe.operators.stats import correlation
from strandframe.sources.sinks import write_matrix
from strandframe.sources.text import read_genome, read_matrix


def test_genome_in_many_splits(spark, tmp_path):
    letters = "".join("ACGT"[(k * k + k // 7) % 4] for k in range(60_000))
    (tmp_path / "chrT.fa").write_text(">chrT\n" + "".join(letters[k : k + 60] + "\n" for k in range(0, 60_000, 60)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000b")
        rows = read_genome(spark, str(tmp_path / "chrT.fa"), 1000).orderBy("chunk_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.chunk_no for r in rows] == list(range(60)) and "".join(r.seq for r in rows) == letters


def test_matrix_round_trip_in_parts(spark, tmp_path):
    cells = spark.createDataFrame([(f"r{i}", c, float(i * k)) for i in range(40) for k, c in enumerate("xyz")], "row string, col string, value double")
    write_matrix(cells.repartition(5, "row"), str(tmp_path / "m"), ["x", "y", "z"])
    assert sorted(map(tuple, read_matrix(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, cells.collect()))


def test_substring_membership_by_brute_force(spark):
    names = ["Alpha", "alp", "beta-x", "", None, "gamma", "zz", "a"]
    words = ["LPH", "beta-x-y", "mm", "q", "b", "lph"]
    left = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    got = {r.i for r in J.substring_membership(left, spark.createDataFrame([(w,) for w in words], "w string")).collect()}
    up = [w.upper() for w in words]
    assert got == {i for i, n in enumerate(names) if n is not None and any(w in n.upper() or n.upper() in w for w in up)}
    assert J.substring_membership(left, spark.createDataFrame([], "w string")).count() == 0


def test_greedy_runs_to_the_end(spark):
    rows = [(f"a{i}", f"b{j}", float(100 - abs(i - j) * 7 - i)) for i in range(12) for j in range(12)]
    got = {(r.a, r.b) for r in J.match_unique_greedy(spark.createDataFrame(rows, "a string, b string, score double")).collect()}
    free_a, free_b, want = set(), set(), set()
    for a, b, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in free_a and b not in free_b:
            free_a.add(a), free_b.add(b), want.add((a, b))
    assert got == want


def test_components_of_a_long_chain(spark):
    nodes = spark.range(300).select("id")
    edges = nodes.filter("id < 299").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(nodes, edges).collect()} == {0}


def test_correlation_uses_full_pairs_only(spark):
    rows = [("k", 1.0, 2.0), ("k", 2.0, 4.0), ("k", 3.0, 6.5), ("k", 50.0, None), ("k", None, -9.0)]
    df = spark.createDataFrame(rows, "row string, a double, b double")
    full = df.filter("a IS NOT NULL AND b IS NOT NULL")
    assert abs(correlation(df, ["row"]).first()[1] - correlation(full, ["row"]).first()[1]) < 1e-12
