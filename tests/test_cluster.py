import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators import cluster as K
from strandframe.operators import folds as FO
from strandframe.operators import graph
from strandframe.operators import joins as J
from strandframe.operators import linkage as L
from strandframe.operators.blocks import against_reference


def naive_labels(d, method, threshold):
    groups = [[i] for i in range(len(d))]
    f = {"single": np.min, "complete": np.max, "average": np.mean}[method]
    while len(groups) > 1:
        h, i, j = min((f(d[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if h >= threshold:
            break
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def points(spark, x):
    return spark.createDataFrame([(f"p{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, vec array<double>")


def sets(rows, key="cluster"):
    out = {}
    for r in rows:
        out.setdefault(r[key], set()).add(int(r["id"][1:]))
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("method", ["single", "complete", "average"])
def test_components_then_linkage_is_exact(spark, method):
    x = np.random.default_rng(7).random((40, 3))
    d = K.distances(x, x, "euclidean")
    got = K.agglomerative_cluster(points(spark, x), "euclidean", method, 0.35).collect()
    assert sets(got) == naive_labels(d, method, 0.35)


def chain_merges(d, method):
    """The whole tree by merging the closest pair, one after the other; the smaller first member names a cluster."""
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, out = np.ones(len(d)), []
    for _ in range(len(d) - 1):
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        out.append((i, j, d[i, j]))
        x, y = d[i], d[j]
        new = {"single": np.minimum(x, y), "complete": np.maximum(x, y), "average": (size[i] * x + size[j] * y) / (size[i] + size[j])}[method]
        size[i] += size[j]
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
    return out


@pytest.mark.parametrize("method, metric", [("single", "euclidean"), ("complete", "cosine"), ("average", "cityblock"), ("average", "correlation")])
def test_rounds_over_tables_give_the_whole_tree(spark, method, metric):
    x = np.random.default_rng(21).normal(size=(24, 5))
    p = points(spark, x).selectExpr("'g' AS grp", "id", "vec")
    want = chain_merges(K.distances(x, x, metric), method)
    for local, block in ((8, 8), (100, 2000)):
        rows = L.merge_table(p, metric, method, None, local, block).collect()
        got = sorted((r["height"], int(r["a"][1:]), int(r["b"][1:])) for r in rows)
        assert len(got) == 23 and all(g[1:] == w[:2] and g[0] == pytest.approx(w[2]) for g, w in zip(got, want))
    cut = K.agglomerative_cluster(points(spark, x), metric, method, n_clusters=6, local=8).collect()
    where = {i: {i} for i in range(24)}
    for i, j, _ in want[:18]:
        where[i] = where[i] | where.pop(j)
    assert sets(cut) == {frozenset(v) for v in where.values()}
    if metric != "correlation":
        return
    order = {int(r["id"][1:]): r["leaf"] for r in K.order_by_hierarchy(points(spark, x), metric, method, local=8).collect()}
    line = {i: [i] for i in range(24)}
    for i, j, _ in want:
        line[i] = line[i] + line.pop(j)
    assert [order[i] for i in line[0]] == list(range(24))


@pytest.mark.parametrize("method", ["single", "complete", "average"])
def test_components_over_tables(spark, method):
    x = np.random.default_rng(7).random((40, 3))
    d = K.distances(x, x, "euclidean")
    got = K.agglomerative_cluster(points(spark, x), "euclidean", method, 0.35, local=6).collect()
    assert sets(got) == naive_labels(d, method, 0.35)


def test_tied_points(spark):
    x = np.array([[0.0], [0.0], [0.0], [1.0], [1.0], [2.0], [2.0], [3.0]])
    for method in ("single", "complete"):
        one = K.agglomerative_cluster(points(spark, x), "euclidean", method, 0.5, local=1).collect()
        assert sets(one) == {frozenset(g) for g in ({0, 1, 2}, {3, 4}, {5, 6}, {7})}
    same = K.agglomerative_cluster(points(spark, np.ones((9, 3))), "correlation", "average", n_clusters=1, local=1).collect()
    assert sets(same) == {frozenset(range(9))}
    assert K.order_by_hierarchy(points(spark, x[:1])).collect()[0]["leaf"] == 0
    assert K.agglomerative_cluster(points(spark, x).limit(0), "euclidean", "average", 1.0).count() == 0


def test_blobs(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(c, 0.05, (60, 2)) for c in (0, 5)])
    got = K.agglomerative_cluster(points(spark, x), "euclidean", "complete", 1.0, local=30).collect()
    assert len(got) == 120
    labelled = {k for k in {r["cluster"] for r in got} if k != "-1"}
    assert len(labelled) == 2
    sides = {c: {int(r["id"][1:]) < 60 for r in got if r["cluster"] == c} for c in labelled}
    assert all(len(s) == 1 for s in sides.values())


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)]
    hub = [("h", f"x{i}") for i in range(40)]
    edges = spark.createDataFrame(chain + hub, "a string, b string")
    nodes = edges.selectExpr("a AS id").union(edges.selectExpr("b AS id")).union(spark.createDataFrame([("alone",)], "id string"))
    got = {r["id"]: r["component"] for r in K.connected_components(nodes, edges).collect()}
    assert {got[f"c{i:02d}"] for i in range(31)} == {"c00"} and {got[f"x{i}"] for i in range(40)} == {"h"} and got["alone"] == "alone"


def test_components_send_fewer_links_every_round(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pairs = {(f"g{g}n{i}", f"g{g}n{j}") for g in range(3) for i, j in rng.integers(0, 30, (200, 2)).tolist()}
    edges = spark.createDataFrame(sorted(pairs), "a string, b string")
    nodes = edges.selectExpr("a AS id").union(edges.selectExpr("b AS id"))
    sent, real = [], graph.written

    def spied(df):
        out = real(df)
        if out.columns == ["a", "b"]:
            sent.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", spied)
    got = {r["id"]: r["component"] for r in K.connected_components(nodes, edges).collect()}
    assert got == {n: min(m for m in got if m[:3] == n[:3]) for n in got} and len(got) == nodes.distinct().count()
    assert len(sent) > 2 and sent[-1] == 0 and all(a > b for a, b in zip(sent, sent[1:]))


def test_components_of_nulls_copies_and_ids_outside(spark):
    nodes = spark.createDataFrame([(k,) for k in (5, 4, 3, 2, 9, 9, None)], "id int")
    edges = spark.createDataFrame([(5, 4), (4, 5), (5, 4), (3, 3), (3, 7), (7, 2), (9, None), (None, None)], "a long, b long")
    got = K.connected_components(nodes, edges)
    assert sorted(map(tuple, got.collect())) == [(2, 2), (3, 3), (4, 4), (5, 4), (9, 9)] and dict(got.dtypes)["component"] == "int"


def test_components_hash_again_when_two_ids_share_a_key(spark, monkeypatch):
    tried, real = [], graph.F.xxhash64

    def spied(*columns):
        tried.append(1)
        return graph.F.lit(7).cast("long") if len(tried) == 1 else real(*columns)

    monkeypatch.setattr(graph.F, "xxhash64", spied)
    edges = spark.createDataFrame([("a", "b"), ("c", "d")], "a string, b string")
    nodes = edges.selectExpr("a AS id").union(edges.selectExpr("b AS id"))
    assert sorted(map(tuple, K.connected_components(nodes, edges).collect())) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")]


def test_near_pairs_over_blocks(spark):
    x = np.random.default_rng(9).random((50, 2))
    d = K.distances(x, x, "euclidean")
    p = points(spark, x).selectExpr("'g' AS grp", "id", "vec")
    got = {(int(r["a"][1:]), int(r["b"][1:])) for r in K.near_pairs(p, "euclidean", 0.2, block=8).collect()}
    assert got == {(i, j) for i in range(50) for j in range(i + 1, 50) if d[i, j] < 0.2}


def test_greedy_matching(spark):
    rng = np.random.default_rng(10)
    s = rng.integers(0, 6, (9, 7)) / 10.0
    rows = [(f"a{i}", f"b{j}", float(s[i, j])) for i in range(9) for j in range(7)]
    got = {(r["a"], r["b"]) for r in J.match_unique_greedy(spark.createDataFrame(rows, "a string, b string, score double")).collect()}
    used_a, used_b, want = set(), set(), set()
    for a, b, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in used_a and b not in used_b:
            want.add((a, b))
            used_a.add(a)
            used_b.add(b)
    assert got == want


def test_reference_blocks(spark):
    import pandas as pd

    a = spark.createDataFrame([(f"a{i}", float(i)) for i in range(30)], "id string, x double")

    def compare(left, right):
        d = np.abs(left["x"].to_numpy()[:, None] - right["x"].to_numpy()[None] - 0.4)
        return pd.DataFrame({"id": left["id"].to_numpy(), "d": d.min(1)})

    one = {r["id"]: r["d"] for r in against_reference(a, a, compare, "id string, d double", "id", "id").collect()}
    parts = against_reference(a, a, compare, "id string, d double", "id", "id", bound=7, left_rows=9).groupBy("id").min("d").collect()
    assert one == {r["id"]: r["min(d)"] for r in parts}


def test_folds(spark):
    df = spark.createDataFrame([(f"n{i}", "ab"[i % 3 == 0]) for i in range(90)], "name string, c string")
    f = FO.stratified_folds(df, 3, label="c", seed=1)
    per = {(r["c"], r["fold"]): r["count"] for r in f.join(df, "name").groupBy("c", "fold").count().collect()}
    assert per == {("a", i): 20 for i in range(3)} | {("b", i): 10 for i in range(3)}
    assert f.select("name").distinct().count() == 90
    g = spark.createDataFrame([(f"n{i}", f"chr{i % 7}") for i in range(140)], "name string, g string")
    out = FO.group_balanced_folds(g, "g", 3)
    assert out.join(g, "name").groupBy("g").agg({"fold": "min"}).count() == 7
    assert out.join(g, "name").select("g", "fold").distinct().count() == 7
    sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert sorted(sizes) == [40, 40, 60]


def test_medoids_from_blocks(spark):
    x = np.random.default_rng(12).random((30, 3))
    d = K.distances(x, x, "euclidean")
    p = points(spark, x).selectExpr("if(id < 'p012', 'g', 'h') AS grp", "id", "vec")
    got = {r["cluster"]: (r["medoid"], r["radius"]) for r in K.medoids(p, "euclidean", block=5).collect()}
    for g, m in (("g", np.arange(12)), ("h", np.arange(12, 30))):
        sub = d[np.ix_(m, m)]
        k = int(sub.sum(1).argmin())
        assert got[g][0] == f"p{m[k]:03d}" and got[g][1] == pytest.approx(sub[k].max())


def test_rare_grams_lose_no_pair(spark):
    rng = np.random.default_rng(13)
    words = ["heart", "liver", "naive", "tcell", "bcell", "h3k4", "atac", "rep1", "rep2"]
    names = sorted({"_".join(rng.choice(words, 3)) for _ in range(40)})
    a = spark.createDataFrame([(n,) for n in names[::2]], "name string")
    b = spark.createDataFrame([(n,) for n in names[1::2]], "name string")
    full = {(r["a"], r["b"]): r["similarity"] for r in J.string_similarity_join(a, b).collect()}
    cut = {(r["a"], r["b"]): r["similarity"] for r in J.string_similarity_join(a, b, min_similarity=0.5).collect()}
    assert cut == {k: v for k, v in full.items() if v >= 0.5} and cut


def test_falling_bounds_match_like_all_pairs(spark):
    rng = np.random.default_rng(19)
    words = ["heart", "liver", "naive", "tcell", "bcell", "h3k4", "atac", "rep1", "rep2", "kid", "lung"]
    names = lambda n: sorted({"_".join(rng.choice(words, rng.integers(2, 5))) for _ in range(n)})
    a = spark.createDataFrame([(n,) for n in [*names(40), None]], "name string")
    b = spark.createDataFrame([(n,) for n in [*names(50), "zzzz"]], "name string")
    got = {(r["a"], r["b"]) for r in J.match_names(a, b, (0.7, 0.4, 0.0)).collect()}
    used_a, used_b, want = set(), set(), set()
    for r in sorted(J.string_similarity_join(a.where("name IS NOT NULL"), b).collect(), key=lambda r: (-r["similarity"], r["a"], r["b"])):
        if r["a"] not in used_a and r["b"] not in used_b:
            want.add((r["a"], r["b"]))
            used_a.add(r["a"])
            used_b.add(r["b"])
    assert got == want and len(got) > 20


def test_representatives_from_blocks(spark):
    x = np.random.default_rng(14).random((24, 3))
    d = K.distances(x, x, "euclidean")
    p = points(spark, x).selectExpr("'g' AS grp", "id", "vec")
    got = K.representatives(p, "euclidean", consider=10, block=5).first()
    rows = [(f"p{i:03d}", f"p{j:03d}", float(d[i, j])) for i in range(24) for j in range(24) if i != j]
    pairs = spark.createDataFrame(rows, "a string, b string, dist double")
    names = spark.createDataFrame([(f"p{i:03d}", "g") for i in range(24)], "name string, cluster string")
    assert got == K.cluster_representatives(pairs, names, 10).first()


def best_of_tries(sizes, folds, tries=400):
    """Mean deviation of the best of many random deals, each group to the fold with least so far."""
    rng = np.random.default_rng(0)
    best = np.inf
    for _ in range(tries):
        total = np.zeros(folds)
        for s in rng.permutation(sizes):
            total[total.argmin()] += s
        best = min(best, np.abs(total - total.mean()).mean())
    return best


def test_dealt_sizes_are_as_even_as_many_tries():
    rng = np.random.default_rng(17)
    for folds in (2, 3, 5):
        for _ in range(12):
            groups = rng.integers(1, rng.choice([4, 50, 900]), rng.integers(folds, 60))
            sizes, counts = np.unique(groups, return_counts=True)
            dealt = FO.deal_sizes(sizes.astype(float), counts, folds)
            assert (dealt >= 0).all() and (dealt.sum(1) == counts).all()
            total = sizes @ dealt
            assert np.abs(total - total.mean()).mean() <= best_of_tries(groups, folds) + 0.002 * total.mean()
    many = FO.deal_sizes(np.array([1.0, 2.0, 1e6]), np.array([3_000_000, 7_000_001, 4]), 3)
    assert many.sum(1).tolist() == [3_000_000, 7_000_001, 4] and np.ptp(np.array([1, 2, 1e6]) @ many) <= 2


def test_balanced_folds_of_many_groups(spark):
    rows = [(f"n{i}", f"g{i % 300}" if i % 7 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "name string, g string")
    out = FO.group_balanced_folds(df, "g", 4).join(df, "name")
    assert out.count() == 4000 and out.groupBy("g").agg({"fold": "min"}).count() == out.select("g", "fold").distinct().count()
    sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 20
    assert FO.group_balanced_folds(df.limit(0), "g", 4).count() == 0


def test_subclusters_by_effect(spark):
    rng = np.random.default_rng(23)
    x = rng.normal(size=(16, 5)) + np.repeat(rng.normal(size=(4, 5)) * 3, 4, axis=0)
    x[rng.random(x.shape) < 0.1] = 0.0  # conditions without a row
    where = [i % 2 for i in range(16)]
    effects = spark.createDataFrame([(f"p{i:03d}", f"t{j}", float(x[i, j])) for i in range(16) for j in range(5) if x[i, j]], "name string, condition string, effect double")
    clusters = spark.createDataFrame([(f"p{i:03d}", f"c{where[i]}") for i in range(16)], "name string, cluster string")
    labels, means = K.subcluster_by_effect(effects, clusters, 0.5)
    got = {}
    for r in labels.collect():
        got.setdefault((r["cluster"], r["subcluster"]), set()).add(int(r["name"][1:]))
    want = set()
    for c in (0, 1):
        ids = np.array([i for i in range(16) if where[i] == c])
        want |= {frozenset(int(i) for i in ids[list(g)]) for g in naive_labels(K.distances(x[ids], x[ids], "correlation"), "complete", 0.5)}
    assert {frozenset(v) for v in got.values()} == want and all(k[1] == f"p{min(v):03d}" for k, v in got.items())
    table = {(r["cluster"], r["subcluster"], r["condition"]): r["effect"] for r in means.collect()}
    for (c, s), members in got.items():
        for j in range(5):
            value = x[sorted(members), j].sum() / len(members)
            assert table.get((c, s, f"t{j}"), 0.0) == pytest.approx(value)


def test_points_are_sent_to_few_blocks(spark):
    from strandframe.operators.distance import block_count

    sizes = [0, 1, 3_000, 100_000, 600_000]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert [r[0] for r in df.select(block_count(F.col("n"), 2_000)).collect()] == [0, 1, 2, 8, 10]


def test_blocks_of_both_sides_are_compared_in_batches(spark):
    import pandas as pd

    left, right = spark.range(40).select(F.col("id").alias("l")), spark.range(30).select(F.col("id").alias("r"))
    seen = lambda a, b: pd.DataFrame({"l": a["l"], "rows": len(a), "refs": len(b)})
    got = against_reference(left, right, seen, "l long, rows long, refs long", "l", "r", bound=10, batch=4).collect()
    assert max(r["rows"] for r in got) <= 4
    refs = {}
    for r in got:
        refs[r["l"]] = refs.get(r["l"], 0) + r["refs"]
    assert refs == {i: 30 for i in range(40)}


def test_linkage_keeps_no_table_of_pairs(spark, monkeypatch):
    """Complete and average linkage over tables never write a row per pair of points."""
    written, sizes = L.written, []

    def counted(df):
        out = written(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(L, "written", counted)
    x = np.random.default_rng(21).normal(size=(60, 3))
    p = points(spark, x).select(F.lit("g").alias("grp"), "id", "vec")
    rows = L.merge_table(p, "euclidean", "complete", None, 8, 16).collect()
    assert len(rows) == 59 and max(sizes) <= 120
