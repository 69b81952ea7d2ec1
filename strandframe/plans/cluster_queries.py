"""Clustering, folds, sequence distance and model queries."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from strandframe.operators import cluster as K
from strandframe.operators import folds as FO
from strandframe.operators import kmers
from strandframe.operators import models as MD
from strandframe.operators import motifs as M
from strandframe.operators import seqdist as D
from strandframe.operators import similarity as SIM
from strandframe.plans import views as V
from strandframe.plans.catalog import query
from strandframe.session import cut_lineage, written

C = V.ctes
KMERS3 = ["".join(p) for p in product("ACGT", repeat=3)]


def points(spark, sf):
    """Embeddings as points ``(id, vec, label)``."""
    e = V.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.col("label"))


PTS = """pt AS (SELECT CAST(vec_id AS VARCHAR) AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, label FROM embeddings)"""
CENT = """ce AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, range(1, 65) t(i) GROUP BY ALL)"""


def centroids(spark, sf):
    p = points(spark, sf).select("label", F.posexplode("vec").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"])
    return p.groupBy("label").agg(ordered.alias("vec"))


@query(
    "assign_to_centroid",
    C(PTS, CENT, "c2 AS (SELECT label, list(v ORDER BY i) AS cv FROM ce GROUP BY label)",
      "d AS (SELECT id, c2.label, list_distance(vec, cv) AS d FROM pt, c2)", "b AS (SELECT id, arg_min(label, d) AS l, min(d) AS d FROM d GROUP BY id)")
    + "SELECT 'all' AS grp, id, CASE WHEN d > 0.95 THEN '-1' ELSE CAST(l AS VARCHAR) END AS cluster FROM b",
)
def _(spark, sf):
    c = centroids(spark, sf).select(F.lit("all").alias("grp"), F.col("label").alias("cluster"), F.lit(0.95).alias("radius"), "vec")
    return K.assign_to_centroid(points(spark, sf).select(F.lit("all").alias("grp"), "id", "vec"), c)


_NEAR = """e2 AS (SELECT a.id AS a, b.id AS b FROM pt a JOIN pt b ON a.id < b.id AND list_distance(a.vec, b.vec) < 1.08)"""


@query(
    "near_pairs",
    C(PTS) + "SELECT a.id AS a, b.id AS b, list_distance(a.vec, b.vec) AS dist FROM pt a JOIN pt b ON a.id < b.id AND list_distance(a.vec, b.vec) < 1.15",
    floats="dist",
)
def _(spark, sf):
    p = points(spark, sf).select(F.lit("all").alias("grp"), "id", "vec")
    return K.near_pairs(p, "euclidean", 1.15).drop("grp")


@query(
    "agglomerative_cluster_single",
    "WITH RECURSIVE " + PTS + ", " + _NEAR + """, ed AS (SELECT a, b FROM e2 UNION ALL SELECT b, a FROM e2),
  reach AS (SELECT id, id AS r FROM pt UNION SELECT reach.id, ed.b FROM reach JOIN ed ON reach.r = ed.a)
  SELECT id, min(r) AS cluster FROM reach GROUP BY id""",
)
def _(spark, sf):
    return K.agglomerative_cluster(points(spark, sf), "euclidean", "single", 1.08)


@query("agglomerative_cluster")
def _(spark, sf):
    return K.agglomerative_cluster(points(spark, sf), "correlation", "complete", 0.9)


@query("agglomerative_cluster_k")
def _(spark, sf):
    return K.number_clusters(K.agglomerative_cluster(points(spark, sf), "euclidean", "average", n_clusters=10))


@query("order_by_hierarchy")
def _(spark, sf):
    return K.order_by_hierarchy(points(spark, sf), "correlation")


_PAIRS = """pr AS (SELECT a.id AS a, b.id AS b, a.label AS cluster, list_distance(a.vec, b.vec) AS dist FROM pt a JOIN pt b ON a.label = b.label AND a.id <> b.id)"""


@query(
    "cluster_medoid",
    C(PTS, _PAIRS, "s AS (SELECT cluster, a, sum(dist) AS s, max(dist) AS r FROM pr GROUP BY ALL)")
    + "SELECT CAST(cluster AS VARCHAR) AS cluster, arg_min(a, s) AS medoid, arg_min(r, s) AS radius FROM s GROUP BY cluster",
    floats="radius",
)
def _(spark, sf):
    return K.medoids(points(spark, sf).select(F.col("label").alias("grp"), "id", "vec"))


@query(
    "cluster_medoid_pairs",
    C(PTS, _PAIRS, "s AS (SELECT cluster, a, sum(dist) AS s, max(dist) AS r FROM pr WHERE dist < 1.3 GROUP BY ALL)")
    + "SELECT cluster, arg_min(a, s) AS medoid, arg_min(r, s) AS radius FROM s GROUP BY cluster",
    floats="radius",
)
def _(spark, sf):
    """Medoid on a given pair table, here the pairs under a distance."""
    p = points(spark, sf)
    near = K.near_pairs(p.select(F.col("label").cast("string").alias("grp"), "id", "vec"), "euclidean", 1.3).select("a", "b", "dist")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist"))
    return K.cluster_medoid(both, p.select(F.col("id").alias("name"), F.col("label").alias("cluster")))


@query(
    "cluster_representatives",
    C(PTS, _PAIRS, "tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY dist DESC, a, b) AS rn FROM pr WHERE a < b) WHERE rn <= 60)",
      "x AS (SELECT tp.cluster, tp.a, tp.b, p.b AS c, tp.dist + p.dist + q.dist AS t FROM tp JOIN pr p ON tp.a = p.a JOIN pr q ON tp.b = q.a AND q.b = p.b WHERE p.b <> tp.a AND p.b <> tp.b)")
    + "SELECT CAST(cluster AS VARCHAR) AS cluster, tr[1] AS rep1, tr[2] AS rep2, tr[3] AS rep3 FROM (SELECT cluster, list_sort([a, b, c]) AS tr, row_number() OVER (PARTITION BY cluster ORDER BY round(t, 9) DESC, a DESC, b DESC, c DESC) AS rn FROM x) WHERE rn = 1",
)
def _(spark, sf):
    return K.representatives(points(spark, sf).select(F.col("label").alias("grp"), "id", "vec"))


@query(
    "assign_leftout_to_cluster",
    C(PTS, CENT, "c2 AS (SELECT label, list(v ORDER BY i) AS cv FROM ce GROUP BY label)",
      "d AS (SELECT id AS a, CAST(label AS VARCHAR) AS b, CAST(label // 3 AS VARCHAR) AS cluster, list_distance(vec, cv) AS dist FROM (SELECT id, vec FROM pt), c2)",
      "g AS (SELECT a, cluster, avg(dist) AS m FROM d GROUP BY ALL HAVING avg(dist) <= 1.05)", "b AS (SELECT a, arg_min(cluster, m) AS cluster FROM g GROUP BY a)")
    + "SELECT id AS a, coalesce(cluster, '-1') AS cluster FROM pt LEFT JOIN b ON id = a",
)
def _(spark, sf):
    from strandframe.operators.blocks import against_reference

    reps = centroids(spark, sf).select(F.col("label").cast("string").alias("b"), F.floor(F.col("label") / 3).cast("string").alias("cluster"), "vec")

    def compare(left, right):
        import numpy as np
        import pandas as pd

        d = K.distances(K.stack(left["vec"]), K.stack(right["vec"]), "euclidean")
        return pd.DataFrame({"a": np.repeat(left["id"].to_numpy(), len(right)), "b": np.tile(right["b"].to_numpy(), len(left)), "dist": d.ravel()})

    pairs = against_reference(points(spark, sf).select("id", "vec"), reps.select("b", "vec"), compare, "a string, b string, dist double", "id", "b")
    return K.assign_leftout_to_cluster(pairs, reps.select("b", "cluster"), "average", 1.05)


_CL = """cl AS (SELECT 's' || CAST(vec_id AS VARCHAR) || '_' || CAST(vec_id % 4 AS VARCHAR) AS name, label AS cluster FROM embeddings)"""


def _named_clusters(spark, sf):
    e = V.table(spark, sf, "embeddings")
    name = F.concat(F.lit("s"), F.col("vec_id").cast("string"), F.lit("_"), (F.col("vec_id") % 4).cast("string"))
    return e.select(name.alias("name"), F.col("label").alias("cluster"))


@query("cluster_size_histogram", C(_CL, "s AS (SELECT count(*) AS size FROM cl GROUP BY cluster)") + "SELECT size, count(*) AS clusters FROM s GROUP BY size")
def _(spark, sf):
    return K.cluster_size_histogram(_named_clusters(spark, sf))


@query(
    "cluster_reproducibility",
    C(_CL, "g AS (SELECT cluster, split_part(name, '_', 2) AS model, count(*) AS n FROM cl GROUP BY ALL)",
      "m AS (SELECT CAST(p_size % 12 AS INTEGER) AS cluster, arg_min(p_name, {'q': p_retailprice, 't': p_name}) AS best_match, min(p_retailprice) AS best_q FROM part GROUP BY ALL)")
    + """SELECT cluster, count(*) AS models, count(*) FILTER (WHERE n > 1) AS duplicated_models, CAST(sum(n) AS BIGINT) AS members, any_value(best_match) AS best_match, any_value(best_q) AS best_q
  FROM g LEFT JOIN m USING (cluster) GROUP BY cluster""",
)
def _(spark, sf):
    p = V.table(spark, sf, "part").select((F.col("p_size") % 12).alias("query"), F.col("p_name").alias("target"), F.col("p_retailprice").alias("q"))
    return K.cluster_reproducibility(_named_clusters(spark, sf), p)


@query("cluster_members", C(_CL) + "SELECT cluster, string_agg(name, ',' ORDER BY name) AS names FROM cl GROUP BY cluster")
def _(spark, sf):
    return K.cluster_members(_named_clusters(spark, sf))


_UEFF = """ue AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS name, event_type AS condition, avg(round(value * 100) - 4000) AS effect FROM events GROUP BY ALL),
uc AS (SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS name, CAST(user_id % 7 AS VARCHAR) AS cluster FROM events)"""


def _user_effects(spark, sf):
    e = V.table(spark, sf, "events")
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    eff = e.groupBy(name.alias("name"), F.col("event_type").alias("condition")).agg(F.avg(F.round(F.col("value") * 100) - 4000).alias("effect"))
    return eff, e.select(name.alias("name"), (F.col("user_id") % 7).cast("string").alias("cluster")).distinct()


@query("subcluster_by_effect")
def _(spark, sf):
    return K.subcluster_by_effect(*_user_effects(spark, sf), 0.6)[1]


@query(
    "merge_effects",
    C(_UEFF) + "SELECT cluster, condition, CASE WHEN max(effect) >= -min(effect) THEN max(effect) ELSE min(effect) END AS effect FROM ue JOIN uc USING (name) GROUP BY ALL",
    floats="effect", digits=4,
)
def _(spark, sf):
    return K.merge_effects(*_user_effects(spark, sf), "maxabs")


def _label_pairs_of_motifs(spark, sf):
    """Alignment of every motif to its label's mean motif, in the shape of a pair table with the mean as centre."""
    m = V.ppms(spark, sf)
    means = V.label_ppms(spark, sf)
    lab = V.table(spark, sf, "embeddings").select(
        F.concat(F.lit("m_"), F.col("vec_id").cast("string")).alias("a"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("b")
    )
    pairs = cut_lineage(SIM.motif_similarity(m, means).join(lab, ["a", "b"]).drop("logp", "n"))
    clusters = lab.select(F.col("a").alias("motif"), F.col("b").alias("cluster")).unionByName(
        lab.select(F.col("b").alias("motif"), F.col("b").alias("cluster")).distinct()
    )
    # the mean motif is close to all of its members, so it is the centre of the alignment
    back = pairs.select(
        F.col("b").alias("a"), F.col("a").alias("b"), "dist", F.when(F.col("revcomp"), F.col("offset")).otherwise(-F.col("offset")).alias("offset"), "revcomp"
    )
    return m.unionByName(means), clusters, pairs.unionByName(back)


@query("consensus_motif")
def _(spark, sf):
    m, clusters, pairs = _label_pairs_of_motifs(spark, sf)
    return M.consensus_motif(m, clusters.withColumn("cluster", F.expr("substring(cluster, 2)").cast("int")), pairs)


@query("merge_similar_motifs")
def _(spark, sf):
    """Join the motifs of a label: names and mean effect rows."""
    m, clusters, pairs = _label_pairs_of_motifs(spark, sf)
    clusters = clusters.withColumn("cluster", F.expr("substring(cluster, 2)").cast("int")).withColumnRenamed("motif", "name")
    effects = V.attributions(spark, sf).groupBy(F.concat(F.lit("m_"), "seq").alias("name"), F.col("base").alias("condition")).agg(F.sum("value").alias("effect"))
    joined, names, merged = K.merge_similar_motifs(m, clusters, pairs, effects)
    size = joined.groupBy("cluster").agg((F.max("pos") + 1).alias("length"))
    return merged.join(size, "cluster").join(names, "cluster")


@query("connected_components", "WITH RECURSIVE e AS (SELECT DISTINCT 'c' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), ed AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach AS (SELECT a AS id, a AS r FROM ed UNION SELECT reach.id, ed.b FROM reach JOIN ed ON reach.r = ed.a) SELECT id, min(r) AS component FROM reach GROUP BY id")
def _(spark, sf):
    li = V.table(spark, sf, "lineitem")
    pairs = li.select("l_suppkey", "l_partkey").distinct()  # of numbers: shorter than the names, and as many
    edges = written(pairs.select(F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b")))
    nodes = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id")))
    return K.connected_components(nodes, edges)


# ---------------------------------------------------------------------- folds
@query(
    "stratified_folds",
    """SELECT CAST(doc_id AS VARCHAR) AS name, CAST(floor((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) * 5 / count(*) OVER (PARTITION BY quality)) AS INTEGER) AS fold FROM labels""",
)
def _(spark, sf):
    lab = V.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("name"), "quality", "doc_id")
    return FO.stratified_folds(lab, 5, label="quality", order="doc_id")


@query("stratified_folds_hashed")
def _(spark, sf):
    lab = V.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("name"), "quality")
    return FO.stratified_folds(lab, 5, label="quality", seed=3)


@query(
    "split_roles",
    "SELECT CAST(doc_id AS VARCHAR) AS name, CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 4 THEN 'val' ELSE 'train' END AS role FROM documents",
)
def _(spark, sf):
    f = V.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), (F.col("doc_id") % 5).alias("fold"))
    return FO.split_roles(f, 5, 0)


@query("group_balanced_folds")
def _(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), F.concat_ws("|", "source", "lang").alias("grp"))
    return FO.group_balanced_folds(d, "grp", 4)


# --------------------------------------------------------- sequence distances
_UNIQ = "u AS (SELECT seq, min(name) AS name, length(seq) AS n FROM seqs GROUP BY seq)"


@query(
    "pairwise_sequence_distance",
    C(V.SEQ, _UNIQ) + "SELECT a.name AS a, b.name AS b, CAST(levenshtein(a.seq, b.seq) AS INTEGER) AS distance FROM u a JOIN u b ON a.name < b.name AND abs(a.n - b.n) <= 3 AND levenshtein(a.seq, b.seq) <= 3",
)
def _(spark, sf):
    return D.pairwise_sequence_distance(V.sequences(spark, sf), 3)


@query(
    "sequence_identity",
    C(V.SEQ, "u AS (SELECT seq, min(name) AS name FROM seqs GROUP BY seq)")
    + "SELECT a.name AS a, b.name AS b, CAST(hamming(a.seq, b.seq) AS INTEGER) AS distance FROM u a JOIN u b ON a.name < b.name AND length(a.seq) = length(b.seq) AND CASE WHEN length(a.seq) = length(b.seq) THEN hamming(a.seq, b.seq) END <= 2",
)
def _(spark, sf):
    return D.pairwise_sequence_distance(V.sequences(spark, sf), 2, "identity")


@query("sequence_copies", C(V.SEQ) + "SELECT name, min(name) OVER (PARTITION BY seq) AS first, count(*) OVER (PARTITION BY seq) AS n FROM seqs")
def _(spark, sf):
    return D.copies(V.sequences(spark, sf))


_VEC = """kw AS (SELECT {src}.name, substr(seq, i, 3) AS w FROM (SELECT name, seq, unnest(range(1, length(seq) - 1)) AS i FROM {src} WHERE length(seq) >= 3) {src}),
kc AS (SELECT name, w, count(*) AS c FROM kw GROUP BY ALL)"""


def _kmer_points(spark, seqs):
    counts = kmers.kmer_count_regular(seqs, 3)
    return D.kmer_vectors(counts, KMERS3)


@query(
    "nearest_distances",
    C(V.SEQ, V.BENCH, _VEC.format(src="seqs"), _VEC.format(src="bench").replace("kw ", "bw ").replace("FROM kw", "FROM bw").replace("kc AS", "bc AS"),
      "sa AS (SELECT name, sum(c * c) AS s FROM kc GROUP BY name)", "sb AS (SELECT name, sum(c * c) AS s FROM bc GROUP BY name)",
      "dt AS (SELECT kc.name AS a, bc.name AS b, sum(kc.c * bc.c) AS d FROM kc JOIN bc USING (w) GROUP BY ALL)")
    + """SELECT sa.name, min(sqrt(sa.s + sb.s - 2 * coalesce(d, 0))) AS distance FROM sa CROSS JOIN sb LEFT JOIN dt ON dt.a = sa.name AND dt.b = sb.name GROUP BY sa.name""",
    floats="distance",
)
def _(spark, sf):
    return D.nearest_distances(_kmer_points(spark, V.sequences(spark, sf)), _kmer_points(spark, V.benchmark_sequences(spark, sf)))


@query(
    "nearest_distances_own",
    C(V.SEQ, _VEC.format(src="seqs"), "kv AS (SELECT name, list(w || CAST(c AS VARCHAR) ORDER BY w) AS v FROM kc GROUP BY name)",
      "cp AS (SELECT v, min(name) AS name, count(*) AS n FROM kv GROUP BY v)", "u AS (SELECT kc.* FROM kc WHERE name IN (SELECT name FROM cp))",
      "s AS (SELECT name, sum(c * c) AS s FROM u GROUP BY name)", "dt AS (SELECT x.name AS a, y.name AS b, sum(x.c * y.c) AS d FROM u x JOIN u y USING (w) GROUP BY ALL)",
      "nn AS (SELECT p.name, min(sqrt(p.s + q.s - 2 * coalesce(d, 0))) AS d FROM s p JOIN s q ON p.name <> q.name LEFT JOIN dt ON a = p.name AND b = q.name GROUP BY p.name)")
    + "SELECT kv.name, CASE WHEN cp.n > 1 THEN 0 ELSE nn.d END AS distance FROM kv JOIN cp USING (v) JOIN nn ON nn.name = cp.name",
    floats="distance",
)
def _(spark, sf):
    return D.nearest_distances(_kmer_points(spark, V.sequences(spark, sf)))


# --------------------------------------------------------------------- models
def model_data(spark, sf):
    """3-mer counts of the labelled documents with three targets.

    Documents without a label are left out before their 3-mers are counted.
    """
    labelled = V.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("name"))
    x = kmers.kmer_count_regular(V.sequences(spark, sf).join(labelled, "name", "left_semi"), 3).select("name", F.col("kmer").alias("feature"), F.col("cnt").alias("value"))
    d = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id")
    y = d.select(
        F.col("doc_id").cast("string").alias("name"),
        F.array(F.col("n_chars") / 100.0, F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("y"),
    )
    return MD.feature_vectors(x, KMERS3).join(y, "name")


TRACKS = ["chars", "quality", "toxic"]


@query("linear_models")
def _(spark, sf):
    return MD.linear_models(model_data(spark, sf), KMERS3, TRACKS, "l2", 10.0)


@query("linear_models_l1")
def _(spark, sf):
    return MD.linear_models(model_data(spark, sf), KMERS3, TRACKS, "l1", 0.05, refit=True)


@query("linear_predictions")
def _(spark, sf):
    d = written(model_data(spark, sf))  # read by the fit and once per track
    return MD.predict_linear(d, MD.linear_models(d, KMERS3, TRACKS, "l2", 10.0), KMERS3)


@query("multi_task_regression")
def _(spark, sf):
    return MD.multi_task_regression(model_data(spark, sf), KMERS3, TRACKS, 5.0)


@query("alpha_search")
def _(spark, sf):
    d = model_data(spark, sf)
    part = F.pmod(F.xxhash64("name"), F.lit(4))
    return MD.alpha_search(d.filter(part > 0), d.filter(part == 0), KMERS3, TRACKS)


@query("coefficient_statistics")
def _(spark, sf):
    return MD.coefficient_statistics(model_data(spark, sf), KMERS3, TRACKS, 1.0)


@query("feature_ablation")
def _(spark, sf):
    return MD.feature_ablation(model_data(spark, sf), KMERS3, TRACKS, 1.0)


@query("logistic_models")
def _(spark, sf):
    d = model_data(spark, sf).withColumn("y", F.slice("y", 2, 2))
    return MD.logistic_models(d, KMERS3, ["quality", "toxic"], 0.1)


@query("random_forest")
def _(spark, sf):
    return MD.random_forest(model_data(spark, sf), KMERS3)


@query("kmer_hotstart")
def _(spark, sf):
    return MD.kmer_hotstart(model_data(spark, sf), KMERS3, TRACKS, 8, 7)


def _emb_points(spark, sf):
    return points(spark, sf).select(F.col("id").alias("name"), "vec")


@query("svd_reduce")
def _(spark, sf):
    return MD.svd_reduce(_emb_points(spark, sf), 0.5).select("name", F.posexplode("dims").alias("k", "d"))


@query("linear_embedding")
def _(spark, sf):
    return MD.linear_embedding(_emb_points(spark, sf), 2)[1].select("name", F.get("dims", F.lit(0)).alias("x"), F.get("dims", F.lit(1)).alias("y"))


@query("nonnegative_factorization")
def _(spark, sf):
    rows, cols = MD.nonnegative_factorization(V.matrix(spark, sf), 3)
    part = lambda df, side: df.select(F.lit(side).alias("side"), F.col(side).alias("name"), F.posexplode("features").alias("k", "w"))
    return part(rows, "row").unionByName(part(cols, "col"))
