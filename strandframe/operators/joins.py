"""Joins by name, matching and string similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.operators.select import top_per_key
from strandframe.session import cut_lineage, written


def align_by_name(tables: dict[str, DataFrame], key: str = "name") -> DataFrame:
    """Inner equi-join of N tables; other columns get the table's name as prefix."""
    out = None
    for prefix, df in tables.items():
        named = df.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != key])
        out = named if out is None else out.join(named, key)
    return out


def align_matrices(parts: dict[str, DataFrame], axis: int = 1, align_columns: bool = False) -> DataFrame:
    """N long matrices on one axis.

    Axis 1 keeps the rows that occur in every matrix and puts the modality before
    the column; axis 0 stacks and keeps the first of duplicate rows.
    """
    tagged = None
    for i, (m, df) in enumerate(parts.items()):
        d = df.select(F.lit(m).alias("modality"), F.lit(i).alias("__i"), "row", "col", "value")
        tagged = d if tagged is None else tagged.unionByName(d)
    n = len(parts)
    if align_columns:
        common = tagged.groupBy("col").agg(F.count_distinct("__i").alias("k")).filter(F.col("k") == n).select("col")
        tagged = tagged.join(common, "col", "left_semi")
    if axis == 1:
        rows = tagged.groupBy("row").agg(F.count_distinct("__i").alias("k")).filter(F.col("k") == n).select("row")
        return tagged.join(rows, "row", "left_semi").drop("__i")
    first = tagged.groupBy("row").agg(F.min("__i").alias("__i"))
    return tagged.join(first, ["row", "__i"]).drop("__i")


def xy_dataset(inputs: list[DataFrame], outputs: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Features of one or many inputs and targets of one or many matrices, on common names.

    Each input is tagged with a channel ``F0..Fn``; rows whose features are all 0 are dropped.
    """
    x = None
    for i, df in enumerate(inputs):
        d = df.select("name", F.lit(f"F{i}").alias("channel"), "feature", "value")
        x = d if x is None else x.unionByName(d)
    live = x.groupBy("name").agg(
        F.sum(F.col("value") * F.col("value")).alias("s"), F.count_distinct("channel").alias("k")
    )
    live = live.filter((F.col("s") > 0) & (F.col("k") == len(inputs))).select("name")
    y = align_matrices({k: v.select(F.col("name").alias("row"), "col", "value") for k, v in outputs.items()})
    y = y.withColumnRenamed("row", "name")
    names = live.join(y.select("name").distinct(), "name")
    return x.join(names, "name", "left_semi"), y.join(names, "name", "left_semi")


def lookup_classes(df: DataFrame, classes: DataFrame, key: str = "col") -> DataFrame:
    """Left join of class labels; Spark broadcasts the class table when it is small."""
    return df.join(classes, key, "left")


def match_unique_greedy(pairs: DataFrame, a: str = "a", b: str = "b", score: str = "score") -> DataFrame:
    """One-to-one assignment by best remaining pair, as rounds of mutual best pairs.

    Ties are ordered by ``(a, b)``, which makes the rounds equal to the one-by-one
    greedy result.  Each round is a pair of aggregations and anti joins on a
    checkpointed table.
    """
    rest = cut_lineage(pairs.select(a, b, score))
    chosen = None
    order = F.struct(F.col(score), F.struct(F.col(a), F.col(b)))
    while not rest.isEmpty():
        # largest score; for equal scores the smallest (a, b)
        best_a = rest.groupBy(a).agg(F.max(score).alias("__s")).join(rest, a).filter(F.col(score) == F.col("__s"))
        best_a = best_a.groupBy(a).agg(F.min(b).alias(b))
        best_b = rest.groupBy(b).agg(F.max(score).alias("__s")).join(rest, b).filter(F.col(score) == F.col("__s"))
        best_b = best_b.groupBy(b).agg(F.min(a).alias(a))
        mutual = cut_lineage(best_a.join(best_b, [a, b]).join(rest, [a, b]).select(a, b, score))
        if mutual.isEmpty():
            raise RuntimeError("no mutual best pair; scores must not be NaN")
        chosen = mutual if chosen is None else chosen.unionByName(mutual)
        rest = cut_lineage(rest.join(mutual.select(a), a, "left_anti").join(mutual.select(b), b, "left_anti"))
    return chosen if chosen is not None else pairs.select(a, b, score).limit(0)


def _grams(names: DataFrame, mink: int, k: int, emphasize_first: int, emphasize_last: int) -> DataFrame:
    """Substring counts of name parts; the first and last parts count twice."""
    clean = F.regexp_replace(F.upper(F.substring_index("name", "/", -1)), "[_\\-]", ".")
    parts = names.select("name", F.split(clean, r"\.").alias("p"))
    weighted = parts.select("name", F.size("p").alias("n"), F.posexplode("p").alias("i", "part")).withColumn(
        "w", F.when((F.col("i") < emphasize_first) | (F.col("n") - F.col("i") <= emphasize_last), 2).otherwise(1)
    )
    from strandframe.functions.sequence import windows

    words = F.concat(*[windows(F.col("part"), size) for size in range(mink, k + 1)])
    return (
        weighted.select("name", "w", F.explode(words).alias("gram"))
        .groupBy("name", "gram")
        .agg(F.sum("w").cast("bigint").alias("cnt"))
    )


def string_similarity_join(
    left: DataFrame, right: DataFrame, mink: int = 2, k: int = 4, emphasize_first: int = 2, emphasize_last: int = 2,
    min_similarity: float = 0.0,
) -> DataFrame:
    """Weighted Jaccard of substring counts for name pairs that share a gram.

    The weighted sum of maxima is total_a + total_b - shared, so only shared grams
    are joined.  With a minimum similarity t, two names can only pass when they share one of
    their rare grams (grams in global order of frequency whose remaining weight is at least
    t times the name's total), so frequent grams never make candidate pairs.
    """
    a = _grams(left.select(F.col(left.columns[0]).alias("name")).distinct(), mink, k, emphasize_first, emphasize_last)
    b = _grams(right.select(F.col(right.columns[0]).alias("name")).distinct(), mink, k, emphasize_first, emphasize_last)
    ta = a.groupBy(F.col("name").alias("a")).agg(F.sum("cnt").alias("ta"))
    tb = b.groupBy(F.col("name").alias("b")).agg(F.sum("cnt").alias("tb"))
    ga = a.select(F.col("name").alias("a"), "gram", F.col("cnt").alias("ca"))
    gb = b.select(F.col("name").alias("b"), "gram", F.col("cnt").alias("cb"))
    if min_similarity > 0:
        freq = a.select("gram").unionByName(b.select("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("f"))
        pairs = _rare_part(ga, "a", "ca", ta, "ta", freq, min_similarity).join(
            _rare_part(gb, "b", "cb", tb, "tb", freq, min_similarity), "gram"
        )
        both = pairs.select("a", "b").distinct().join(ga, "a").join(gb, ["b", "gram"])
    else:
        both = ga.join(gb, "gram")
    shared = both.groupBy("a", "b").agg(F.sum(F.least("ca", "cb")).alias("shared"))
    sim = F.col("shared") / (F.col("ta") + F.col("tb") - F.col("shared"))
    return shared.join(ta, "a").join(tb, "b").select("a", "b", sim.alias("similarity")).filter(F.col("similarity") >= min_similarity)


def match_names(left: DataFrame, right: DataFrame, bounds: tuple[float, ...] = (0.8, 0.6, 0.45, 0.3, 0.2, 0.1, 0.0)) -> DataFrame:
    """One-to-one matches ``(a, b, similarity)`` of two name columns, best pair first, without a table of all pairs.

    The bounds fall: at each only names that are still free are joined, and only pairs
    of at least that similarity are made, from their rare grams.  All better pairs were
    decided before, so the result is that of ``match_unique_greedy`` on all pairs that
    share a gram.
    """
    if list(bounds) != sorted(bounds, reverse=True) or bounds[-1] != 0.0:
        raise ValueError("bounds fall to 0")
    a = written(left.select(F.col(left.columns[0]).alias("name")).where("name IS NOT NULL").distinct())
    b = written(right.select(F.col(right.columns[0]).alias("name")).where("name IS NOT NULL").distinct())
    out = left.sparkSession.createDataFrame([], "a string, b string, similarity double")
    for bound in bounds:
        if a.isEmpty() or b.isEmpty():
            break
        got = written(match_unique_greedy(string_similarity_join(a, b, min_similarity=bound), score="similarity"))
        out = out.unionByName(got)
        a = written(a.join(got.select(F.col("a").alias("name")), "name", "left_anti"))
        b = written(b.join(got.select(F.col("b").alias("name")), "name", "left_anti"))
    return out


def _rare_part(
    grams: DataFrame, name: str, cnt: str, totals: DataFrame, total: str, freq: DataFrame, t: float
) -> DataFrame:
    rest = W.partitionBy(name).orderBy("f", "gram").rowsBetween(0, W.unboundedFollowing)
    g = grams.join(freq, "gram").join(totals, name).withColumn("__rest", F.sum(cnt).over(rest))
    return g.filter(F.col("__rest") >= t * F.col(total) - 1e-9).select(name, "gram")


def most_unique_substring(names: DataFrame, mink: int = 2, k: int = 4) -> DataFrame:
    """Gram with the largest summed count surplus against all other names; the longest wins a tie.

    The sum over others is ``N * own - total``, so no name is compared with another.
    """
    g = _grams(names.select(F.col(names.columns[0]).alias("name")).distinct(), mink, k, 2, 2)
    n = names.select(F.col(names.columns[0])).distinct().agg(F.count(F.lit(1)).alias("n"))
    totals = g.groupBy("gram").agg(F.sum("cnt").alias("total"))
    scored = g.join(totals, "gram").join(F.broadcast(n)).withColumn("weight", F.col("n") * F.col("cnt") - F.col("total"))
    best = F.min_by("gram", F.struct(-F.col("weight"), -F.length("gram"), F.col("gram")))
    return scored.groupBy("name").agg(best.alias("gram"))


def _contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """``(s, l)``: strings of ``short`` (s) inside strings of ``long`` (l).

    A short string is looked up by the rarest of its three-letter pieces (itself, if it
    is shorter), so a common piece never brings all strings together.
    """
    from strandframe.functions.sequence import windows

    pieces = F.array_distinct(F.concat(*[windows(F.col("l"), k) for k in (1, 2, 3)]))
    held = long.select("l", F.explode(pieces).alias("g"))
    own = F.when(F.length("s") <= 3, F.array("s")).otherwise(windows(F.col("s"), 3))
    wanted = short.filter(F.length("s") > 0).select("s", F.explode(F.array_distinct(own)).alias("g"))
    counts = held.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(counts, "g", "left").groupBy("s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("k"))
    return rarest.filter("k.n > 0").select("s", F.col("k.g").alias("g")).join(held, "g").filter(F.contains("l", F.col("s"))).select("s", "l")


def substring_membership(left: DataFrame, words: DataFrame, soft: bool = False) -> DataFrame:
    """Names that contain, or are contained in, one of the words (case-insensitive).

    Found through an index of three-letter pieces, for any number of words.  An empty
    word is in every name, an empty name in every word.  ``soft`` marks instead of dropping.
    """
    w = words.select(F.upper(words.columns[0]).alias("w")).filter(F.col("w").isNotNull()).distinct()
    n = left.select(F.upper("name").alias("n")).filter(F.col("n").isNotNull()).distinct()
    in_name = _contained(w.select(F.col("w").alias("s")), n.select(F.col("n").alias("l"))).select(F.col("l").alias("__n"))
    in_word = _contained(n.select(F.col("n").alias("s")), w.select(F.col("w").alias("l"))).select(F.col("s").alias("__n"))
    found = in_name.unionByName(in_word).distinct().withColumn("__hit", F.lit(True))
    ends = w.agg(F.coalesce(F.max(F.col("w") == ""), F.lit(False)).alias("__any"), (F.count(F.lit(1)) > 0).alias("__some"))
    marked = left.join(found, F.upper("name") == F.col("__n"), "left").join(F.broadcast(ends))  # one row
    hit = F.coalesce("__hit", F.lit(False)) | F.col("__any") | ((F.col("name") == "") & F.col("__some"))
    marked = marked.withColumn("member", F.when(F.col("name").isNotNull(), hit)).drop("__n", "__hit", "__any", "__some")
    return marked if soft else marked.filter("member").drop("member")


def join_metric_to_matches(matches: DataFrame, metric: DataFrame, soft: bool = False) -> DataFrame:
    """Attach a metric per (query, factor) and re-rank matches by it.

    ``matches`` is ``(query, target, q)``, ``metric`` is ``(query, factor, metric)``; a
    factor belongs to a target whose name contains it.  Without ``soft`` matches
    that have no metric are removed.
    """
    from strandframe.functions.sequence import windows

    # a factor of length n is looked up among the target's substrings of length n: an equi-join
    lengths = sorted(r[0] for r in metric.select(F.length("factor")).distinct().collect())
    parts = F.concat(*[windows(F.upper("target"), n) for n in lengths])
    names = matches.select("query", "target").distinct()
    parts = names.select("query", "target", F.explode(F.array_distinct(parts)).alias("part"))
    factors = metric.select("query", F.upper("factor").alias("part"), "metric")
    pair = parts.join(factors, ["query", "part"]).groupBy("query", "target").agg(F.max("metric").alias("metric"))
    j = matches.join(pair, ["query", "target"], "left" if soft else "inner")
    w = W.partitionBy("query").orderBy(F.col("metric").desc_nulls_last(), F.col("q").asc(), F.col("target").asc())
    return j.withColumn("rank", F.row_number().over(w))


def annotate_motif_matches(
    matches: DataFrame, cutoff: float, n: int, filter_word: str | None = None, stat: str = "q"
) -> DataFrame:
    """Label ``query(a,b,c)`` from the best ``n`` targets under the cut-off, ``query(*)`` when none passes."""
    ok = matches.filter(F.col(stat) <= cutoff)
    if filter_word:
        ok = ok.filter(F.contains(F.upper("target"), F.lit(filter_word.upper())))
    best = top_per_key(ok.select("query", "target", stat), ["query"], [F.col(stat).asc(), F.col("target").asc()], n)
    names = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "target"))).alias("t"))
    allq = matches.select("query").distinct()
    label = F.coalesce(F.array_join(F.transform("t", lambda x: x["target"]), ","), F.lit("*"))
    return allq.join(names, "query", "left").select("query", F.concat(F.col("query"), F.lit("("), label, F.lit(")")).alias("label"))


def match_summary(matches: DataFrame, cutoff: float) -> DataFrame:
    """Unique queries, queries under the cut-off, unique best targets and median best q."""
    from strandframe.functions.ranking import exact_percentiles

    best = matches.groupBy("query").agg(F.min_by("target", F.struct("q", "target")).alias("target"), F.min("q").alias("q"))
    s = best.agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(F.col("q") <= cutoff).alias("assigned"),
        F.count_distinct("target").alias("targets"),
    )
    return s.join(F.broadcast(exact_percentiles(best, [], "q", [0.25, 0.5, 0.75], ["q25", "q50", "q75"])))


def match_assignment(matches: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """Every name with 1 when it has a match under the cut-off, else 0."""
    hit = matches.filter(F.col("q") <= cutoff).select(F.col("query").alias("name")).distinct().withColumn("hit", F.lit(1))
    return names.select("name").distinct().join(hit, "name", "left").select("name", F.coalesce("hit", F.lit(0)).alias("assigned"))


def match_seqlets_across_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """Effects of two models' seqlets per (cluster, seq); partners share a position.

    Input ``(cluster, seq, seqlet, effect, positions)``.  A seqlet takes its first partner
    by name; seqlets without a partner get 0 on the other side.
    """
    def flat(df: DataFrame, side: str) -> DataFrame:
        return df.select(
            "cluster", "seq", F.col("seqlet").alias(f"seqlet_{side}"), F.col("effect").alias(f"effect_{side}"),
            F.explode("positions").alias("pos"),
        )

    ea, eb = flat(a, "a"), flat(b, "b")
    pair = ea.join(eb, ["cluster", "seq", "pos"]).groupBy("cluster", "seq", "seqlet_a", "effect_a").agg(
        F.min(F.struct("seqlet_b", "effect_b")).alias("p")
    )
    pair = pair.select("cluster", "seq", "seqlet_a", "effect_a", F.col("p.seqlet_b"), F.col("p.effect_b"))
    left = a.select("cluster", "seq", F.col("seqlet").alias("seqlet_a"), F.col("effect").alias("effect_a"))
    only_a = left.join(pair.select("cluster", "seq", "seqlet_a"), ["cluster", "seq", "seqlet_a"], "left_anti")
    right = b.select("cluster", "seq", F.col("seqlet").alias("seqlet_b"), F.col("effect").alias("effect_b"))
    only_b = right.join(pair.select("cluster", "seq", "seqlet_b").distinct(), ["cluster", "seq", "seqlet_b"], "left_anti")
    zero = F.lit(0.0)
    return (
        pair.select("cluster", "seq", "seqlet_a", "seqlet_b", "effect_a", "effect_b")
        .unionByName(only_a.withColumn("seqlet_b", F.lit(None).cast("string")).withColumn("effect_b", zero))
        .unionByName(only_b.withColumn("seqlet_a", F.lit(None).cast("string")).withColumn("effect_a", zero))
    )


