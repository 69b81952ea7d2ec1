"""Near-duplicate documents from bottom-k sketches of one hash function.

A document's sketch is the k smallest hashes of its word shingles.  Equal sets are one
class from the start.  Inverted lists of retained values give candidates: two classes at
or over the threshold share so many retained values that they must meet among the rarest
few of each, so common passages are never looked up.  Inside a list, classes are first
compared with one typical member, then with eight, and what is connected by then is not
compared again; of the rest, pairs are formed by how they differ from what their group
has in common.  So a large group of copies costs its size and not its square.  The sketch
of the union filters candidates, the full sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import hash_words, key_filter, may_hold, settled, stored, text_of, window_hashes
from strandframe.llm.components import components

_words: dict[bytes, int] = {}


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, one without words has none."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.int64)
    if len(tokens) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), seed=size) >> 1], np.int64)
    return np.unique((window_hashes(hash_words(tokens, _words), size) >> np.uint64(1)).astype(np.int64))


def signature(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


@lru_cache
def least_shared(k: int, percent: int, miss: float = 1e-7) -> int:
    """Retained values of the union's sketch that both share but for probability ``miss``, at the threshold itself."""
    p, below = percent / 100, 0.0
    for t in range(k + 1):
        below += comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > miss:
            return t
    return k


def sketches(docs: DataFrame, k: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n, sig, sketch`` per row."""
    picked = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sig, sketch = [], [], []
            for text in batch.column("t").to_pylist():
                values = shingle_set(text, size)
                n.append(len(values))
                sig.append(signature(values))
                sketch.append(values[:k])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))],
                names=["id", "n", "sig", "sketch"],
            )

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, n long, sig binary, sketch array<long>")


def rare_lists(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """``v, p, n, own, prefix``: inverted lists of the rarest retained values of each class that another class has too.

    ``own`` counts the retained values that no other class has, ``prefix`` are all values the class is listed under.
    """
    entries = classes.select("p", "n", F.explode("sketch").alias("v"))
    shared = entries.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    hits = entries.join(shared, "v").groupBy("p", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("hits"))
    n = F.col("n")
    own = F.least(n, F.lit(k)) - F.size("hits")
    # Small sets are kept whole, and so are all their partners: the exact bound holds.
    need = F.when(100 * n <= percent * k, F.ceil(n * percent / 100)).otherwise(F.lit(least_shared(k, percent)))
    take = F.least(n, F.lit(k)) - need + 1 - own
    rare = F.transform(F.slice("hits", F.lit(1), take.cast("int")), lambda x: x["v"])
    listed = settled(hits.where(take > 0).select("p", "n", own.alias("own"), rare.alias("prefix")))
    return listed.select("p", "n", "own", "prefix", F.explode("prefix").alias("v"))


def size_fits(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def estimated(pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose union sketch does not rule them out."""
    side = lambda x: classes.select(F.col("p").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(F.col("u"), F.col("s_a")), F.col("s_b")))
    whole = F.greatest("n_a", "n_b") <= k
    enough = F.when(whole, 100 * both >= percent * F.size(F.array_union("s_a", "s_b"))).otherwise(both >= least_shared(k, percent))
    return met.withColumn("u", union).where(enough).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``a, b`` as signatures of the pairs whose full sets reach the threshold."""
    side = lambda x: texts.select(F.col("p").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("t").alias(f"t_{x}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple[bytes | None, np.ndarray]] = {"a": (None, np.empty(0)), "b": (None, np.empty(0))}
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                sets = []
                for x in "ab":
                    sig = batch.column(f"sig_{x}")[i].as_py()
                    if last[x][0] != sig:
                        last[x] = (sig, shingle_set(batch.column(f"t_{x}")[i].as_py(), size))
                    sets.append(last[x][1])
                both = len(np.intersect1d(*sets, assume_unique=True))
                good.append(100 * both >= percent * (len(sets[0]) + len(sets[1]) - both))
            yield pa.RecordBatch.from_arrays([batch.column("sig_a"), batch.column("sig_b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return met.select("sig_a", "t_a", "sig_b", "t_b").mapInArrow(run, "a binary, b binary")


def candidate_texts(docs: DataFrame, classes: DataFrame, lists: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``p, sig, t`` of every class in a list, from the text of its representative."""
    wanted = classes.join(lists.select("p").distinct(), "p", "left_semi").select("p", "sig", F.xxhash64("rep").alias("key"))
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(wanted, "key"))
    picked = docs.select(F.xxhash64(F.col(id_col)).alias("key"), text_of(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            hit = batch.filter(pa.array(may_hold(bitmap, batch.column("key").to_numpy(zero_copy_only=False))))
            text = hit.column("t")
            sig = [signature(shingle_set(t, size)) for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), text], names=["sig", "t"])

    found = picked.mapInArrow(run, "sig binary, t string")
    return found.join(wanted.select("p", "sig"), "sig").groupBy("p", "sig").agg(F.first("t").alias("t"))


def single_shingles(texts: DataFrame, size: int) -> DataFrame:
    """``p, single``: shingles of each class that no other class of ``texts`` has; classes without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, t in zip(batch.column("p").to_pylist(), batch.column("t").to_pylist()):
                values = shingle_set(t, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), p, np.int64)), pa.array(values)], names=["p", "v"])

    flat = texts.select("p", "t").mapInArrow(run, "p long, v long")
    once = flat.groupBy("v").agg(F.count(F.lit(1)).alias("df"), F.min("p").alias("p")).where(F.col("df") == 1)
    return once.groupBy("p").agg(F.count(F.lit(1)).alias("single"))


def mixed_lists(state: DataFrame) -> DataFrame:
    """``v`` of the lists whose classes are not all in one component."""
    return state.groupBy("v").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where(F.col("c0") != F.col("c1")).select("v")


def star_pairs(state: DataFrame, hubs: int, percent: int) -> DataFrame:
    """Each class of a mixed list with the list's most typical classes: those with the fewest values of their own."""
    rest = state.join(mixed_lists(state), "v", "left_semi")
    part = F.pmod(F.xxhash64("p"), F.lit(hubs))
    hub = rest.groupBy("v", part.alias("part")).agg(F.min(F.struct("own", "p", "n", "c")).alias("hub"))
    return (
        rest.join(hub.select("v", F.col("hub.p").alias("hp"), F.col("hub.n").alias("hn"), F.col("hub.c").alias("hc")), "v")
        .where((F.col("c") != F.col("hc")) & size_fits(F.col("n"), F.col("hn"), percent))
        .select(F.least("p", "hp").alias("a"), F.greatest("p", "hp").alias("b"))
    )


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """``p, values``: all shingles of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shingle_set(t, size) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array(values, pa.list_(pa.int64()))], names=["p", "values"])

    return texts.select("p", "t").mapInArrow(run, "p long, values array<long>")


SALTS = 16  # copies of a group's row, so that a large group is joined by as many keys


def per_group(rows: DataFrame, small: DataFrame) -> DataFrame:
    """Join a table of one row per group; ``rows`` has ``g`` and ``salt``."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return rows.join(small.select("*", salts), ["g", "salt"])


def differences(able: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``g, salt, p, n, c, k, diff``: how each class differs from the core of its group.

    A group is what lists connect; its core are the shingles that more than half of its
    classes have, so cores are never larger than the sets they come from.  ``diff`` are the
    core's shingles that the class lacks and the class's that the core lacks.  Two classes
    of one group are linked exactly when 2 * (100 + percent) * (shared differences) >= k + k.
    """
    hub = able.groupBy("v").agg(F.min("p").alias("b"))
    groups = components(able.select("v", F.col("p").alias("a")).join(hub, "v").select("a", "b"))
    one = able.select("p", "n", "c").distinct().join(groups.withColumnsRenamed({"node": "p", "label": "g"}), "p")
    members = one.join(full_sets(texts, size), "p").withColumn("salt", F.pmod(F.xxhash64("p"), F.lit(SALTS)).cast("int"))
    members = stored(members, "open-sets")
    counts = members.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    held = members.select("g", F.explode("values").alias("x")).groupBy("g", "x").agg(F.count(F.lit(1)).alias("df"))
    core = held.join(counts, "g").where(2 * F.col("df") > F.col("m")).groupBy("g").agg(F.collect_list("x").alias("core"))
    core = counts.join(core, "g", "left").select("g", F.coalesce("core", F.array().cast("array<bigint>")).alias("core"))
    met = per_group(members, core).select(
        "g", "salt", "p", "n", "c", F.size("core").alias("h"),
        F.array_except("core", "values").alias("gone"), F.array_except("values", "core").alias("extra"),
    )
    k = 2 * percent * F.col("n") + (100 + percent) * (2 * F.size("gone") - F.col("h"))
    return stored(settled(met).select("g", "salt", "p", "n", "c", k.alias("k"), F.concat("gone", "extra").alias("diff")), "open-differences")


def open_pairs(state: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of mixed lists, not connected yet, that can be links; enough of them to connect all links.

    Shingles that no other class of the mixed lists has cannot be shared, which leaves out
    classes first.  What two of the others share follows from their differences from the
    core of their group: a pair that needs no shared difference is a link, and the class
    with the smallest ``k`` connects all of these; any other pair must share a difference
    so rare that enough of them follow in the order of frequency.
    """
    rest = stored(state.join(mixed_lists(state), "v", "left_semi"), "mixed-lists")
    single = single_shingles(texts.join(rest.select("p").distinct(), "p", "left_semi"), size)
    most = F.col("n") - F.coalesce("single", F.lit(0))
    able = stored(rest.join(single, "p", "left").where(100 * most >= percent * F.col("n")).select("v", "p", "n", "c"), "open-lists")
    apart = differences(able, texts, size, percent)

    hub = apart.groupBy("g").agg(F.min(F.struct("k", "p", "n", "c")).alias("hub"))
    at = per_group(apart, hub).withColumn("sure", F.col("k") + F.col("hub.k") <= 0)
    hp = F.col("hub.p")
    stars = at.where("sure AND c <> hub.c").select(F.least("p", hp).alias("a"), F.greatest("p", hp).alias("b"))

    each = at.select("g", "p", "n", "c", "k", F.col("hub.k").alias("k0"), "sure", F.explode("diff").alias("x"))
    shared = each.groupBy("g", "x").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    of_class = ["g", "p", "n", "c", "k", "k0", "sure"]
    hits = each.join(shared, ["g", "x"]).groupBy(*of_class).agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("hits"))
    ranked = hits.select(*of_class, F.size("hits").alias("all"), F.posexplode("hits").alias("at", "hit"))
    # Differences that can still be shared from this one on.
    ranked = ranked.select(*of_class, F.col("hit.x").alias("x"), (2 * (100 + percent) * (F.col("all") - F.col("at"))).alias("left"))
    ranked = stored(ranked.where(F.col("left") >= F.col("k") + F.col("k0")), "open-ranked")
    side = lambda s: ranked.select("g", "x", *(F.col(c).alias(f"{c}_{s}") for c in ("p", "n", "c", "k", "sure", "left")))
    a, b = side("a").where("left_a >= 2 * k_a"), side("b")
    fits = (F.struct("k_a", "p_a") < F.struct("k_b", "p_b")) & (F.col("c_a") != F.col("c_b")) & size_fits(F.col("n_a"), F.col("n_b"), percent)
    enough = (F.least("left_a", "left_b") >= F.col("k_a") + F.col("k_b")) & ~(F.col("sure_a") & F.col("sure_b"))
    others = a.join(b, ["g", "x"]).where(fits & enough).select(F.least("p_a", "p_b").alias("a"), F.greatest("p_a", "p_b").alias("b"))
    return stars.unionByName(others)


def near_duplicates(
    docs: DataFrame, percent: int = 80, size: int = 5, k: int = 64, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` per row of ``docs``.

    Two rows are linked when 100 * |intersection| >= ``percent`` * |union| of their sets
    of ``size``-word shingles (words in ASCII lower case).  ``component_id`` is the
    smallest id reachable.  A null text and one without words have an empty set and no
    link.  Rows without an id join groups but do not name them: a group of such rows
    alone has a null component and keeps them all.  Repeated rows share a component.
    """
    base = stored(sketches(docs, k, size, id_col, text_col), "sketches")
    p = F.conv(F.substring(F.hex("sig"), 1, 15), 16, 10).cast("long")
    classes = stored(
        base.where(F.col("n") > 0).groupBy("sig").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).withColumn("p", p),
        "classes",
    )
    lists = stored(rare_lists(classes, k, percent), "inverted-lists")
    texts = stored(candidate_texts(docs, classes, lists, size, id_col, text_col), "candidate-texts")
    known = classes.join(lists.select("p").distinct(), "p", "left_semi").select("p", "n", "sig", "sketch")
    known = stored(known, "candidate-sketches")

    def settle(pairs: DataFrame, tested: DataFrame | None, groups: DataFrame | None, label: str):
        new = pairs.distinct() if tested is None else pairs.distinct().join(tested, ["a", "b"], "left_anti")
        new = stored(new, f"{label}-pairs")
        links = stored(verified(estimated(new, known, k, percent), texts, size, percent), f"{label}-links")
        return (new if tested is None else tested.unionByName(new)), components(links, groups)

    def labelled(groups: DataFrame) -> DataFrame:
        """The lists with the component of each class."""
        by_class = known.select("p", "sig").join(groups, known["sig"] == groups["node"]).select("p", F.xxhash64("label").alias("c"))
        own = F.xxhash64(F.lit("alone"), F.col("p"))
        return stored(lists.join(by_class, "p", "left").withColumn("c", F.coalesce("c", own)), "labelled-lists")

    tested, groups = settle(star_pairs(lists.withColumn("c", F.col("p")), 1, percent), None, None, "star")
    tested, groups = settle(star_pairs(labelled(groups), 8, percent), tested, groups, "stars")
    _, groups = settle(open_pairs(labelled(groups), texts, size, percent), tested, groups, "open")
    rows = base.join(groups, base["sig"] == groups["node"], "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("label", "sig")).alias("label"))
    named = rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("id").alias("component_id"))
    out = rows.join(named, "label", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
