"""K-mer counts and sequence composition.

Counts per sequence first hash the compact sequences by name; the words are then
exploded and counted where they are, with no shuffle of exploded words.  Shares
over all sequences need no such step: partial sums leave one row per word and task.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.functions import sequence as S
from strandframe.operators.blocks import spread


def _by_name(seqs: DataFrame) -> DataFrame:
    return spread(seqs.select("name", "seq"), "name")


def _count(words: DataFrame) -> DataFrame:
    return words.groupBy("name", "kmer").agg(F.count(F.lit(1)).alias("cnt"))


def kmer_count_regular(seqs: DataFrame, k: int, alphabet: str = S.ALPHABET) -> DataFrame:
    """Count every ``k`` letter substring made of alphabet letters."""
    return _count(_by_name(seqs).select("name", F.explode(S.windows(F.col("seq"), k, alphabet=alphabet)).alias("kmer")))


def kmer_count_decreasing(seqs: DataFrame, k: int, min_length: int = 2, alphabet: str = S.ALPHABET) -> DataFrame:
    """Counts for all lengths from ``max(2, min_length)`` to ``k``."""
    sizes = range(max(2, min_length), k + 1)
    words = F.concat(*[S.windows(F.col("seq"), size, alphabet=alphabet) for size in sizes])
    return _count(_by_name(seqs).select("name", F.explode(words).alias("kmer")))


def kmer_count_gapped(seqs: DataFrame, k: int, gap: int, alphabet: str = S.ALPHABET) -> DataFrame:
    """Windows of ``k`` with ``gap`` letters left out after the first g letters, g = 1..k-gap-2.

    The letters in the gap may be any.
    """
    lefts = list(range(1, k - gap - 1))
    if not lefts:
        raise ValueError("k must be at least gap + 3")
    window = _by_name(seqs).select("name", F.explode(S.windows(F.col("seq"), k)).alias("w"))
    parts = [F.concat(F.substring("w", 1, g), F.substring("w", g + gap + 1, k)) for g in lefts]
    words = window.select("name", F.explode(F.array(*parts)).alias("kmer"))
    return _count(words.filter(F.translate("kmer", alphabet, "") == ""))


def kmer_count_mismatch(seqs: DataFrame, k: int, gap: int, alphabet: str = S.ALPHABET) -> DataFrame:
    """Every choice of ``gap`` inner positions of a ``k`` window is replaced by ``X``."""
    window = _by_name(seqs).select("name", F.explode(S.windows(F.col("seq"), k)).alias("w"))
    masked = []
    for hidden in combinations(range(1, k - 1), gap):
        spans, at = [], 0
        for i in [*hidden, k]:
            spans += [F.substring("w", at + 1, i - at)] if i > at else []
            spans += [F.lit("X")] if i < k else []
            at = i + 1
        masked.append(F.concat(*spans))
    words = window.select("name", F.explode(F.array(*masked)).alias("kmer"))
    return _count(words.filter(F.translate("kmer", alphabet + "X", "") == ""))


def kmer_count_by_region(seqs: DataFrame, regions: DataFrame, k: int, alphabet: str = S.ALPHABET) -> DataFrame:
    """``kmer_region`` counts; the region that covers most of the window is used.

    ``regions`` is ``(name, region, start, end)``, 0-based half open.  Every interval
    only cuts the part of the sequence that it touches, and all sums stay in the partition
    of the name.
    """
    kinds = regions.groupBy("name").agg(F.sort_array(F.collect_set("region")).alias("kinds"))
    r = regions.join(kinds, "name").select(
        "name", (F.array_position("kinds", F.col("region")) - 1).alias("kind"), F.col("start").cast("int").alias("rs"), F.col("end").cast("int").alias("re")
    )
    lo = F.greatest(F.lit(0), F.col("rs") - (k - 1))
    part = _by_name(seqs).join(r, "name").withColumn("lo", lo)
    part = part.select("name", "kind", "rs", "re", "lo", F.expr(f"substring(seq, lo + 1, re + {k - 1} - lo)").alias("part"))
    words = part.select("name", "kind", "rs", "re", "lo", F.posexplode(S.windows(F.col("part"), k)).alias("i", "word"))
    words = words.filter(F.translate("word", alphabet, "") == "").withColumn("s", F.col("lo") + F.col("i"))
    cover = F.least(F.col("re"), F.col("s") + k) - F.greatest(F.col("rs"), F.col("s"))
    per_kind = words.groupBy("name", "s", "word", "kind").agg(F.sum(cover).alias("cover"))
    # largest cover, then the first kind, as one number, so that the aggregation stays a hash aggregation
    top = per_kind.groupBy("name", "s", "word").agg(F.max(F.col("cover") * 1_000_000 + (999_999 - F.col("kind"))).alias("code"))
    counts = top.groupBy("name", "word", (999_999 - F.col("code") % 1_000_000).cast("int").alias("kind")).agg(F.count(F.lit(1)).alias("cnt"))
    names = kinds.select("name", F.posexplode("kinds").alias("kind", "region"))
    return counts.join(names, ["name", "kind"]).select("name", F.concat_ws("_", "word", "region").alias("kmer"), "cnt")


def kmer_vocabulary(seqs: DataFrame, k: int, alphabet: str = S.ALPHABET) -> DataFrame:
    """Distinct k-mers that occur."""
    return seqs.select(F.explode(S.windows(F.col("seq"), k, alphabet=alphabet)).alias("kmer")).distinct()


def kmer_count_vocab(seqs: DataFrame, vocabulary: DataFrame, k: int) -> DataFrame:
    """Counts against a given vocabulary table ``(kmer)``, for reuse on new sequences."""
    return kmer_count_regular(seqs, k).join(vocabulary.select("kmer").distinct(), "kmer", "left_semi")


def _fractions(words: DataFrame) -> DataFrame:
    counts = words.groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.withColumn("fraction", F.col("cnt") / F.sum("cnt").over(W.partitionBy(F.lit(0))))


def sequence_composition(seqs: DataFrame, k: int, alphabet: str = S.ALPHABET) -> DataFrame:
    """Share of each k-mer over all sequences (the window runs on the vocabulary only)."""
    return _fractions(seqs.select(F.explode(S.windows(F.col("seq"), k, alphabet=alphabet)).alias("kmer")))


def codon_composition(seqs: DataFrame, alphabet: str = S.ALPHABET) -> DataFrame:
    """Share of non-overlapping triplets from position 0."""
    words = seqs.select(F.explode(S.windows(F.col("seq"), 3, 3)).alias("kmer"))
    return _fractions(words.filter(F.translate("kmer", alphabet, "") == ""))


def compare_compositions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two composition tables side by side on common k-mers."""
    left = a.select("kmer", F.col("fraction").alias("fraction_a"))
    right = b.select("kmer", F.col("fraction").alias("fraction_b"))
    return left.join(right, "kmer")


def triplet_transition_probs(composition: DataFrame) -> DataFrame:
    """P(next base | triplet) from triplet shares, by suffix/prefix overlap."""
    a = composition.select(F.col("kmer").alias("triplet"), F.substring("kmer", 2, 2).alias("ov"))
    b = composition.select(
        F.substring("kmer", 1, 2).alias("ov"), F.substring("kmer", 3, 1).alias("next_base"), F.col("fraction").alias("f")
    )
    total = F.sum("f").over(W.partitionBy("triplet"))
    return a.join(b, "ov").select("triplet", "next_base", (F.col("f") / total).alias("p"))
