"""Quality rules as a ledger of failure bits.

Each rule is evaluated once per document.  The ledger holds one bit per failed rule and
the measurements behind it; policies are versioned bit masks over the same ledger, and
ablations are counted from the distinct bit patterns, never from the texts again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import settled, text_of, words

# Rule -> condition on the measurements under which a document fails. The order fixes the bits.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "shouting": "100 * n_upper > 40 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}
# Policy version -> rules that reject under it.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_windows"),
    "v2": tuple(RULES),
}


def rule_bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def policy_mask(policy: str, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> int:
    return sum(rule_bit(r) for r in policies[policy])


def repeated_window_words(w: Column, size: int = 3) -> Column:
    """Words inside windows of ``size`` words that occur twice or more in the array.

    One sort by hash, then by the words themselves, brings equal windows together,
    whatever other windows share their hash.
    """
    names = [f"w{k}" for k in range(size)]
    keys = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.size(w) - size),
            lambda i: F.struct(
                F.xxhash64(*(w[i + k] for k in range(size))).alias("h"), *(w[i + k].alias(n) for k, n in enumerate(names)), i.cast("long").alias("place")
            ),
        )
    )

    def found_again(x: Column, y: Column) -> Column:
        same = x["h"] == y["h"]
        for n in names:
            same = same & (x[n] == y[n])
        return F.coalesce(same, F.lit(False))

    def repeats(s: Column) -> Column:
        hits = F.filter(s, lambda x, j: ((j > 0) & found_again(x, F.get(s, j - 1))) | found_again(x, F.get(s, j + 1)))
        places = F.sort_array(F.transform(hits, lambda x: x["place"]))
        start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            places,
            start,
            lambda a, p: F.struct((p + size).alias("end"), (a["n"] + p + size - F.greatest(p, a["end"])).alias("n")),
            lambda a: a["n"],
        )

    # A one-element transform binds the sorted keys to a name, so that they are sorted once.
    counted = F.element_at(F.transform(F.array(keys), repeats), 1)
    return F.when(F.size(w) > size, counted).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row of measurements per input row, all as long; with ``row_col`` also the whole input row as a struct."""
    row = [] if row_col is None else [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")]
    text = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"), *row)
    carried = [F.col("_id").alias(id_col)] + ([] if row_col is None else [F.col("_row").alias(row_col)])
    split = settled(
        text.select(
            *carried,
            "_t",
            words(F.col("_t")).alias("_w"),
            F.filter(F.split(F.col("_t"), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        )
    )
    w, lines, t = F.col("_w"), F.col("_l"), F.col("_t")
    long = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")),
        "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_window_words(w),
    }
    names = [id_col] + ([] if row_col is None else [row_col])
    return settled(split.select(*names, *(c.cast("long").alias(k) for k, c in long.items())))


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Measurements and ``fail_bits`` (one bit per failed rule, see ``RULES``) per input row.

    A null or empty text measures 0 throughout and fails ``few_words`` only.  Rows with
    null or repeated ids are judged each by itself; an empty table gives an empty
    ledger; other columns of the input are ignored, or kept inside ``row_col``.
    """
    measured = measure(docs, id_col, text_col, row_col)
    bits = F.lit(0).cast("long")
    for rule, fails in RULES.items():
        failed = F.expr(fails) if isinstance(fails, str) else fails
        bits = bits + F.when(failed, F.lit(rule_bit(rule))).otherwise(F.lit(0))
    return measured.withColumn("fail_bits", bits)


def apply_policy(ledger: DataFrame, policy: str = "v2", policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """The ledger with ``policy`` and ``kept``: no bit of the policy's mask is set."""
    mask = F.lit(policy_mask(policy, policies))
    return ledger.withColumns({"policy": F.lit(policy), "kept": F.col("fail_bits").bitwiseAND(mask) == 0})


def ablations(ledger: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """Per policy and rule: documents rejected, hit by the rule, and rejected by it alone.

    Works on the counted bit patterns, of which there are at most 2 to the number of rules.
    """
    patterns = ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    cells = [
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(policy_mask(p, policies)).cast("long").alias("mask"), F.lit(rule_bit(r)).cast("long").alias("bit"))
        for p, rules in policies.items()
        for r in rules
    ]
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))

    def total(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))

    return (
        patterns.select("fail_bits", "n", F.inline(F.array(*cells)))
        .groupBy("policy", "rule")
        .agg(
            F.sum("n").alias("n_docs"),
            total(hit != 0).alias("n_rejected"),
            total(hit.bitwiseAND(F.col("bit")) != 0).alias("n_hit"),
            total(hit == F.col("bit")).alias("n_only"),
        )
    )
