"""Personal data and the terms that give it away.

Base patterns find e-mail addresses, IP addresses, card and phone numbers.  For every
such value, for what it shares with others (mail domain, network, first digits) and for its
kind, the corpus tells how much a term of the same document reveals it: how many bits
of the entity's information content the term leaves open, by a lower bound that allows for
few observations.  Terms over the disclosure threshold are spans too; a term that occurs
with that entity only is removed, any other is generalised to its kind of word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import settled, stored, text_of
from strandframe.session import maybe_broadcast

KINDS = ("email", "ip", "card", "phone")
# Same matches as the plain patterns, written so that they run in linear time: possessive repetition never
# backtracks, and a match begins at the start of a run of its letters or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORD = r"\p{L}\p{N}'"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string,mask:string>>"


def located(text: Column, pattern: Column, rank: int, kind: str) -> Column:
    """Spans of all matches; offsets in code points, end exclusive."""
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPAN).alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(
            begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"),
            x["hit"].alias("value"), F.lit(f"[{kind.upper()}]").alias("mask"),
        )
        return F.struct(end.alias("at"), F.concat(F.coalesce(a["out"], F.array().cast(SPAN)), F.array(span)).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    return F.coalesce(F.aggregate(pairs, start, step, lambda a: a["out"]), F.array().cast(SPAN))


def luhn(digits: Column) -> Column:
    """True for a digit string with a valid check digit."""
    places = F.sequence(F.lit(1), F.length(digits))
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(backwards, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Does a match of ``kind`` pass the test of that kind?"""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def holding(kind: str):
    return lambda s: holds(kind, s["value"])


def base_spans(text: Column) -> Column:
    """All spans of the base kinds by start, then kind."""
    found = []
    for rank, kind in enumerate(KINDS):
        spans = F.filter(located(text, F.lit(PATTERNS[kind]), rank, kind), holding(kind))
        found.append(F.when(text.rlike(NEEDS[kind]), spans).otherwise(F.array().cast(SPAN)))
    return F.sort_array(F.concat(*found))


def terms_of(text: Column) -> Column:
    """Distinct lower-case terms: runs of letters, digits and apostrophes with at least one letter."""
    runs = F.array_distinct(F.split(F.lower(text), f"[^{WORD}]+"))
    return F.filter(runs, lambda w: w.rlike(r"\p{L}"))


def outside_of(text: Column, spans: Column) -> Column:
    """The text with a blank for each span, also where spans overlap."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], F.array(gap)).alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat_ws(" ", a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def entity_levels(s: Column) -> Column:
    """What a span stands for: its value, what the value shares with others, its kind."""
    value = F.lower(s["value"])
    digits = F.regexp_replace(value, "[^0-9]", "")
    shared = (
        F.when(s["kind"] == "email", F.substring_index(value, "@", -1))
        .when(s["kind"] == "ip", F.substring_index(value, ".", 3))
        .when(s["kind"] == "card", F.substring(digits, 1, 6))
        .otherwise(F.substring(digits, 1, 5))
    )
    return F.array(F.concat(F.lit("="), value), F.concat(F.lit("~"), s["kind"], F.lit(" "), shared), F.concat(F.lit("*"), s["kind"]))


def with_terms(texts: DataFrame) -> DataFrame:
    """``id, h, entities, terms`` per row: what its values stand for and the distinct terms outside of them."""
    spans = settled(texts.withColumn("spans", base_spans(F.col("t"))))
    entities = F.array_distinct(F.flatten(F.transform("spans", entity_levels)))
    rest = F.when(F.size("spans") > 0, outside_of(F.col("t"), F.col("spans"))).otherwise(F.col("t"))
    return spans.select("id", "h", entities.alias("entities"), terms_of(rest).alias("terms"))


def contexts(rows: DataFrame, least_texts: float) -> DataFrame:
    """``h, copies, terms, known`` of the different texts with entities in ``least_texts`` different texts or more, and these.

    With fewer texts even a term that is always with the entity stays below the bound, so its pairs are not made.
    """
    texts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    single = rows.select("h", F.explode("entities").alias("entity")).distinct()
    often = single.groupBy("entity").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= least_texts)
    known = single.join(often.select("entity"), "entity").groupBy("h").agg(F.collect_set("entity").alias("known"))
    return texts.select("h", "copies", "terms").join(known, "h")


def disclosing_terms(texts: DataFrame, seen: DataFrame, open_bits: float, z: float) -> DataFrame:
    """``entity, term, sole``: terms that leave at most ``open_bits`` bits of an entity's information open.

    With n_t documents with the term outside of base spans, n_et of these with the entity and s
    different texts among them, P = n_et / n_t * s / (s + z^2) bounds the share from below
    (copies are no further evidence), and a term leaves -log2 P bits open.  ``seen`` has a row
    per different text, so both counts are added up before the shuffle.
    """
    joint = seen.groupBy("entity", "term").agg(F.sum("copies").alias("n_et"), F.count(F.lit(1)).alias("s")).where(F.col("s") >= _least_texts(open_bits, z))
    n_t = with_terms(texts).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    share = F.col("n_et") / F.col("n_t") * F.col("s") / (F.col("s") + z * z)
    taken = joint.join(n_t, "term").where(-F.log2(share) <= open_bits)
    return taken.select("entity", "term", (F.col("n_et") >= F.col("n_t")).alias("sole"))


def _least_texts(open_bits: float, z: float) -> float:
    """Texts without which s / (s + z^2) is below 2^-open_bits."""
    return z * z / (2.0**open_bits - 1.0)


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its mask; of overlapping spans the first is used."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        return F.when(s["start"] < a["at"], a).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(gap, s["mask"])).alias("out"))
        )

    return F.aggregate(
        spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))
    )


def sanitise(docs: DataFrame, open_bits: float = 1.0, z: float = 1.64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans, clean_text`` per input row.

    A term goes or is generalised when it leaves at most ``open_bits`` (above 0) bits open; ``z``
    is how many standard deviations the bound keeps from the observed share.
    ``spans`` holds (start, rank, end, kind, value, mask) of base kinds and of kind
    ``term``, by start.  A null text is empty and has no spans; rows with the same id
    and text get the same result; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    texts = base.withColumn("h", F.xxhash64("t"))
    rows = stored(with_terms(texts).where(F.size("entities") > 0), "entity-rows")
    met = stored(contexts(rows, _least_texts(open_bits, z)), "entity-terms")
    seen = met.select("h", "copies", F.explode("known").alias("entity"), "terms").select("h", "copies", "entity", F.explode("terms").alias("term"))
    found = maybe_broadcast(stored(disclosing_terms(texts, seen, open_bits, z), "disclosing-terms"))  # else a shuffled join
    per_text = (
        seen.join(found, ["entity", "term"])
        .groupBy(F.col("h").alias("_h"))
        .agg(
            F.collect_set(F.when(F.col("sole"), F.col("term"))).alias("gone"),
            F.collect_set("term").alias("terms"),
        )
    )
    met = texts.join(per_text, F.col("h") == F.col("_h"), "left")
    spans = settled(met.select("id", "t", "gone", "terms", base_spans(F.col("t")).alias("base")))
    pattern = F.concat(F.lit(f"(?iu)(?<![{WORD}])(?:"), F.array_join("terms", "|"), F.lit(f")(?![{WORD}])"))

    def with_mask(s: Column) -> Column:
        word = F.when(s["value"].rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[WORD]"))
        return s.withField("mask", F.when(F.array_contains("gone", F.lower(s["value"])), F.lit("[TERM]")).otherwise(word))

    outside = F.filter(
        located(F.col("t"), pattern, len(KINDS), "term"),
        lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    more = F.when(F.col("terms").isNotNull(), F.transform(outside, with_mask)).otherwise(F.array().cast(SPAN))
    every = settled(spans.select("id", "t", F.sort_array(F.concat("base", more)).alias("spans")))
    return every.select(F.col("id").alias(id_col), "spans", masked(F.col("t"), F.col("spans")).alias("clean_text"))
