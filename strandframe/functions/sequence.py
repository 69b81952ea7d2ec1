"""Column functions on sequence strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "ACGT"


def reverse_complement(seq: Column) -> Column:
    """Reverse and swap A-T and C-G; other letters stay."""
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def windows(seq: Column, size: int, step: int = 1, alphabet: str | None = None) -> Column:
    """All substrings of ``size`` in order as an array (empty when the sequence is shorter).

    One regular-expression pass with a look-ahead: linear in the length, while a substring
    per start would walk the text from its beginning each time.  With ``alphabet`` only words
    made of its letters come out.
    """
    letter = f"[{alphabet}]" if alphabet else "."
    if step == 1:
        return F.regexp_extract_all(seq, F.lit(f"(?s)(?=({letter}{{{size}}}))"), F.lit(1))
    if step < size:
        raise ValueError("step must be 1 or at least the size")
    gap = f".{{0,{step - size}}}" if step > size else ""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(.{{{size}}}){gap}"), F.lit(1))


def pieces(seq: Column, size: int) -> Column:
    """The text cut into parts of ``size`` (the last may be shorter)."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))


def onehot(seq: Column, alphabet: str = ALPHABET) -> Column:
    """Array of 0/1 arrays; a letter outside the alphabet is a zero row."""
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.array(*[(c == a).cast("tinyint") for a in alphabet]))


def zero_flanks(seq: Column, left: int, right: int, fill: str = "N") -> Column:
    """Replace ``left`` and ``right`` outer letters by ``fill``."""
    n = F.length(seq)
    lo = F.least(F.lit(left), n)
    hi = F.least(F.lit(right), n - lo)
    return F.concat(
        F.repeat(F.lit(fill), lo), F.substr(seq, lo + 1, n - lo - hi), F.repeat(F.lit(fill), hi)
    )


def shift(seq: Column, by: Column, fill: str = "N") -> Column:
    """Same-length copy moved right by ``by`` letters (left when negative)."""
    n = F.length(seq)
    k = F.least(F.abs(by), n)
    pad = F.repeat(F.lit(fill), k)
    right = F.concat(pad, F.substr(seq, F.lit(1), n - k))
    left = F.concat(F.substr(seq, k + 1, n - k), pad)
    return F.when(by >= 0, right).otherwise(left)


def mask(seq: Column, start: Column, width: Column, fill: str = "N") -> Column:
    """Overlay a window (0-based start) with ``fill`` without changing the length."""
    n = F.length(seq)
    lo = F.least(start, n)
    w = F.least(width, n - lo)
    return F.concat(F.substr(seq, F.lit(1), lo), F.repeat(F.lit(fill), w), F.substr(seq, lo + w + 1, n - lo - w))


def apply_edits(seq: Column, edits: Column) -> Column:
    """Apply ``array<struct<pos,old,new>>`` edits (0-based) in order."""
    return F.aggregate(
        edits,
        seq,
        lambda s, e: F.concat(
            F.substr(s, F.lit(1), e["pos"]),
            e["new"],
            F.substr(s, e["pos"] + F.length(e["old"]) + 1, F.length(s)),
        ),
    )
