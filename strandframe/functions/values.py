"""Column functions that parse values and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_kind(text: Column) -> Column:
    """Kind of a parameter string: bool, none, int, float, list or string."""
    return (
        F.when(text.isin("True", "False"), "bool")
        .when(text.isin("None", "none"), "none")
        .when(text.try_cast("bigint").isNotNull() & text.rlike(r"^[+-]?\d+$"), "int")
        .when(text.try_cast("double").isNotNull(), "float")
        .when(text.contains(",") | text.rlike(r"^\[.*\]$"), "list")
        .otherwise("string")
    )


def as_number(text: Column) -> Column:
    return text.try_cast("double")


def as_list(text: Column) -> Column:
    """``[a,b]`` or ``a,b`` to an array of trimmed strings."""
    return F.transform(F.split(F.regexp_replace(text, r"^\[|\]$", ""), ","), lambda x: F.trim(x))


def strip_version(name: Column) -> Column:
    """``ENSG1.3`` to ``ENSG1``."""
    return F.substring_index(name, ".", 1)


def strip_suffix(name: Column, sep: str = "_") -> Column:
    """Drop the part after the last separator (replicate suffix)."""
    return F.regexp_replace(name, f"{sep}[^{sep}]*$", "")


def last_part(name: Column, sep: str = ".") -> Column:
    return F.substring_index(name, sep, -1)


def seqlet_parts(name: Column) -> Column:
    """``seq_track_start-end`` to a struct; the sequence name may itself hold ``_``."""
    pattern = r"^(.*)_([^_]*)_(\d+)-(\d+)$"
    return F.struct(
        F.regexp_extract(name, pattern, 1).alias("seq"),
        F.regexp_extract(name, pattern, 2).alias("track"),
        F.regexp_extract(name, pattern, 3).try_cast("int").alias("start"),
        F.regexp_extract(name, pattern, 4).try_cast("int").alias("end"),
    )
