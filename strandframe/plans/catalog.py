"""Registry of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, floats: str = "", digits: int = 6):
    """Register ``fn(spark, sf_dir)`` under ``name`` with an optional DuckDB twin.

    ``floats`` names the columns that depend on floating-point order; they are
    rounded to the same number of digits on both sides.
    """
    cols = floats.split()

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf: str) -> DataFrame:
            df = fn(spark, sf)
            for c in cols:
                df = df.withColumn(c, F.round(F.col(c), digits) + F.lit(0.0))
            return df

        QUERIES[name] = run
        if sql is not None:
            if cols:
                rounded = ", ".join(f'(round("{c}", {digits}) + 0.0)::DOUBLE AS "{c}"' for c in cols)
                SQL[name] = f"SELECT * REPLACE ({rounded}) FROM ({sql})"
            else:
                SQL[name] = sql
        return fn

    return register
