"""All-against-reference work in Arrow batches.

The reference side goes to the tasks as one broadcast only when its row count is
checked to be under a bound.  Above the bound both sides are cut into blocks and
co-grouped, so that no task holds more than one block of each side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.session import small_enough

Compare = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def against_reference(
    left: DataFrame, right: DataFrame, compare: Compare, schema: str, left_id: str, right_id: str,
    bound: int = 5_000, left_rows: int = 20_000, batch: int = 512,
) -> DataFrame:
    """Run ``compare(left_part, right_part)`` for every left row against every reference row.

    Above ``bound`` the result has one part per reference block; a best-match caller
    reduces the parts with an aggregation.
    """
    spark = left.sparkSession
    if small_enough(right, bound):
        ref = spark.sparkContext.broadcast(right.toPandas())

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for lo in range(0, len(part), batch):
                    out = compare(part.iloc[lo : lo + batch], ref.value)
                    if len(out):
                        yield out

        return spread(left, left_id).mapInPandas(run, schema)
    n_right, n_left = right.count(), left.count()
    blocks, salts = math.ceil(n_right / bound), math.ceil(n_left / left_rows)
    l = left.withColumn("__salt", F.pmod(F.xxhash64(left_id), F.lit(salts))).withColumn(
        "__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    r = right.withColumn("__block", F.pmod(F.xxhash64(right_id), F.lit(blocks)).cast("int")).withColumn(
        "__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    )
    # fresh column ids, so that both sides may come from one table
    r = r.select(*[F.col(c).alias(f"r_{c}") for c in r.columns])

    def pair(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame()
        a, b = a.drop(columns=["__salt", "__block"]), b.rename(columns=lambda c: c[2:]).drop(columns=["__salt", "__block"])
        found = [compare(a.iloc[lo : lo + batch], b) for lo in range(0, len(a), batch)]
        found = [x for x in found if len(x)]
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame()

    return l.groupBy("__block", "__salt").cogroup(r.groupBy("r___block", "r___salt")).applyInPandas(pair, schema)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash the rows of a compute-heavy map stage over ``spark.sql.shuffle.partitions`` tasks.

    A few input files would otherwise give a few tasks, whatever the amount of work per row.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
