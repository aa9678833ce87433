"""Joins whose left side may have a few keys that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, spread: str, count: str, hot_rows: int = 200_000, salts: int = 64) -> DataFrame:
    """Inner join of ``rows`` with a ``lookup`` that is unique by ``key`` and carries in ``count`` the rows per key.

    Keys of more than ``hot_rows`` rows are hot. Of those there are at most rows / ``hot_rows``, so their list is small
    by construction and may be broadcast; their rows are spread over ``salts`` tasks by a hash of ``spread``, and only
    their lookup rows are repeated. All other keys take one plain shuffle join. NULL keys match nothing.
    """
    hot = lookup.filter(F.col(count) > hot_rows).select(F.col(key).alias("__hot"))
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    left = left.withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(F.col(spread)), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("__hot")
    every = F.when(F.col(count) > hot_rows, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.withColumn("__salt", F.explode(every))
    return left.join(right, [key, "__salt"]).drop("__salt")
