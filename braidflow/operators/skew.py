"""Joins whose hot keys are dealt over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of a side's rows, and more rows than :data:`LEAST_HOT`: at most a thousand are.
HOT_SHARE = 0.001
LEAST_HOT = 100_000
SALTS = 32


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str, least: int = LEAST_HOT, salts: int = SALTS) -> DataFrame:
    """Inner join on equal ``keys``; hot keys of ``left`` are dealt by a hash of ``spread`` over ``salts`` tasks, and their right rows repeated for each.

    Keys are counted by a map-side-combined aggregation first. Without hot keys it is a plain join.
    """
    n = left.count()
    hot = left.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > max(n * HOT_SHARE, least)).select(*keys)
    names = hot.collect()  # at most 1 / HOT_SHARE rows
    if not names:
        return left.join(right, keys)
    table = F.broadcast(left.sparkSession.createDataFrame(names, hot.schema).withColumn("_hot", F.lit(True)))
    a = left.join(table, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    all_, one = F.sequence(F.lit(0), F.lit(salts - 1)), F.array(F.lit(0))
    b = right.join(table, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), all_).otherwise(one))).drop("_hot")
    return a.join(b, [*keys, "_salt"]).drop("_salt")
