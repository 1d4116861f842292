"""Data-quality checks: each gives a small table of counts or truth values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import is_finite


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, counted with repeats; one aggregation over both."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_d")).unionByName(b.select(*cols, F.lit(-1).alias("_d")))
    n = both.groupBy(*cols).agg(F.sum("_d").alias("_d"))
    side = lambda sign: F.coalesce(F.sum(F.greatest(sign * F.col("_d"), F.lit(0))), F.lit(0)).cast("long")
    return n.agg(side(1).alias("left_only"), side(-1).alias("right_only"))


def invariants(row: DataFrame, checks: dict[str, Column]) -> DataFrame:
    return row.select(*[c.alias(n) for n, c in checks.items()])


def contiguous(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """Groups whose numbers are not 1 to their count."""
    g = df.groupBy(*by).agg(F.min(number).alias("least"), F.max(number).alias("most"), F.count("*").alias("n"), F.count_distinct(number).alias("distinct_n"))
    return g.filter((F.col("least") != 1) | (F.col("most") != F.col("n")) | (F.col("distinct_n") != F.col("n")))


def finite_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(~is_finite(F.col(c))).alias(c) for c in columns])


def leaking_blocks(df: DataFrame, block: list[str], partition: str) -> DataFrame:
    """Blocks that lie in more than one partition."""
    return df.groupBy(*block).agg(F.count_distinct(partition).alias("partitions")).filter("partitions > 1")


def missing_from(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows of ``a`` have no partner in ``b``."""
    return a.join(b.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("missing"))


def membership_digest(df: DataFrame, by: list[str], member: Column, digits: int = 4) -> DataFrame:
    """A digest of each group's members that does not depend on their order.

    Members are hashed, the hashes are dealt over ``16 ** digits`` buckets and each bucket's sorted hashes are hashed
    again, then the buckets' digests: a tree, so that no task holds a whole group. More members need more digits.
    """
    h = df.select(*by, F.sha2(member, 256).alias("h"))
    leaf = h.groupBy(*by, F.substring("h", 1, digits).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    return leaf.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))


def schema_fingerprint(df: DataFrame) -> str:
    import hashlib

    return hashlib.sha256(df.schema.json().encode()).hexdigest()


def content_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and order-free sum of row hashes."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("hash_sum"))
