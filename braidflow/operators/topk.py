"""Top-k, samples and round-robin selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written
from .windows import hinted


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group; Spark keeps only ``k`` rows of a group in a task before the shuffle."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def round_robin(items: DataFrame, family: str, order: list[Column], cap: int, total: int) -> DataFrame:
    """``items`` with ``depth, suppressed``: the first items of all families in turn, large families first, with how many of the family are left out.

    At most ``cap`` come from a family (0: no such limit) and ``total`` in all. A family of which nothing is taken has one
    row without an item. Families are counted by a grouped sum; only their first items are ranked.
    """
    cap = cap or total
    sizes = items.groupBy(F.col(family).alias("_f")).agg(F.count("*").alias("_size"))
    ranked = top_per_group(items, [family], order, cap)
    ranked = ranked.withColumn("depth", F.row_number().over(W.partitionBy(family).orderBy(*order)))
    ranked = ranked.join(sizes, F.col(family).eqNullSafe(F.col("_f"))).drop("_f")
    taken = ranked.orderBy("depth", F.desc("_size"), family).limit(total).drop("_size")
    counts = taken.groupBy(F.col(family).alias("_t")).agg(F.count("*").alias("_taken"))
    left = sizes.join(counts, F.col("_f").eqNullSafe(F.col("_t")), "left").select("_f", (F.col("_size") - F.coalesce("_taken", F.lit(0))).alias("suppressed"))
    out = left.join(taken, F.col(family).eqNullSafe(F.col("_f")), "left")
    return out.select(*[(F.col("_f") if c == family else F.col(c)).alias(c) for c in items.columns], "depth", "suppressed")


def even_sample(df: DataFrame, key: str, m: int) -> DataFrame:
    """``m`` rows at evenly spaced places of the key's order.

    The places come from exact counts of key ranges: a window over the ranges' totals, then one inside each range.
    """
    b = df.withColumn("_b", F.floor(F.col(key) / F.lit(100_000)).cast("long"))
    totals = b.groupBy("_b").agg(F.count("*").alias("_t"))
    w = W.orderBy("_b")
    totals = totals.select("_b", F.coalesce(F.sum("_t").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_t").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_n"))
    place = F.col("_before") + F.row_number().over(W.partitionBy("_b").orderBy(key)) - 1
    p = b.join(totals, "_b").withColumn("_p", place)
    k = F.ceil(F.col("_p") * (m - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    return p.filter((F.col("_n") <= m) | (F.floor(k * (F.col("_n") - 1) / (m - 1)) == F.col("_p"))).drop("_b", "_before", "_n", "_p")


def hash_fraction(key: Column, parts: int = 1000) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 7), 16, 10).cast("long") % parts / parts


def stratified(df: DataFrame, stratum: str, key: str, share: float) -> DataFrame:
    """Marks the first ``share`` of every stratum in hash order as ``chosen``.

    The hash's first digits deal a stratum over many ranges: their totals come first, then the order within each range.
    """
    h = df.withColumn("_h", F.sha2(F.col(key).cast("string"), 256)).withColumn("_b", F.substring("_h", 1, 4))
    sizes = h.groupBy(F.col(stratum).alias("_s"), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
    w = W.partitionBy("_s").orderBy("_c")
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum("_n").over(W.partitionBy("_s"))})
    j = h.join(sizes, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c")))
    place = F.col("_before") + F.row_number().over(W.partitionBy(stratum, "_b").orderBy("_h", key))
    return j.withColumn("chosen", place <= F.floor(F.col("_total") * share)).select(*df.columns, "chosen")


def first_share(df: DataFrame, stratum: str, key: str, share: float) -> DataFrame:
    """The rows that :func:`stratified` marks, without moving all others.

    Counts by a stratum's hash ranges name the range in which each share ends. Rows of earlier ranges are taken where they
    lie; only rows of those single ranges are ordered.
    """
    h = df.withColumn("_h", F.sha2(F.col(key).cast("string"), 256)).withColumn("_b", F.substring("_h", 1, 4))
    sizes = h.groupBy(F.col(stratum).alias("_s"), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
    w = W.partitionBy("_s").orderBy("_c")
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_most": F.floor(F.sum("_n").over(W.partitionBy("_s")) * share)})
    ends = written(sizes.filter((F.col("_before") < F.col("_most")) & (F.col("_before") + F.col("_n") >= F.col("_most"))), "share-ends")  # a row for each stratum
    j = h.join(hinted(ends), F.col(stratum).eqNullSafe(F.col("_s")))
    whole = j.filter(F.col("_b") < F.col("_c")).select(*df.columns)
    place = F.col("_before") + F.row_number().over(W.partitionBy(stratum, "_b").orderBy("_h", key))
    last = j.filter(F.col("_b") == F.col("_c")).withColumn("_p", place).filter(F.col("_p") <= F.col("_most"))
    return whole.unionByName(last.select(*df.columns))
