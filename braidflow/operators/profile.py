"""Profiles of packets, tables and features: counts, histograms, mergeable statistics, quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def capture_accounting(packets: DataFrame, capture: str, parsed: Column, wire: str, captured: str) -> DataFrame:
    return packets.groupBy(capture).agg(
        F.count("*").alias("records"), F.count_if(parsed).alias("parsed"), F.count_if(~parsed).alias("errors"), F.sum(wire).alias("wire_bytes"), F.sum(captured).alias("captured_bytes")
    )


def histograms(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Counts of every value of every column, as rows of ``what, bucket, n``; one pass."""
    long = df.select(*by, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(by, columns, "what", "bucket")
    return long.groupBy(*by, "what", "bucket").agg(F.count("*").alias("n"))


def delta_statistics(df: DataFrame, by: list[str], v: str) -> DataFrame:
    c = F.col(v)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.count_if(c < 0).alias("negative"), F.count_if(c == 0).alias("zero"), F.count_if(c > 0).alias("positive"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most")
    )


def partials(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """Mergeable statistics: count, sum, minimum, maximum and the second moment about the own mean."""
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), (F.var_pop(v) * F.count(v)).alias("m2"))


def merge_partials(parts: DataFrame, by: list[str]) -> DataFrame:
    """Statistics of the union from :func:`partials` of its parts."""
    n, total = F.sum("n"), F.sum("total")
    t = F.col("total").cast("double")
    between = F.sum(t * t / F.col("n")) - F.sum(t) * F.sum(t) / n
    out = parts.filter("n > 0").groupBy(*by).agg(n.alias("n"), total.alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), (total / n).alias("mean"), F.sqrt((F.sum("m2") + between) / n).alias("std"))
    return out


def sorted_gaps(df: DataFrame, value: str, tie: str, width: int = 10**15) -> DataFrame:
    """Gap of each value to the next smaller one. A window per bucket of values; the buckets' edges come from a second, small one."""
    b = df.withColumn("_b", F.floor(F.col(value) / F.lit(width)).cast("long"))
    edges = b.groupBy("_b").agg(F.max(value).alias("_top"))
    edges = edges.select("_b", F.max("_top").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_below"))
    inside = F.lag(value).over(W.partitionBy("_b").orderBy(value, tie))
    return b.join(edges, "_b").withColumn("gap", F.col(value) - F.coalesce(inside, F.col("_below"))).drop("_b", "_below")


def column_health(df: DataFrame) -> DataFrame:
    """Null counts and shares of every column; one aggregation."""
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = row.unpivot(["_n"], df.columns, "col_name", "nulls")
    return long.select("col_name", F.col("_n").alias("n"), "nulls", (100.0 * F.col("nulls") / F.col("_n")).alias("percent"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of the classes; the window runs over the classes only."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))


def correlations(df: DataFrame, columns: list[str], target: str, least: float) -> DataFrame:
    """Pearson of every column with the target, and the pairs of columns at or over ``least``; one aggregation."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    cells = [("target", c, "y", F.corr(c, target)) for c in columns] + [("redundant", a, b, F.corr(a, b)) for a, b in pairs]
    row = df.agg(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")) for k, a, b, r in cells]).alias("cells"))
    flat = row.select(F.explode("cells").alias("c")).select("c.*")
    return flat.filter((F.col("kind") == "target") | (F.abs("r") >= least))


def feature_statistics(df: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """Mean, population deviation, range, exact quantiles and distinct values of every column."""
    v = df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])
    found = exact_quantiles(v, [(c, q) for c in v.columns for q in quantiles.values()])
    rows = [(c, *found[k * len(quantiles) : (k + 1) * len(quantiles)]) for k, c in enumerate(v.columns)]
    at = df.sparkSession.createDataFrame(rows, "_feature string, " + ", ".join(f"`{n}` double" for n in quantiles))
    long = v.unpivot([], v.columns, "feature", "v")
    g = long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most"), F.count_distinct("v").alias("distinct_values"))
    return g.join(F.broadcast(at), F.col("feature") == F.col("_feature")).select("feature", "mean", "std", "least", "most", *quantiles, "distinct_values")


def quantile_edges(df: DataFrame, column: str, bins: int) -> DataFrame:
    """One row with the sorted distinct quantile edges."""
    edges = sorted({e for e in exact_quantiles(df, [(column, k / bins) for k in range(bins + 1)]) if e is not None})
    return df.sparkSession.createDataFrame([(edges,)], "edges array<double>")


def bin_index(value: Column, edges: Column) -> Column:
    """Number of inner edges at or below the value."""
    return F.size(F.filter(F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))), lambda e: e <= value))


def quantile_bins(df: DataFrame, column: str, bins: int) -> DataFrame:
    """How many of the wanted quantile bins differ, and their least and greatest mass. The edges are one row."""
    edges = quantile_edges(df, column, bins)
    mass = df.select(column).join(F.broadcast(edges)).groupBy(bin_index(F.col(column), F.col("edges")).alias("bin"), F.size("edges").alias("e")).agg(F.count("*").alias("n"))
    return mass.groupBy("e").agg(F.min("n").alias("least"), F.max("n").alias("most")).select(F.lit(bins).alias("wanted"), (F.col("e") - 1).alias("effective"), (bins + 1 - F.col("e")).alias("collapsed"), "least", "most")


def clip_at(df: DataFrame, columns: list[str], q: float) -> DataFrame:
    """Columns cut at their own exact quantile."""
    top = dict(zip(columns, exact_quantiles(df, [(c, q) for c in columns]), strict=True))
    return df.withColumns({c: F.least(F.col(c), F.lit(t)) for c, t in top.items() if t is not None})


def zero_filled(df: DataFrame, column: str, values: list[str], name: str) -> DataFrame:
    """Counts of the listed values, 0 where absent."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"{name} string")
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return wanted.join(n, F.col(name) == F.col(column), "left").select(name, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
