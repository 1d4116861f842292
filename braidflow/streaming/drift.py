"""Drift of a score: means of adjacent windows against a two-sample bound."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def drift_windows(df: DataFrame, window: str, value: str, spread: float, delta: float) -> DataFrame:
    """``window, delta, bound, drift``: a window drifts if its mean leaves the previous one's by more than Hoeffding's bound for values within ``spread``."""
    w = df.groupBy(window).agg(F.count(value).alias("n"), F.avg(value).alias("m"))
    at = W.orderBy(window)
    p = w.withColumns({"n0": F.lag("n").over(at), "m0": F.lag("m").over(at)}).filter("m0 is not null")
    bound = spread * F.sqrt(math.log(2 / delta) / 2 * (1 / F.col("n") + 1 / F.col("n0")))
    d = F.abs(F.col("m") - F.col("m0"))
    return p.select(window, d.alias("delta"), bound.alias("bound"), (d > bound).alias("drift"))
