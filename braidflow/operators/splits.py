"""Leakage-safe splits over time blocks: whole blocks go to partitions; the allocator sees block counts only."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tie_hash(seed: int, *parts: Column) -> Column:
    """First 16 hexadecimal digits of a seeded hash."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256), 1, 16)


def block_counts(rows: DataFrame, capture: str, block: str, label: str) -> DataFrame:
    return rows.groupBy(F.col(capture).alias("capture_id"), F.col(block).alias("block"), F.col(label).alias("label")).agg(F.count("*").alias("n"))


def allocate(counts: DataFrame, ratios: dict[str, float], seed: int, fixed: DataFrame | None = None) -> DataFrame:
    """``capture_id, block, partition, source``: each block to the partition that it brings nearest to its share.

    Blocks come by greatest class share, size and seeded hash; a partition's cost is the squared deviation from its
    target, in total and for every class. Blocks of ``fixed`` (capture_id, block, partition) keep their place and count.
    One group is one capture's blocks, a few thousand rows of counts.
    """
    kept = fixed.select("capture_id", "block", F.col("partition").alias("fixed")) if fixed is not None else None
    c = counts.join(kept, ["capture_id", "block"], "left") if kept is not None else counts.withColumn("fixed", F.lit(None).cast("string"))
    kind = dict(counts.dtypes)["capture_id"]
    names = list(ratios)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        capture = pdf["capture_id"].iloc[0]
        wide = pdf.pivot_table(index="block", columns="label", values="n", aggfunc="sum", fill_value=0)
        place = pdf.groupby("block")["fixed"].first()
        totals = wide.sum()
        goal = {p: totals * r for p, r in ratios.items()}
        have = {p: totals * 0 for p in names}
        out = {}
        for b, p in place.dropna().items():
            have[p] = have[p] + wide.loc[b]
            out[b] = (p, "inherited")

        def rank(b):
            row = wide.loc[b]
            share = (row / totals.where(totals > 0, 1)).max()
            return (-share, -row.sum(), hashlib.sha256(f"{seed}|{capture}|{b}".encode()).hexdigest()[:16], b)

        def cost(p, row):
            new = have[p] + row
            parts = [((new.sum() - goal[p].sum()) / max(goal[p].sum(), 1)) ** 2, *(((new - goal[p]) / goal[p].where(goal[p] > 0, 1)) ** 2)]
            old = [((have[p].sum() - goal[p].sum()) / max(goal[p].sum(), 1)) ** 2, *(((have[p] - goal[p]) / goal[p].where(goal[p] > 0, 1)) ** 2)]
            return sum(parts) - sum(old)

        for b in sorted((b for b in wide.index if b not in out), key=rank):
            best = min(names, key=lambda p: (cost(p, wide.loc[b]), names.index(p)))
            have[best] = have[best] + wide.loc[b]
            out[b] = (best, "allocated")
        return pd.DataFrame({"capture_id": capture, "block": list(out), "partition": [v[0] for v in out.values()], "source": [v[1] for v in out.values()]})

    return c.groupBy("capture_id").applyInPandas(run, f"capture_id {kind}, block bigint, partition string, source string")


def apply_split(rows: DataFrame, split: DataFrame, capture: str, block: str) -> DataFrame:
    """``partition`` of every row by its block; the split map is joined by Spark's own choice of strategy."""
    s = split.select(F.col("capture_id").alias("_c"), F.col("block").alias("_b"), "partition")
    return rows.join(s, (F.col(capture) == F.col("_c")) & (F.col(block) == F.col("_b"))).drop("_c", "_b")


def leave_one_out(rows: DataFrame, family: str, partition: str, benign: str) -> DataFrame:
    """Rows of every leave-one-family-out experiment, counted by role: train and validation leave the family out, the test holds all of it.

    The families are few; each row is repeated once for each experiment that it serves.
    """
    families = rows.filter(F.col(family) != benign).groupBy(F.col(family).alias("holdout")).agg(F.count("*").alias("_n")).select("holdout")
    # (experiments are joined on a constant key: families are class names, not data)
    j = rows.withColumn("_k", F.lit(1)).groupBy("_k", family, partition).agg(F.count("*").alias("n")).join(families.withColumn("_k", F.lit(1)), "_k")
    role = F.when(F.col(family) == F.col("holdout"), "test").otherwise(F.col(partition))
    return j.groupBy("holdout", role.alias("role")).agg(F.sum("n").alias("rows"), F.sum(F.when(F.col(family) == F.col("holdout"), F.col("n")).otherwise(0)).alias("holdout_rows"))
