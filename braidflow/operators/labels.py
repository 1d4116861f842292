"""Joining flows to noisy label records: candidate edges, mutual uniqueness, class consensus.

Edges join on the whole endpoint key and a node of a binary tree over coarse time bins, so that the interval test becomes an
equi-join with a small residual. A label is the few nodes that cover its bins (at most two of each level); a flow, which is
short, is each of its bins at the levels that labels use. The pair is kept in one bin only. Nodes of a hot endpoint are
dealt over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .skew import salted_join


def audit_flags(rows: DataFrame, schedule: DataFrame, keys: list[str], case: str, expected_hosts: Column, slack_ns: int = 60 * 10**9) -> DataFrame:
    """``schedule_conflict``: no interval of the case overlaps (its end minute included); ``role_conflict``: no expected host takes part.

    ``schedule`` is small by nature (its size is checked by Spark's own broadcast threshold, so it is not hinted).
    """
    hit = (F.col("from_ns") < F.col("end_ns") + slack_ns) & (F.col("to_ns") >= F.col("start_ns"))
    s = schedule.withColumnRenamed(case, "_case")
    j = rows.join(s, (F.col(case) == F.col("_case")), "left")
    return j.groupBy(*keys).agg(
        (~F.coalesce(F.bool_or(hit), F.lit(False))).alias("schedule_conflict"), (~F.bool_or(F.arrays_overlap("hosts", expected_hosts))).alias("role_conflict")
    )


def cover(first: Column, last: Column, levels: int) -> Column:
    """Array of ``level, node``: the fewest nodes of a binary tree over bins that hold the bins ``first`` to ``last``, each once.

    Node ``n`` of level ``l`` holds the bins from ``n * 2^l``. A level gives a node at either end where the rest of the
    interval does not begin or end with a node of the next level.
    """
    shift = lambda c, by: F.call_function("shiftright", c, by)

    def at(level: Column) -> Column:
        a, e = -shift(-first, level), shift(last + 1, level)  # the part from the first whole node up to the last
        node = lambda c: F.struct(level.alias("level"), c.alias("node"))
        odd = lambda c: c.bitwiseAND(F.lit(1).cast("long")) == 1
        return F.when(a < e, F.filter(F.array(F.when(odd(a), node(a)), F.when(odd(e), node(e - 1))), lambda x: x.isNotNull()))

    return F.flatten(F.filter(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), at), lambda x: x.isNotNull()))


def candidate_edges(flows: DataFrame, labels: DataFrame, keys: list[str], tolerance: int, bin_width: int) -> DataFrame:
    """``flow_id, label_id, required``: pairs with equal keys whose intervals meet within ``tolerance``.

    Flows have ``start, end``; labels ``lo, hi`` (end exclusive). ``required`` is the least tolerance at which the pair
    would meet: 0 if they overlap, one more on the right side, where the end is exclusive.
    """
    bin_of = lambda c: F.floor(c / F.lit(bin_width)).cast("long")
    la = labels.withColumns({"_a": bin_of(F.col("lo")), "_z": bin_of(F.col("hi"))})
    longest = la.agg(F.max(F.col("_z") - F.col("_a"))).first()[0]
    levels = max(int(longest or 0) + 1, 1).bit_length() + 1
    la = la.withColumn("_n", F.explode(cover(F.col("_a"), F.col("_z"), levels))).select(*labels.columns, F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))
    used = sorted(r["_level"] for r in la.select("_level").distinct().collect())  # at most 64
    f = flows.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("start") - tolerance), bin_of(F.col("end") + tolerance))))
    nodes = F.array(*[F.struct(F.lit(k).alias("_level"), F.shiftright("_bin", k).alias("_node")) for k in used or [0]])
    f = f.select(*flows.columns, "_bin", F.inline(nodes))
    j = salted_join(f, la, [*keys, "_level", "_node"], "flow_id").filter((F.col("end") + tolerance >= F.col("lo")) & (F.col("hi") + tolerance > F.col("start")))
    first = F.greatest(bin_of(F.col("start") - tolerance), bin_of(F.col("lo")))
    required = F.when(F.col("end") < F.col("lo"), F.col("lo") - F.col("end")).when(F.col("hi") <= F.col("start"), F.col("start") - F.col("hi") + 1).otherwise(0)
    rest = [c for c in labels.columns if c not in (*keys, "label_id", "lo", "hi")]
    return j.filter(F.col("_bin") == first).select("flow_id", "label_id", *rest, required.cast("long").alias("required"))


def pairs(edges: DataFrame) -> DataFrame:
    """Variants of a pair collapsed: least required tolerance of all, and of the pair's edges without conflict."""
    free = ~(F.col("schedule_conflict") | F.col("role_conflict"))
    return edges.groupBy("flow_id", "label_id").agg(F.min("required").alias("raw"), F.min(F.when(free, F.col("required"))).alias("eligible"))


def mutual_unique(pairs_: DataFrame) -> DataFrame:
    """Pairs that are each other's only partner."""
    degree = lambda c: F.count("*").over(W.partitionBy(c))
    d = pairs_.withColumns({"_f": degree("flow_id"), "_l": degree("label_id")})
    return d.filter("_f = 1 and _l = 1").drop("_f", "_l")


def sweep(edges: DataFrame, n_flows: DataFrame, n_labels: DataFrame, tolerances: list[int]) -> DataFrame:
    """For every tolerance, how many flows and labels are matched, unmatched, ambiguous or in conflict.

    Pairs are collapsed once; each tolerance then looks at the same small table. ``n_flows`` and ``n_labels`` are one-row totals.
    """
    p = pairs(edges).withColumn("tolerance", F.explode(F.array(*[F.lit(t).cast("long") for t in tolerances]))).filter("raw <= tolerance")
    p = p.withColumn("ok", F.coalesce(F.col("eligible") <= F.col("tolerance"), F.lit(False)))
    ok = F.when(F.col("ok"), 1)
    w = lambda c: W.partitionBy("tolerance", c)
    p = p.withColumns({"fd": F.count(ok).over(w("flow_id")), "ld": F.count(ok).over(w("label_id"))})
    one = F.col("ok") & (F.col("fd") == 1) & (F.col("ld") == 1)
    by = lambda c, d: p.groupBy("tolerance", c).agg(F.max(d).alias("d")).groupBy("tolerance").agg(F.count("*").alias(f"{c}_seen"), F.count_if(F.col("d") == 0).alias(f"{c}_conflict"))
    m = p.groupBy("tolerance").agg(F.count_if(one).alias("matched"), F.count_if("ok").alias("eligible_pairs"), F.count("*").alias("raw_pairs"))
    t = p.sparkSession.createDataFrame([(t,) for t in tolerances], "tolerance long")
    j = t.join(m, "tolerance", "left").join(by("flow_id", "fd"), "tolerance", "left").join(by("label_id", "ld"), "tolerance", "left").na.fill(0)
    j = j.join(F.broadcast(n_flows.select(F.col("n").alias("flows")))).join(F.broadcast(n_labels.select(F.col("n").alias("labels"))))
    c = lambda side, total: {
        f"{side}_unmatched": F.col(total) - F.col(f"{side}_id_seen"), f"{side}_conflict": F.col(f"{side}_id_conflict"), f"{side}_ambiguous": F.col(f"{side}_id_seen") - F.col(f"{side}_id_conflict") - F.col("matched"),
    }
    out = c("flow", "flows") | c("label", "labels")
    return j.select("tolerance", "raw_pairs", "eligible_pairs", "matched", *[v.cast("long").alias(k) for k, v in out.items()])


def unmatched(left: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    return left.join(edges.select(key).distinct(), key, "left_anti")


def consensus(flows: DataFrame, edges: DataFrame, labels: DataFrame, tolerance: int) -> DataFrame:
    """Every flow with its ``method`` (how it got a class, or why not), ``label`` and sorted candidate ids.

    A flow whose candidates all name one class takes it: ``mutual_unique`` if the pair is each other's only partner,
    else ``class_consensus``. Candidates with conflicts do not count; with nothing else the flow is in conflict.
    """
    p = pairs(edges).filter(F.col("raw") <= tolerance)
    ok = p.filter(F.col("eligible") <= tolerance).join(labels.select("label_id", "label"), "label_id")
    ok = ok.withColumn("ld", F.count("*").over(W.partitionBy("label_id")))
    c = ok.groupBy("flow_id").agg(
        F.count("*").alias("n"), F.count_distinct("label").alias("classes"), F.min("label").alias("label"), F.max("ld").alias("ld"), F.array_sort(F.collect_set("label_id")).alias("candidate_ids")
    )
    raw = p.select("flow_id").distinct().withColumn("raw", F.lit(True))
    j = flows.select("flow_id").join(c, "flow_id", "left").join(raw, "flow_id", "left")
    method = (
        F.when((F.col("n") == 1) & (F.col("ld") == 1), "mutual_unique").when(F.col("classes") == 1, "class_consensus").when(F.col("classes") > 1, "mixed_candidate_classes")
        .when(F.col("raw"), "audit_conflict").otherwise("no_eligible_candidate")
    )
    return j.select(
        "flow_id", method.alias("method"), F.when(F.col("classes") == 1, F.col("label")).alias("label"), F.coalesce("n", F.lit(0)).cast("long").alias("candidates"),
        F.coalesce("candidate_ids", F.array().cast("array<bigint>")).alias("candidate_ids"),
    )


def strict_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row of audit counts of a join that should be one to one: sizes, repeated keys, unmatched rows of either side."""
    a = left.groupBy(*keys).agg(F.count("*").alias("a"))
    b = right.groupBy(*keys).agg(F.count("*").alias("b"))
    j = a.join(b, keys, "full_outer")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return j.agg(
        z("a").alias("left_rows"), z("b").alias("right_rows"), F.count_if(F.col("a") > 1).alias("left_repeats"), F.count_if(F.col("b") > 1).alias("right_repeats"),
        F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"),
    )


def nearest_in_time(alerts: DataFrame, flows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Each alert's flow of the same key whose start is nearest, within ``most``; the earlier start on ties.

    Starts are put in bins as wide as ``most``; an alert looks at its own bin and its neighbours.
    """
    f = flows.withColumn("_bin", F.floor(F.col("start") / F.lit(most)).cast("long"))
    a = alerts.withColumn("_at", F.floor(F.col("at") / F.lit(most)).cast("long")).withColumn("_bin", F.explode(F.array(F.col("_at") - 1, F.col("_at"), F.col("_at") + 1))).drop("_at")
    gap = F.abs(F.col("start") - F.col("at"))
    j = salted_join(a, f, [*keys, "_bin"], "alert_id").withColumn("gap", gap).filter(F.col("gap") <= most)
    return j.groupBy("alert_id").agg(F.min_by(F.struct("flow_id", "gap"), F.struct("gap", "start", "flow_id")).alias("m")).select("alert_id", "m.*")
