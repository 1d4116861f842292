"""Alert logs, replays and attempts: flattening, joins with ground truth, confusions and latency summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, group_quantiles, group_ranks
from .topk import top_per_group
from .windows import running_max

_FLOW = "flow struct<protocol: string, source: struct<ip: string, port: string>, destination: struct<ip: string, port: string>>"
#: The fields of alert lines that a flat row needs; fixed values are the names of the events.
ALERT = f"event_type string, decision string, packet_count bigint, {_FLOW}, evidence struct<flow_rf: struct<attack_probability: double>, known_family: struct<top_candidate: string, confidence: double>>"
TERMINAL = (
    f"event_type string, decision string, packet_count bigint, close_reason string, acceptance_eligible boolean, attempt_id string, last_event_timestamp_ns bigint, {_FLOW}, scores struct<attack_score: double, "
    "class_confidence: double, top_attack_candidate: struct<class_name: string>, attack_gate: struct<attack_score: double>, gated_decision: struct<class_confidence: double>>"
)
ALERT_EVENT, TERMINAL_DECISION, TERMINAL_ALERT = "nids_alert", "nids_terminal_flow_decision", "nids_terminal_flow_alert"


READY_EVENT, SUMMARY_EVENT = "nids_dpdk_live_ready", "nids_dpdk_live_summary"
#: The fields of a sensor's log that tell of a run; fixed values are the names.
RUN = "event_type string, decision string, packets_seen bigint, packets_parsed bigint, parser_errors bigint, stop_reason string, evidence struct<known_family: struct<top_candidate: string, confidence: double>>"


def _endpoint(side: str) -> Column:
    part = lambda c: F.coalesce(F.col(f"_a.flow.{side}.{c}"), F.lit("None"))
    return F.concat_ws(":", part("ip"), part("port")).alias(side)


def _protocol() -> Column:
    return F.upper(F.coalesce(F.when(F.col("_a.flow.protocol") != "", F.col("_a.flow.protocol")), F.lit("?"))).alias("protocol")


def flatten_alerts(lines: DataFrame, column: str, model: str = "F9") -> DataFrame:
    """A sensor's alert lines as flat rows beside the other columns; works on streams. Other lines, and those that are no JSON, are left out."""
    p = lines.withColumn("_a", F.from_json(column, ALERT, {"mode": "PERMISSIVE"})).filter(F.col("_a.event_type") == ALERT_EVENT)
    e = "_a.evidence"
    return p.select(
        *[c for c in lines.columns if c != column], F.lit(model).alias("model"), F.col("_a.decision").alias("decision"), F.col(f"{e}.known_family.top_candidate").alias("candidate"), F.round(f"{e}.flow_rf.attack_probability", 6).alias("flow_rf_probability"),
        F.round(f"{e}.known_family.confidence", 6).alias("confidence"), _endpoint("source"), _endpoint("destination"), _protocol(), F.col("_a.packet_count").alias("packet_count"),
    )


def flatten_terminal(lines: DataFrame, column: str) -> DataFrame:
    """Decision and alert lines of closed flows as one flat form; other lines are left out.

    A decision has its scores by gate and candidate, an alert flat ones and the candidate as its decision.
    """
    p = lines.withColumn("_a", F.from_json(column, TERMINAL, {"mode": "PERMISSIVE"})).filter(F.col("_a.event_type").isin(TERMINAL_DECISION, TERMINAL_ALERT))
    s, gated = "_a.scores", F.col("_a.event_type") == TERMINAL_DECISION
    either = lambda a, b: F.when(gated, F.col(a)).otherwise(F.col(b))
    benign = F.lower(F.trim(F.coalesce("_a.decision", F.lit("")))) == "benign"
    return p.select(
        *[c for c in lines.columns if c != column], F.lit("terminal").alias("model"), F.when(benign, "benign").otherwise("known_attack").alias("decision"), either(f"{s}.top_attack_candidate.class_name", "_a.decision").alias("candidate"), F.col("_a.decision").alias("terminal_class"),
        F.round(either(f"{s}.attack_gate.attack_score", f"{s}.attack_score"), 6).alias("flow_rf_probability"), F.round(either(f"{s}.gated_decision.class_confidence", f"{s}.class_confidence"), 6).alias("confidence"), _endpoint("source"), _endpoint("destination"),
        _protocol(), F.col("_a.attempt_id").alias("attempt"), F.col("_a.packet_count").alias("packet_count"), F.col("_a.close_reason").alias("close_reason"), F.col("_a.acceptance_eligible").alias("acceptance_eligible"),
        F.col("_a.event_type").alias("source_event_type"), F.col("_a.last_event_timestamp_ns").alias("timestamp_ns"),
    )


def prefer_decisions(rows: DataFrame, log: str) -> DataFrame:
    """Rows of :func:`flatten_terminal` without the alerts of logs that have decisions: there every alert repeats one."""
    full = rows.filter(F.col("source_event_type") == TERMINAL_DECISION).select(F.col(log).alias("_log")).distinct().withColumn("_full", F.lit(True))
    j = rows.join(full, F.col(log).eqNullSafe(F.col("_log")), "left")
    return j.filter((F.col("source_event_type") == TERMINAL_DECISION) | F.col("_full").isNull()).drop("_log", "_full")


def clock_offsets(logs: DataFrame, by: str, wall: str, checkpoint: str, order: str, idle_ns: int) -> DataFrame:
    """Wall start plus idle time less the first checkpoint of every log."""
    return logs.groupBy(by).agg((F.min(wall) + F.lit(idle_ns) - F.min_by(checkpoint, order)).alias("offset_ns"))


def by_segment(alerts: DataFrame, segments: DataFrame, line: str, candidate: str) -> DataFrame:
    """Alerts with the replay segment whose line range holds them and a verdict: expected, unexpected or uncovered.

    Segments and alerts lie in one order, so no range join is needed: the last start at or before an alert's line is its
    segment if its end is not passed. The order is walked in chunks of lines, so that no log lands in one task.
    """
    place = lambda c, after: (2 * c.cast("long") + after).alias("_l")
    s = segments.select("log", place(F.col("from_line"), 0), F.struct("from_line", "to_line", "segment", "allowed").alias("_s"), F.lit(0).alias("_o"))
    a = alerts.select("*", place(F.col(line), 1), F.lit(1).alias("_o"))
    u = running_max(a.unionByName(s, allowMissingColumns=True), ["log"], "_l", "_s", "_in").filter("_o = 1")
    inside = F.col("_in").isNotNull() & (F.col(line) <= F.col("_in.to_line"))
    verdict = F.when(~inside | F.col("_in").isNull(), "uncovered").when(F.array_contains(F.col("_in.allowed"), F.col(candidate)), "expected").otherwise("unexpected")
    return u.withColumns({"verdict": verdict, "segment": F.when(inside, F.col("_in.segment"))}).drop("_l", "_s", "_o", "_in")


def best_attempt(attempts: DataFrame, case: str, order: str) -> DataFrame:
    """The first alerting attempt of a case, else the one with most packets."""
    rank = F.struct((F.col("alerts") == 0).cast("int").alias("a"), F.when(F.col("alerts") > 0, F.col(order)).otherwise(-F.col("packets")).alias("b"), F.col(order).alias("c"))
    return attempts.groupBy(case).agg(F.min_by(F.struct("attempt", "alerts", "packets"), rank).alias("m")).select(case, "m.*")


def compare(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Two results of the same cases side by side, with a note."""
    x = a.select(key, F.col(value).alias("offline"))
    y = b.select(key, F.col(value).alias("online"))
    note = F.when(F.col("online").isNull(), "no_online").when(F.col("offline").isNull(), "no_offline").when(F.col("online") == F.col("offline"), "same").otherwise("different")
    return x.join(y, key, "full_outer").withColumn("note", note)


def confusion(rows: DataFrame, truth: str, output: str, at: str, families: list[str], k: int = 5) -> DataFrame:
    """For every family: total, correct, accuracy, most frequent outputs and the time range; zero rows for absent ones."""
    cells = rows.groupBy(truth, output).agg(F.count("*").alias("n"), F.min(at).alias("t0"), F.max(at).alias("t1"))
    rank = F.row_number().over(W.partitionBy(truth).orderBy(F.desc("n"), output))
    g = cells.withColumn("r", rank).groupBy(truth).agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col(truth) == F.col(output), F.col("n")).otherwise(0)).alias("correct"),
        F.array_sort(F.collect_list(F.when(F.col("r") <= k, F.struct("r", output, "n")))).alias("top"), F.min("t0").alias("first_at"), F.max("t1").alias("last_at"),
    )
    f = rows.sparkSession.createDataFrame([(x,) for x in families], "family string")
    j = f.join(g, F.col("family") == F.col(truth), "left")
    shown = F.array_join(F.transform("top", lambda x: F.concat_ws(":", x[output], x["n"].cast("string"))), ",")
    return j.select(
        "family", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("correct", F.lit(0)).alias("correct"), F.coalesce(F.col("correct") / F.col("total"), F.lit(0.0)).alias("accuracy"), F.coalesce(shown, F.lit("")).alias("top"), "first_at", "last_at",
    )


def score_parity(a: DataFrame, b: DataFrame, key: str, score: str, decision: str, tolerance: float) -> DataFrame:
    """Largest score difference of two scorings of the same rows, rows beyond the tolerance, and unequal decisions."""
    j = a.select(key, F.col(score).alias("_x"), F.col(decision).alias("_p")).join(b.select(key, F.col(score).alias("_y"), F.col(decision).alias("_q")), key)
    delta = F.abs(F.col("_x") - F.col("_y"))
    return j.agg(F.count("*").alias("n"), F.max(delta).alias("max_delta"), F.count_if(delta > tolerance).alias("beyond"), F.count_if(~F.col("_p").eqNullSafe(F.col("_q"))).alias("unequal"))


def boundary_cases(scored: DataFrame, score: str, key: str, threshold: float) -> DataFrame:
    """The row nearest to the threshold on either side."""
    side = F.when(F.col(score) < threshold, "below").otherwise("above")
    return top_per_group(scored.withColumns({"side": side, "_d": F.abs(F.col(score) - threshold)}), ["side"], [F.asc("_d"), F.asc(key)], 1).select("side", key, score)


def ordered_match(a: DataFrame, b: DataFrame, ordinal: str, columns: list[str]) -> DataFrame:
    """Row-by-row comparison by ordinal: extra and missing rows, unequal rows, and the first ordinal that differs."""
    x = a.select(ordinal, F.struct(*columns).alias("_x"))
    y = b.select(ordinal, F.struct(*columns).alias("_y"))
    j = x.join(y, ordinal, "full_outer")
    off = ~F.col("_x").eqNullSafe(F.col("_y"))
    return j.agg(F.count_if(F.col("_y").isNull()).alias("extra"), F.count_if(F.col("_x").isNull()).alias("missing"), F.count_if(off).alias("unequal"), F.min(F.when(off, F.col(ordinal))).alias("first_at"))


def window_runs(packets: DataFrame, wanted: DataFrame, keys: list[str], order: str, ts: str) -> DataFrame:
    """Runs of ``forward + reverse`` consecutive packets of a key with non-decreasing times, the exact duration and the exact
    direction counts; only keys with just one such run remain. Prefix sums turn every test into a difference of two rows."""
    w = W.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    back = F.coalesce((F.col(ts) < F.lag(ts).over(w)).cast("int"), F.lit(0))
    p = packets.withColumns({"_r": F.row_number().over(w), "_b": back}).withColumns({"_f": F.sum((F.col("direction") == "forward").cast("int")).over(upto), "_back": F.sum("_b").over(upto)})
    size = F.col("forward") + F.col("reverse")
    a = p.join(wanted, keys).select(*keys, "forward", "reverse", "duration", F.col("_r").alias("from_row"), (F.col("_r") + size - 1).alias("to_row"), (F.col("_f") - (F.col("direction") == "forward").cast("int")).alias("_f0"), F.col("_back").alias("_b0"), F.col(ts).alias("_t0"))
    e = p.select(*keys, F.col("_r").alias("to_row"), F.col("_f").alias("_f1"), F.col("_back").alias("_b1"), F.col(ts).alias("_t1"))
    m = a.join(e, [*keys, "to_row"]).filter((F.col("_f1") - F.col("_f0") == F.col("forward")) & (F.col("_b0") == F.col("_b1")) & (F.col("_t1") - F.col("_t0") == F.col("duration")))
    return m.groupBy(*keys).agg(F.count("*").alias("n"), F.min("from_row").alias("from_row"), F.min("to_row").alias("to_row")).filter("n = 1").drop("n")


def percentile_rules(df: DataFrame, by: list[str], v: str, p: float) -> DataFrame:
    """One share by four rules: linear; nearest rank; rounded half to even, clamped; zero-based index, clamped."""
    ranks = {"nearest_rank": lambda n: max(math.ceil(n * p), 1) - 1, "half_even": lambda n: min(max(round(n * p + 0.5), 1), n) - 1, "zero_based": lambda n: min(math.floor(n * p), n - 1)}
    found = group_ranks(df, by[0], v, ranks) if len(by) == 1 else None
    if found is None:  # many groups: each is ranked by itself
        w = W.partitionBy(*by)
        r = df.withColumns({"_i": F.row_number().over(w.orderBy(v)), "_n": F.count("*").over(w)})
        at = lambda rank: F.max(F.when(F.col("_i") == rank, F.col(v)))
        n = F.col("_n")
        even = F.least(F.greatest(F.bround(n * p + 0.5), F.lit(1)), n)
        return r.groupBy(*by).agg(F.percentile(v, F.lit(p)).alias("linear"), at(F.greatest(F.ceil(n * p), F.lit(1))).alias("nearest_rank"), at(even).alias("half_even"), at(F.least(F.floor(n * p), n - 1) + 1).alias("zero_based"))
    linear = group_quantiles(df, by[0], v, {"linear": p}).withColumnRenamed(by[0], "_by")
    return found.join(F.broadcast(linear), F.col(by[0]).eqNullSafe(F.col("_by"))).select(*by, "linear", *ranks)


def latency_summary(df: DataFrame, stage: str, v: str) -> DataFrame:
    """Count, quantiles, maximum and mean of every stage."""
    q = group_quantiles(df, stage, v, {f"p{round(s * 100)}": s for s in (0.5, 0.95, 0.99)}).withColumnRenamed(stage, "_stage")
    g = df.groupBy(stage).agg(F.count("*").alias("n"), F.max(v).alias("most"), F.avg(v).alias("mean"))
    return g.join(F.broadcast(q), F.col(stage).eqNullSafe(F.col("_stage"))).select(stage, "n", "p50", "p95", "p99", "most", "mean")


def pick(column: Column, values: list[str]) -> Column:
    return F.count_if(column.isin(*values))


def sensor_runs(lines: DataFrame, column: str, log: str, line: str) -> DataFrame:
    """A row for each log: packets seen and parsed, parser errors, number of alerts, whether it got ready, and why it stopped.

    The log's last summary line counts, with 0 for what it lacks; a log without one has zeros and no reason. Empty lines and
    lines that are no JSON say nothing. Alerts themselves are :func:`sensor_candidates`, as a log may hold any number.
    """
    p = lines.withColumn("_a", F.from_json(column, RUN, {"mode": "PERMISSIVE"}))
    kind = F.col("_a.event_type")
    last = F.max_by("_a", F.when(kind == SUMMARY_EVENT, F.col(line)))
    runs = p.groupBy(log).agg(last.alias("_s"), F.count_if(kind == ALERT_EVENT).alias("alerts"), F.coalesce(F.bool_or(kind == READY_EVENT), F.lit(False)).alias("ready"), F.count_if(kind == SUMMARY_EVENT).alias("_n"))
    of = lambda c: F.when(F.col("_n") > 0, F.col(f"_s.{c}"))
    numbers = [F.coalesce(of(c), F.lit(0).cast("long")).alias(c) for c in ("packets_seen", "packets_parsed", "parser_errors")]
    return runs.select(log, *numbers, "alerts", "ready", of("stop_reason").alias("stop_reason"))


def sensor_candidates(lines: DataFrame, column: str, log: str, line: str) -> DataFrame:
    """The alerts of the logs: ``log, line, top_candidate, confidence, decision``; what an alert lacks is null."""
    p = lines.withColumn("_a", F.from_json(column, RUN, {"mode": "PERMISSIVE"})).filter(F.col("_a.event_type") == ALERT_EVENT)
    known = "_a.evidence.known_family"
    return p.select(log, line, F.col(f"{known}.top_candidate").alias("top_candidate"), F.col(f"{known}.confidence").alias("confidence"), F.col("_a.decision").alias("decision"))


def score_metrics(scored: DataFrame, decision: str, passed: str, expected: Column) -> DataFrame:
    """One row: rows, correct ones, accuracy, rows that passed the gate and their share; shares are null without rows."""
    n, right, through = F.count("*"), F.count_if(F.col(decision) == expected), F.count_if(F.col(passed))
    some = F.when(n > 0, n)
    return scored.agg(n.alias("rows"), right.alias("correct"), (right / some).alias("accuracy"), through.alias("gate_passed"), (through / some).alias("attack_detection_rate"))


def score_counts(scored: DataFrame, columns: list[str]) -> DataFrame:
    """``kind, name, n``: how often each class occurs in each of the columns, in one pass."""
    each = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("name")) for c in columns])
    return scored.select(F.inline(each)).groupBy("kind", "name").agg(F.count("*").alias("n"))


#: The quantiles that a feature's distribution shows.
DISTRIBUTION = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def distributions(df: DataFrame, features: list[str]) -> DataFrame:
    """``feature, count, min, p25, median, p75, p95, p99, max`` of the values that are there; quantiles are exact and linear."""
    v = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    q = exact_quantiles(v, [(f, s) for f in features for s in DISTRIBUTION.values()])
    r = v.agg(*[g(f).alias(f"{n}_{k}") for k, f in enumerate(features) for n, g in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    each = len(DISTRIBUTION)
    rows = [(f, r[f"n_{k}"], r[f"lo_{k}"], *q[each * k : each * k + each], r[f"hi_{k}"]) for k, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, count long, min double, " + ", ".join(f"{n} double" for n in DISTRIBUTION) + ", max double")


def resource_summary(samples: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Mean and maximum of each sampled resource, to one digit; 0 where no sample has it."""
    stat = lambda g, c: F.coalesce(F.round(g(c), 1), F.lit(0.0))
    return samples.groupBy(by).agg(*[stat(g, c).alias(f"{c}_{n}") for c in columns for n, g in (("mean", F.avg), ("max", F.max))])
