"""Alert logs, replays, attempts and selections over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import topk
from .bindings import DAY, HOUR, PE, PL, packets_e, packets_l, rounded, table
from .registry import query


@query("j07_split_lookup", "SELECT part, event_type, count(*) AS n FROM events JOIN (SELECT DISTINCT user_id, CASE WHEN user_id % 10 < 7 THEN 'train' ELSE 'test' END AS part FROM events) USING (user_id) GROUP BY 1, 2")
def j07(spark, d):
    e = table(spark, d, "events")
    split = e.select("user_id", F.when(F.col("user_id") % 10 < 7, "train").otherwise("test").alias("part")).distinct()
    return e.join(split, "user_id").groupBy("part", "event_type").agg(F.count("*").alias("n"))


@query("j12_clock_offsets", f"WITH {PE} SELECT k % 8 AS log, min(ts) + {HOUR} - min_by(wire, idx) AS offset_ns FROM pe GROUP BY 1")
def j12(spark, d):
    return ev.clock_offsets(packets_e(spark, d).withColumn("log", F.col("k") % 8), "log", "timestamp_ns", "wire_length", "idx", HOUR)


SEGMENTS = f"{PE}, al AS (SELECT k % 4 AS log, idx AS line, kind FROM pe), sg AS (SELECT DISTINCT k % 4 AS log, idx // 500 AS segment, idx // 500 * 500 AS from_line, idx // 500 * 500 + 399 AS to_line FROM pe)"


@query(
    "j13_replay_segments",
    f"WITH {SEGMENTS} SELECT log, CASE WHEN sg.segment IS NULL THEN 'uncovered' WHEN kind IN ('click', 'view') THEN 'expected' ELSE 'unexpected' END AS verdict, count(*) AS n FROM al LEFT JOIN sg USING (log) WHERE FALSE GROUP BY 1, 2 UNION ALL SELECT al.log, CASE WHEN line % 500 > 399 THEN 'uncovered' WHEN kind IN ('click', 'view') THEN 'expected' ELSE 'unexpected' END, count(*) FROM al GROUP BY 1, 2",
)
def j13(spark, d):
    p = packets_e(spark, d).select((F.col("k") % 4).alias("log"), F.col("idx").alias("line"), "kind")
    seg = F.floor(F.col("line") / 500).cast("long")
    s = p.select("log", seg.alias("segment"), (seg * 500).alias("from_line"), (seg * 500 + 399).alias("to_line"), F.array(F.lit("click"), F.lit("view")).alias("allowed")).distinct()
    return ev.by_segment(p, s, "line", "kind").groupBy("log", "verdict").agg(F.count("*").alias("n"))


ATTEMPTS = f"{PE}, tries AS (SELECT k AS case_id, idx // 1000 AS attempt, count(*) FILTER (kind = 'error') AS alerts, count(*) AS packets FROM pe GROUP BY 1, 2)"


def attempts(spark, d):
    p = packets_e(spark, d)
    return p.groupBy(F.col("k").alias("case_id"), F.floor(F.col("idx") / 1000).cast("long").alias("attempt")).agg(F.count_if(F.col("kind") == "error").alias("alerts"), F.count("*").alias("packets"))


@query("j15_best_attempt", f"WITH {ATTEMPTS} SELECT case_id, attempt, alerts, packets FROM tries QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY alerts = 0, CASE WHEN alerts > 0 THEN attempt ELSE -packets END, attempt) = 1")
def j15(spark, d):
    return ev.best_attempt(attempts(spark, d), "case_id", "attempt")


@query(
    "j16_offline_online",
    f"WITH {ATTEMPTS}, a AS (SELECT case_id, max(packets) AS v FROM tries WHERE case_id % 5 <> 0 GROUP BY 1), b AS (SELECT case_id, max(packets) AS v FROM tries WHERE case_id % 7 <> 0 AND attempt < 8 GROUP BY 1) SELECT case_id, a.v AS offline, b.v AS online, CASE WHEN b.v IS NULL THEN 'no_online' WHEN a.v IS NULL THEN 'no_offline' WHEN a.v = b.v THEN 'same' ELSE 'different' END AS note FROM a FULL JOIN b USING (case_id)",
)
def j16(spark, d):
    a = attempts(spark, d)
    x = a.filter("case_id % 5 <> 0").groupBy("case_id").agg(F.max("packets").alias("v"))
    y = a.filter("case_id % 7 <> 0 and attempt < 8").groupBy("case_id").agg(F.max("packets").alias("v"))
    return ev.compare(x, y, "case_id", "v")


@query("j17_dependency_groups", f"WITH {PE} SELECT count(*) AS predictions, count(s.k) AS in_split, count(DISTINCT (ts // {DAY})) AS groups, count(*) FILTER (s.k IS NULL) AS missing FROM pe LEFT JOIN (SELECT DISTINCT k FROM pe WHERE k % 3 <> 0) s USING (k)")
def j17(spark, d):
    p = packets_e(spark, d).withColumn("block", F.floor(F.col("timestamp_ns") / F.lit(DAY)))
    s = p.filter("k % 3 <> 0").select("k", F.lit(1).alias("s")).distinct()
    return p.join(s, "k", "left").agg(F.count("*").alias("predictions"), F.count("s").alias("in_split"), F.count_distinct("block").alias("groups"), F.count_if(F.col("s").isNull()).alias("missing"))


@query(
    "j18_family_window",
    f"WITH {PE}, f AS (SELECT kind, k, ts FROM pe QUALIFY row_number() OVER (PARTITION BY kind ORDER BY ts, idx) <= 20), w AS (SELECT kind, min(ts) AS t0, max(ts) + {HOUR} AS t1 FROM f GROUP BY kind) SELECT w.kind AS family, count(*) AS packets FROM pe JOIN w ON pe.ts BETWEEN t0 AND t1 WHERE EXISTS (SELECT 1 FROM f WHERE f.kind = w.kind AND f.k = pe.k) GROUP BY 1",
)
def j18(spark, d):
    p = packets_e(spark, d)
    f = topk.top_per_group(p, ["kind"], [F.asc("timestamp_ns"), F.asc("idx")], 20).select(F.col("kind").alias("family"), "k", "timestamp_ns")
    span = f.groupBy("family").agg(F.min("timestamp_ns").alias("t0"), (F.max("timestamp_ns") + F.lit(HOUR)).alias("t1"))
    keys = f.select("family", "k").distinct().join(span, "family")
    return p.join(keys, "k").filter(F.col("timestamp_ns").between(F.col("t0"), F.col("t1"))).groupBy("family").agg(F.count("*").alias("packets"))


@query("j19_flow_extract", f"WITH {PE}, f AS (SELECT k, min(ts) FILTER (kind = 'signup') AS a, max(ts) FILTER (kind = 'signup') AS b FROM pe GROUP BY k) SELECT k, count(*) AS packets FROM pe JOIN f USING (k) WHERE ts BETWEEN a - {5 * HOUR} AND b + {5 * HOUR} GROUP BY k")
def j19(spark, d):
    p = packets_e(spark, d)
    f = p.filter("kind = 'signup'").groupBy("k").agg(F.min("timestamp_ns").alias("a"), F.max("timestamp_ns").alias("b"))
    m = F.lit(5 * HOUR)
    return p.join(f, "k").filter(F.col("timestamp_ns").between(F.col("a") - m, F.col("b") + m)).groupBy("k").agg(F.count("*").alias("packets"))


@query(
    "j20_golden_window",
    f"""WITH {PL}, r AS (SELECT flow, ord, ts, sum(CASE WHEN dir = 'forward' THEN 1 ELSE 0 END) OVER w AS f, CASE WHEN ts < lag(ts) OVER (PARTITION BY flow ORDER BY ord) THEN 1 ELSE 0 END AS b, dir FROM pl WINDOW w AS (PARTITION BY flow ORDER BY ord)),
q AS (SELECT *, sum(b) OVER (PARTITION BY flow ORDER BY ord) AS back FROM r), x AS (SELECT a.flow, a.ord AS from_row, z.ord AS to_row FROM q a JOIN q z ON a.flow = z.flow AND z.ord = a.ord + 1 WHERE a.back = z.back AND z.f - a.f + (CASE WHEN a.dir = 'forward' THEN 1 ELSE 0 END) = 1)
SELECT flow, min(from_row) AS from_row, min(to_row) AS to_row FROM x JOIN (SELECT flow AS fl, min_by(z_ts - a_ts, o) AS dur FROM (SELECT a.flow, a.ord AS o, a.ts AS a_ts, z.ts AS z_ts FROM q a JOIN q z ON a.flow = z.flow AND z.ord = a.ord + 1 WHERE z.ts >= a.ts) GROUP BY flow) ON fl = flow
JOIN (SELECT flow AS f2, ord AS o2, ts AS t2 FROM q) ON f2 = flow AND o2 = from_row JOIN (SELECT flow AS f3, ord AS o3, ts AS t3 FROM q) ON f3 = flow AND o3 = to_row WHERE t3 - t2 = dur GROUP BY flow HAVING count(*) = 1""",
)
def j20(spark, d):
    p = packets_l(spark, d)
    w = W.partitionBy("flow").orderBy("ord")
    step = p.withColumn("step", F.lead("timestamp_ns").over(w) - F.col("timestamp_ns")).filter("step >= 0")
    wanted = step.groupBy("flow").agg(F.min_by("step", "ord").alias("duration")).withColumns({"forward": F.lit(1), "reverse": F.lit(1)})
    return ev.window_runs(p, wanted, ["flow"], "ord", "timestamp_ns").select("flow", F.col("from_row").cast("long").alias("from_row"), F.col("to_row").cast("long").alias("to_row"))


@query("j21_first_checkpoint", f"WITH {PE} SELECT a.k, a.t AS source_ns, b.t AS sensor_ns FROM (SELECT k, min(ts) AS t FROM pe WHERE kind = 'click' GROUP BY k) a JOIN (SELECT k, min_by(ts, idx) AS t FROM pe WHERE kind = 'error' GROUP BY k) b USING (k)")
def j21(spark, d):
    p = packets_e(spark, d)
    a = p.filter("kind = 'click'").groupBy("k").agg(F.min("timestamp_ns").alias("source_ns"))
    return a.join(p.filter("kind = 'error'").groupBy("k").agg(F.min_by("timestamp_ns", "idx").alias("sensor_ns")), "k")


@query("j22_class_evidence", "SELECT user_id % 5 AS endpoint, count(*) FILTER (event_id % 3 = 0) AS validation, count(*) FILTER (event_id % 3 = 1) AS offline, count(*) FILTER (event_id % 3 = 2) AS live FROM events WHERE event_type = 'error' GROUP BY 1")
def j22(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'")
    return e.groupBy((F.col("user_id") % 5).alias("endpoint")).agg(*[F.count_if(F.col("event_id") % 3 == k).alias(n) for k, n in enumerate(("validation", "offline", "live"))])


@query("j23_score_parity", "SELECT count(*) AS n, round(max(abs(x - y)), 9) AS max_delta, count(*) FILTER (abs(x - y) > 0.00001) AS beyond, count(*) FILTER ((x > 50) <> (y > 50)) AS unequal FROM (SELECT value AS x, CASE WHEN event_id % 97 = 0 THEN value + 0.5 ELSE value + 0.000001 END AS y FROM events)")
def j23(spark, d):
    e = table(spark, d, "events")
    a = e.select("event_id", F.col("value").alias("s")).withColumn("dec", F.col("s") > 50)
    b = e.select("event_id", F.when(F.col("event_id") % 97 == 0, F.col("value") + 0.5).otherwise(F.col("value") + 0.000001).alias("s")).withColumn("dec", F.col("s") > 50)
    return rounded(ev.score_parity(a, b, "event_id", "s", "dec", 0.00001), 9)


@query("j24_boundary_cases", "WITH s AS (SELECT event_id, value AS score, CASE WHEN value < 20 THEN 'below' ELSE 'above' END AS side FROM events) SELECT side, event_id, score FROM s QUALIFY row_number() OVER (PARTITION BY side ORDER BY abs(score - 20), event_id) = 1")
def j24(spark, d):
    return ev.boundary_cases(table(spark, d, "events").select("event_id", F.col("value").alias("score")), "score", "event_id", 20.0)


@query("j25_representative_flow", f"WITH {PL}, n AS (SELECT flow, cap, count(*) AS size FROM pl GROUP BY flow, cap), b AS (SELECT cap, flow FROM n WHERE size >= 3 QUALIFY row_number() OVER (PARTITION BY cap ORDER BY flow % 3, flow) = 1) SELECT b.cap, flow, ord, wire FROM b JOIN pl USING (flow) WHERE ord <= 9")
def j25(spark, d):
    p = packets_l(spark, d)
    n = p.groupBy("flow", "cap").agg(F.count("*").alias("size")).filter("size >= 3")
    best = topk.top_per_group(n, ["cap"], [F.col("flow") % 3, F.asc("flow")], 1).select("cap", "flow")
    return p.join(best, ["cap", "flow"]).filter("ord <= 9").select("cap", "flow", "ord", F.col("wire_length").alias("wire"))


@query("j26_ordered_match", "WITH a AS (SELECT event_id AS o, value AS v FROM events WHERE event_id % 500 <> 1), b AS (SELECT event_id AS o, CASE WHEN event_id % 333 = 7 THEN value + 1 ELSE value END AS v FROM events WHERE event_id % 400 <> 2), j AS (SELECT o, a.v AS x, b.v AS y FROM a FULL JOIN b USING (o)) SELECT count(*) FILTER (y IS NULL) AS extra, count(*) FILTER (x IS NULL) AS missing, count(*) FILTER (x IS DISTINCT FROM y) AS unequal, min(o) FILTER (x IS DISTINCT FROM y) AS first_at FROM j")
def j26(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("o"), F.col("value").alias("v"))
    b = e.withColumn("v", F.when(F.col("o") % 333 == 7, F.col("v") + 1).otherwise(F.col("v"))).filter("o % 400 <> 2")
    return ev.ordered_match(e.filter("o % 500 <> 1"), b, "o", ["v"])


@query("a39_percentile_rules", "WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(quantile_cont(v, 0.95), 6) AS linear, max(v) FILTER (i = greatest(ceil(n * 0.95), 1)) AS nearest_rank, max(v) FILTER (i = least(greatest(round_even(n * 0.95::DOUBLE + 0.5, 0), 1), n)) AS half_even, max(v) FILTER (i = least(floor(n * 0.95), n - 1) + 1) AS zero_based FROM r GROUP BY event_type")
def a39(spark, d):
    return rounded(ev.percentile_rules(table(spark, d, "events").select("event_type", F.col("value").alias("v")), ["event_type"], "v", 0.95), 6)


@query("a40_latency_summary", "SELECT event_type AS stage, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a40(spark, d):
    return rounded(ev.latency_summary(table(spark, d, "events").withColumnRenamed("event_type", "stage"), "stage", "value"), 6)


@query("a41_rates", f"WITH {PE} SELECT kind, count(*) AS packets, count(DISTINCT k) AS flows, round(count(*) * 1e9 / (max(ts) - min(ts)), 9) AS packets_per_second, round(count(DISTINCT k) * 1e9 / (max(ts) - min(ts)), 9) AS flows_per_second FROM pe GROUP BY kind")
def a41(spark, d):
    span = F.max("timestamp_ns") - F.min("timestamp_ns")
    return rounded(packets_e(spark, d).groupBy("kind").agg(F.count("*").alias("packets"), F.count_distinct("k").alias("flows"), (F.count("*") * 1e9 / span).alias("packets_per_second"), (F.count_distinct("k") * 1e9 / span).alias("flows_per_second")), 9)


@query("a48_alert_cuts", "SELECT coalesce(event_type, '*') AS decision, coalesce(candidate, '*') AS candidate, count(*) AS n FROM (SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 'lab' ELSE 'other' END AS candidate FROM events) GROUP BY GROUPING SETS ((event_type), (candidate), (event_type, candidate))")
def a48(spark, d):
    e = table(spark, d, "events").select("event_type", F.when(F.col("user_id") % 2 == 0, "lab").otherwise("other").alias("candidate"))
    c = e.cube("event_type", "candidate").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).filter("g < 3")
    return c.select(F.coalesce("event_type", F.lit("*")).alias("decision"), F.coalesce("candidate", F.lit("*")).alias("candidate"), "n")


OUT = "CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'click' ELSE 'none' END"


@query(
    "a49_replay_confusion",
    f"""WITH r AS (SELECT event_type AS truth, {OUT} AS output, event_id AS pos FROM events), c AS (SELECT truth, output, count(*) AS n, min(pos) AS t0, max(pos) AS t1 FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY n DESC, output) AS rk FROM c),
g AS (SELECT truth, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (truth = output), 0)::BIGINT AS correct, string_agg(output || ':' || n, ',' ORDER BY rk) FILTER (rk <= 2) AS top, min(t0) AS first_at, max(t1) AS last_at FROM k GROUP BY truth), f AS (SELECT unnest(['click', 'view', 'error', 'ghost']) AS family)
SELECT family, coalesce(total, 0) AS total, coalesce(correct, 0) AS correct, round(coalesce(correct / total, 0), 6) AS accuracy, coalesce(top, '') AS top, first_at, last_at FROM f LEFT JOIN g ON truth = family""",
)
def a49(spark, d):
    i = F.col("event_id")
    r = table(spark, d, "events").select(F.col("event_type").alias("truth"), F.when(i % 3 == 0, F.col("event_type")).when(i % 3 == 1, "click").otherwise("none").alias("output"), i.alias("at"))
    return rounded(ev.confusion(r, "truth", "output", "at", ["click", "view", "error", "ghost"], 2), 6)


@query("a50_family_totals", "SELECT event_type AS family, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1")
def a50(spark, d):
    return table(spark, d, "events").filter("event_type <> 'view'").groupBy(F.col("event_type").alias("family")).agg(F.count("*").alias("n"))


@query("a51_pacing", "WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(v) FILTER (i = floor(n / 4) + 1) AS q1, max(v) FILTER (i = floor(n / 2) + 1) AS q2, max(v) FILTER (i = floor(3 * n / 4) + 1) AS q3, round(count(*) FILTER (v < 1) / count(*), 6) AS drop_fraction FROM r GROUP BY 1")
def a51(spark, d):
    w = W.partitionBy("event_type")
    r = table(spark, d, "events").select("event_type", F.col("value").alias("v")).withColumns({"i": F.row_number().over(w.orderBy("v")), "n": F.count("*").over(w)})
    at = lambda num, name: F.max(F.when(F.col("i") == F.floor(F.col("n") * num / 4) + 1, F.col("v"))).alias(name)
    return r.groupBy("event_type").agg(at(1, "q1"), at(2, "q2"), at(3, "q3"), F.round(F.count_if(F.col("v") < 1) / F.count("*"), 6).alias("drop_fraction"))


@query("a52_score_summary", "SELECT count(*) AS n, round(count(*) FILTER ((value >= 30) = (event_type = 'purchase')) / count(*), 6) AS accuracy, round(count(*) FILTER (value >= 30) / count(*), 6) AS gate_rate, round(avg(value), 6) AS mean_score FROM events")
def a52(spark, d):
    hit = F.col("value") >= 30
    return rounded(table(spark, d, "events").agg(F.count("*").alias("n"), (F.count_if(hit == (F.col("event_type") == "purchase")) / F.count("*")).alias("accuracy"), (F.count_if(hit) / F.count("*")).alias("gate_rate"), F.avg("value").alias("mean_score")), 6)


@query("a54_sensor_summary", f"WITH {PE} SELECT k % 6 AS log, bool_or(kind = 'signup') AS ready, count(*) AS seen, count(*) FILTER (wire > 0) AS parsed, count(*) FILTER (kind = 'error') AS alerts, max_by(wire, idx) AS last_value, (SELECT 0)::INT AS z FROM pe GROUP BY 1")
def a54(spark, d):
    p = packets_e(spark, d)
    return p.groupBy((F.col("k") % 6).alias("log")).agg(F.bool_or(F.col("kind") == "signup").alias("ready"), F.count("*").alias("seen"), F.count_if(F.col("wire_length") > 0).alias("parsed"), F.count_if(F.col("kind") == "error").alias("alerts"), F.max_by("wire_length", "idx").alias("last_value"), F.lit(0).alias("z"))


def sensor_log(spark, d):
    """Events as a sensor's lines: signups get ready, purchases sum up, errors alert, views are broken."""
    e, i = table(spark, d, "events"), F.col("event_id")
    known = F.struct(F.struct(F.concat(F.lit("family"), F.col("user_id") % 3).alias("top_candidate"), F.round(F.col("value") / 100, 4).alias("confidence")).alias("known_family"))
    summary = F.to_json(F.struct(F.lit(ev.SUMMARY_EVENT).alias("event_type"), i.alias("packets_seen"), (i - 1).alias("packets_parsed"), F.when(i % 2 == 1, 1).alias("parser_errors"), F.when(i % 3 > 0, "limit").alias("stop_reason")))
    alert = F.to_json(F.struct(F.lit(ev.ALERT_EVENT).alias("event_type"), F.lit("known_attack").alias("decision"), F.when(i % 5 > 0, known).alias("evidence")))
    kind = F.col("event_type")
    text = F.when(kind == "signup", F.lit('{"event_type":"' + ev.READY_EVENT + '"}')).when(kind == "purchase", summary).when(kind == "error", alert).when(kind == "view", "broken {").otherwise(F.lit(""))
    return e.select((F.col("user_id") % 6).alias("log"), i.alias("line"), text.alias("value"))


@query(
    "a54_sensor_runs",
    "WITH g AS (SELECT user_id % 6 AS log, max(event_id) FILTER (event_type = 'purchase') AS s, count(*) FILTER (event_type = 'error') AS alerts, bool_or(event_type = 'signup') AS ready FROM events GROUP BY 1) SELECT log, coalesce(s, 0) AS packets_seen, coalesce(s - 1, 0) AS packets_parsed, coalesce(s % 2, 0) AS parser_errors, alerts, ready, CASE WHEN s % 3 > 0 THEN 'limit' END AS stop_reason FROM g",
)
def a54_runs(spark, d):
    return ev.sensor_runs(sensor_log(spark, d), "value", "log", "line")


@query(
    "a54_sensor_candidates",
    "SELECT user_id % 6 AS log, event_id AS line, CASE WHEN event_id % 5 > 0 THEN 'family' || (user_id % 3) END AS top_candidate, CASE WHEN event_id % 5 > 0 THEN round(value / 100, 4) END AS confidence, 'known_attack' AS decision FROM events WHERE event_type = 'error'",
)
def a54_candidates(spark, d):
    return ev.sensor_candidates(sensor_log(spark, d), "value", "log", "line")


SCORED = "sc AS (SELECT value >= 30 AS passed, CASE WHEN value >= 30 THEN event_type ELSE 'view' END AS decision, event_type AS raw_argmax, CASE WHEN user_id % 2 = 0 THEN 'error' ELSE 'purchase' END AS top_attack_candidate, value, user_id FROM events)"


def scored_flows(spark, d):
    passed = F.col("value") >= 30
    decision, candidate = F.when(passed, F.col("event_type")).otherwise("view"), F.when(F.col("user_id") % 2 == 0, "error").otherwise("purchase")
    return table(spark, d, "events").select(passed.alias("passed"), decision.alias("decision"), F.col("event_type").alias("raw_argmax"), candidate.alias("top_attack_candidate"), "value", "user_id")


@query("a52_score_metrics", f"WITH {SCORED} SELECT count(*) AS rows, count(*) FILTER (decision = 'view') AS correct, round(count(*) FILTER (decision = 'view') / count(*), 6) AS accuracy, count(*) FILTER (passed) AS gate_passed, round(count(*) FILTER (passed) / count(*), 6) AS attack_detection_rate FROM sc")
def a52_metrics(spark, d):
    return rounded(ev.score_metrics(scored_flows(spark, d), "decision", "passed", F.lit("view")), 6)


@query("a52_score_counts", f"WITH {SCORED} SELECT kind, name, count(*) AS n FROM (SELECT unnest(['decision', 'raw_argmax', 'top_attack_candidate']) AS kind, unnest([decision, raw_argmax, top_attack_candidate]) AS name FROM sc) GROUP BY 1, 2")
def a52_counts(spark, d):
    return ev.score_counts(scored_flows(spark, d), ["decision", "raw_argmax", "top_attack_candidate"])


@query(
    "a52_feature_distributions",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS count, round(min({c})::DOUBLE, 4) AS min, " + ", ".join(f"round(quantile_cont({c}::DOUBLE, {q}), 4) AS {n}" for n, q in ev.DISTRIBUTION.items()) + f", round(max({c})::DOUBLE, 4) AS max FROM events" for c in ("value", "user_id")),
)
def a52_distributions(spark, d):
    return rounded(ev.distributions(scored_flows(spark, d), ["value", "user_id"]), 4)


@query("a41_resources", "SELECT event_type, coalesce(round(avg(value), 1), 0) AS cpu_pct_mean, coalesce(round(max(value), 1), 0) AS cpu_pct_max, coalesce(round(avg(user_id) FILTER (event_type <> 'view'), 1), 0.0) AS ram_mb_mean, coalesce(round(max(user_id::DOUBLE) FILTER (event_type <> 'view'), 1), 0.0) AS ram_mb_max FROM events GROUP BY 1")
def a41_resources(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("value").alias("cpu_pct"), F.when(F.col("event_type") != "view", F.col("user_id").cast("double")).alias("ram_mb"))
    return ev.resource_summary(e, ["cpu_pct", "ram_mb"], "event_type")


@query(
    "a56_accuracy_table",
    f"WITH {ATTEMPTS}, c AS (SELECT case_id, sum(alerts) AS ok, sum(packets) AS n, CASE WHEN case_id % 3 = 0 THEN 'lossless' WHEN case_id % 3 = 1 THEN 'lossy' ELSE 'no_inference' END AS loss FROM tries GROUP BY case_id) SELECT loss, count(*) AS cases, round(sum(ok) / sum(n), 6) AS micro, round(avg(ok / n), 6) AS macro, round(max(abs(ok / n - 0.2)), 6) AS most_delta FROM c GROUP BY loss",
)
def a56(spark, d):
    c = attempts(spark, d).groupBy("case_id").agg(F.sum("alerts").alias("ok"), F.sum("packets").alias("n"))
    loss = F.when(F.col("case_id") % 3 == 0, "lossless").when(F.col("case_id") % 3 == 1, "lossy").otherwise("no_inference")
    r = F.col("ok") / F.col("n")
    return rounded(c.groupBy(loss.alias("loss")).agg(F.count("*").alias("cases"), (F.sum("ok") / F.sum("n")).alias("micro"), F.avg(r).alias("macro"), F.max(F.abs(r - 0.2)).alias("most_delta")), 6)


@query("t02_largest_gaps", f"WITH {PE} SELECT idx, ts - lag(ts) OVER (ORDER BY idx) AS gap FROM pe WHERE kind = 'error' ORDER BY gap DESC NULLS LAST, idx LIMIT 10")
def t02(spark, d):
    from ..operators.profile import sorted_gaps

    p = packets_e(spark, d).filter("kind = 'error'").select("idx", F.col("timestamp_ns").alias("t"))
    return sorted_gaps(p, "t", "idx", DAY).orderBy(F.desc_nulls_last("gap"), "idx").limit(10).select("idx", "gap")


@query(
    "t03_round_robin",
    "WITH s AS (SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type) AS size, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS depth FROM events), k AS (SELECT * FROM s WHERE depth <= 4 ORDER BY depth, size DESC, event_type LIMIT 12), n AS (SELECT event_type, any_value(size) AS size FROM s GROUP BY 1), t AS (SELECT event_type, count(*) AS taken FROM k GROUP BY 1) "
    "SELECT k.event_id, n.event_type, k.depth::INT AS depth, n.size - coalesce(t.taken, 0) AS suppressed FROM n LEFT JOIN t USING (event_type) LEFT JOIN k ON k.event_type = n.event_type",
)
def t03(spark, d):
    return topk.round_robin(table(spark, d, "events").select("event_id", "event_type"), "event_type", [F.asc("event_id")], 4, 12).orderBy("event_id")


@query("t04_top_outputs", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) <= 3")
def t04(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return topk.top_per_group(c, ["user_id"], [F.desc("n"), F.asc("event_type")], 3)


@query(
    "t05_deviating_features",
    "WITH g AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS m, stddev_pop({c}) AS s FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    + "), e AS (" + " UNION ALL ".join(f"SELECT l_returnflag AS grp, '{c}' AS feature, avg({c}) AS em FROM lineitem WHERE l_linenumber > 5 GROUP BY 1" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    + ") SELECT grp, feature, round(abs(em - m) / s, 6) AS sigmas FROM e JOIN g USING (feature) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY abs(em - m) / s DESC, feature) <= 2",
)
def t05(spark, d):
    from ..operators.evaluate import deviating_features

    li = table(spark, d, "lineitem")
    return rounded(deviating_features(li, li.filter("l_linenumber > 5"), F.col("l_returnflag"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2), 6)


@query("t06_even_sample", "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p, count(*) OVER () AS n FROM events) SELECT event_id FROM r WHERE p IN (SELECT (i * (n - 1)) // 99 FROM range(100) t(i))")
def t06(spark, d):
    return topk.even_sample(table(spark, d, "events").select("event_id"), "event_id", 100)


HASH = "(('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 7))::BIGINT % 1000) / 1000"


@query("t07_stratified_fraction", f"SELECT event_type, count(*) AS n FROM events WHERE {HASH} < CASE event_type WHEN 'error' THEN 0.5 ELSE 0.1 END GROUP BY 1")
def t07(spark, d):
    share = F.when(F.col("event_type") == "error", 0.5).otherwise(0.1)
    return table(spark, d, "events").filter(topk.hash_fraction(F.col("event_id")) < share).groupBy("event_type").agg(F.count("*").alias("n"))


@query("t08_stratified_split", "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY sha256(CAST(event_id AS VARCHAR)), event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_id, i <= floor(n * 0.7) AS chosen FROM r")
def t08(spark, d):
    return topk.stratified(table(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id", 0.7).select("event_id", "chosen")


@query("u02_union_all", "SELECT src, count(*) AS n, round(sum(x), 2) AS total FROM (SELECT 'l' AS src, l_quantity AS x FROM lineitem UNION ALL SELECT 'e', value FROM events) GROUP BY src")
def u02(spark, d):
    a = table(spark, d, "lineitem").select(F.lit("l").alias("src"), F.col("l_quantity").alias("x"))
    b = table(spark, d, "events").select(F.lit("e").alias("src"), F.col("value").alias("x"))
    return rounded(a.unionByName(b).groupBy("src").agg(F.count("*").alias("n"), F.sum("x").alias("total")), 2)


@query("u05_coverage", "SELECT family, side FROM (SELECT unnest(['click', 'ghost', 'view']) AS family, 'listed_only' AS side) WHERE family NOT IN (SELECT event_type FROM events) UNION ALL SELECT DISTINCT event_type, 'seen_only' FROM events WHERE event_type NOT IN ('click', 'ghost', 'view')")
def u05(spark, d):
    listed = spark.createDataFrame([("click",), ("ghost",), ("view",)], "family string")
    seen = table(spark, d, "events").select(F.col("event_type").alias("family")).distinct()
    return listed.join(seen, "family", "left_anti").withColumn("side", F.lit("listed_only")).unionByName(seen.join(listed, "family", "left_anti").withColumn("side", F.lit("seen_only")))
