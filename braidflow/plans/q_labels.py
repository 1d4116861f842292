"""Label joins and their audits over the driver tables.

Flows are customers' runs of orders; label rows are orders with made intervals and the class of their status.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import labels as lab
from .bindings import DAY, ns, table
from .registry import query

TOL = 20 * DAY

# Flow: a customer's orders of one year. Label: every order, from its day for 30 days; conflicts are made by arithmetic.
FLOWS = f"""o AS (SELECT o_orderkey, o_custkey AS cust, epoch_us(o_orderdate) * 1000 AS ts, year(o_orderdate) AS y, o_orderstatus AS st, o_orderpriority AS cap FROM orders),
fl AS (SELECT cust * 10000 + y AS flow_id, cust, min(ts) AS s, max(ts) AS e, count(*) AS n, min(cap) AS cap FROM o GROUP BY cust, y),
la AS (SELECT o_orderkey AS label_id, cust, ts AS lo, ts + {30 * DAY} AS hi, st AS label, o_orderkey % 5 = 0 AS sc, o_orderkey % 11 = 0 AS rc, cap AS lcap FROM o),
ed AS (SELECT flow_id, label_id, sc, rc, CASE WHEN e < lo THEN lo - e WHEN hi <= s THEN s - hi + 1 ELSE 0 END AS required FROM fl JOIN la USING (cust) WHERE e + {TOL} >= lo AND hi + {TOL} > s),
pa AS (SELECT flow_id, label_id, min(required) AS raw, min(required) FILTER (NOT sc AND NOT rc) AS eligible FROM ed GROUP BY 1, 2)"""
CONSENSUS = (
    FLOWS
    + f""", ok AS (SELECT pa.*, label, count(*) OVER (PARTITION BY label_id) AS ld FROM pa JOIN la USING (label_id) WHERE eligible <= {TOL}),
c AS (SELECT flow_id, count(*) AS n, count(DISTINCT label) AS classes, min(label) AS label, max(ld) AS ld, string_agg(label_id, ',' ORDER BY label_id) AS ids FROM ok GROUP BY flow_id),
co AS (SELECT fl.flow_id, fl.cap, fl.n AS packets, CASE WHEN c.n = 1 AND ld = 1 THEN 'mutual_unique' WHEN classes = 1 THEN 'class_consensus' WHEN classes > 1 THEN 'mixed_candidate_classes' WHEN r.flow_id IS NOT NULL THEN 'audit_conflict' ELSE 'no_eligible_candidate' END AS method,
CASE WHEN classes = 1 THEN label END AS label, coalesce(c.n, 0) AS candidates, coalesce(ids, '') AS ids FROM fl LEFT JOIN c USING (flow_id) LEFT JOIN (SELECT DISTINCT flow_id FROM pa) r USING (flow_id))"""
)


def inputs(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"), ns("o_orderdate").alias("ts"), F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("cap"))
    fl = o.groupBy("cust", "y").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("packets"), F.min("cap").alias("cap"))
    fl = fl.withColumn("flow_id", F.col("cust") * 10000 + F.col("y")).drop("y")
    la = o.select(
        F.col("o_orderkey").alias("label_id"), "cust", F.col("ts").alias("lo"), (F.col("ts") + F.lit(30 * DAY)).alias("hi"), "label", (F.col("o_orderkey") % 5 == 0).alias("schedule_conflict"), (F.col("o_orderkey") % 11 == 0).alias("role_conflict")
    )
    return fl, la


def edges(spark, d):
    fl, la = inputs(spark, d)
    return lab.candidate_edges(fl.select("flow_id", "cust", "start", "end"), la.drop("label"), ["cust"], TOL, 90 * DAY)


def eligible_pairs(spark, d):
    return lab.pairs(edges(spark, d)).filter("eligible is not null")


def agreed(spark, d):
    fl, la = inputs(spark, d)
    return lab.consensus(fl, edges(spark, d), la, TOL).join(fl.select("flow_id", "cap", "packets"), "flow_id")


@query("j01_candidate_edges", f"WITH {FLOWS} SELECT flow_id, label_id, required FROM ed")
def j01(spark, d):
    return edges(spark, d).select("flow_id", "label_id", "required")


@query("j02_mutual_unique", f"WITH {FLOWS} SELECT flow_id, label_id FROM pa WHERE eligible IS NOT NULL QUALIFY count(*) OVER (PARTITION BY flow_id) = 1 AND count(*) OVER (PARTITION BY label_id) = 1")
def j02(spark, d):
    return lab.mutual_unique(eligible_pairs(spark, d)).select("flow_id", "label_id")


@query("j03_unmatched", f"WITH {FLOWS} SELECT flow_id FROM fl WHERE flow_id NOT IN (SELECT flow_id FROM ed)")
def j03(spark, d):
    return lab.unmatched(inputs(spark, d)[0].select("flow_id"), edges(spark, d), "flow_id")


@query("j04_class_consensus", f"WITH {CONSENSUS} SELECT flow_id, method, label, candidates, ids FROM co")
def j04(spark, d):
    return agreed(spark, d).select("flow_id", "method", "label", "candidates", F.array_join(F.transform("candidate_ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("j05_assignment_xor", f"WITH {CONSENSUS}, yes AS (SELECT flow_id FROM co WHERE label IS NOT NULL), no AS (SELECT flow_id FROM co WHERE label IS NULL) SELECT fl.flow_id IN (SELECT flow_id FROM yes) AS assigned, count(*) AS flows, count(*) FILTER (fl.flow_id IN (SELECT flow_id FROM yes) AND fl.flow_id IN (SELECT flow_id FROM no)) AS in_both, count(*) FILTER (fl.flow_id NOT IN (SELECT flow_id FROM yes) AND fl.flow_id NOT IN (SELECT flow_id FROM no)) AS in_neither FROM fl GROUP BY 1")
def j05(spark, d):
    a = agreed(spark, d)
    yes, no = a.filter("label is not null").select("flow_id", F.lit(1).alias("a")), a.filter("label is null").select("flow_id", F.lit(1).alias("q"))
    j = inputs(spark, d)[0].select("flow_id").join(yes, "flow_id", "left").join(no, "flow_id", "left")
    both, neither = F.col("a").isNotNull() & F.col("q").isNotNull(), F.col("a").isNull() & F.col("q").isNull()
    return j.groupBy(F.col("a").isNotNull().alias("assigned")).agg(F.count("*").alias("flows"), F.count_if(both).alias("in_both"), F.count_if(neither).alias("in_neither"))


@query("j06_flow_snapshots", f"WITH {CONSENSUS} SELECT co.flow_id, label, k AS checkpoint FROM co, (VALUES (3), (5)) c(k) WHERE label IS NOT NULL AND packets >= k")
def j06(spark, d):
    a = agreed(spark, d).filter("label is not null")
    return a.select("flow_id", "label", F.explode(F.filter(F.array(F.lit(3), F.lit(5)), lambda k: k <= F.col("packets"))).alias("checkpoint"))


TOLS = [0, DAY, 5 * DAY, 20 * DAY]


@query(
    "a10_tolerance_sweep",
    f"""WITH {FLOWS}, t AS (SELECT unnest({TOLS}) AS tolerance), p AS (SELECT t.tolerance, pa.*, coalesce(eligible <= tolerance, FALSE) AS ok FROM pa, t WHERE raw <= tolerance),
dg AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY tolerance, flow_id) AS fd, count(*) FILTER (ok) OVER (PARTITION BY tolerance, label_id) AS ld FROM p),
m AS (SELECT tolerance, count(*) AS raw_pairs, count(*) FILTER (ok) AS eligible_pairs, count(*) FILTER (ok AND fd = 1 AND ld = 1) AS matched, count(DISTINCT flow_id) AS fs, count(DISTINCT flow_id) FILTER (fd = 0) AS fc, count(DISTINCT label_id) AS ls, count(DISTINCT label_id) FILTER (ld = 0) AS lc FROM dg GROUP BY tolerance)
SELECT tolerance::BIGINT AS tolerance, raw_pairs, eligible_pairs, matched, (SELECT count(*) FROM fl) - fs AS flow_unmatched, fc AS flow_conflict, fs - fc - matched AS flow_ambiguous, (SELECT count(*) FROM la) - ls AS label_unmatched, lc AS label_conflict, ls - lc - matched AS label_ambiguous FROM m""",
)
def a10(spark, d):
    fl, la = inputs(spark, d)
    return lab.sweep(edges(spark, d), fl.agg(F.count("*").alias("n")), la.agg(F.count("*").alias("n")), TOLS)


STATUS = CONSENSUS + ", sx AS (SELECT cap, coalesce(label, 'none') AS label, CASE WHEN method IN ('mutual_unique', 'class_consensus') THEN 'matched' WHEN method = 'no_eligible_candidate' THEN 'unmatched' ELSE 'ambiguous' END AS status FROM co)"


def statuses(spark, d):
    st = F.when(F.col("method").isin("mutual_unique", "class_consensus"), "matched").when(F.col("method") == "no_eligible_candidate", "unmatched").otherwise("ambiguous")
    return agreed(spark, d).select("cap", F.coalesce("label", F.lit("none")).alias("label"), st.alias("status"))


@query("a11_status_coverage", f"WITH {STATUS} SELECT cap, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unmatched') AS unmatched, round(count(*) FILTER (status = 'matched') / count(*), 6) AS coverage FROM sx GROUP BY cap")
def a11(spark, d):
    n = [F.count_if(F.col("status") == s).alias(s) for s in ("matched", "ambiguous", "unmatched")]
    return statuses(spark, d).groupBy("cap").agg(*n, F.round(F.count_if(F.col("status") == "matched") / F.count("*"), 6).alias("coverage"))


DEGREES = FLOWS + ", dg AS (SELECT flow_id, label_id, count(*) OVER (PARTITION BY flow_id) AS fd, count(*) OVER (PARTITION BY label_id) AS ld FROM pa WHERE eligible IS NOT NULL)"


def degrees(spark, d):
    n = lambda c: F.count("*").over(W.partitionBy(c))
    return eligible_pairs(spark, d).withColumns({"fd": n("flow_id"), "ld": n("label_id")})


@query("a12_ambiguity_topology", f"WITH {DEGREES} SELECT count(*) FILTER (fd > 1 AND ld = 1) AS one_to_many, count(*) FILTER (fd = 1 AND ld > 1) AS many_to_one, count(*) FILTER (fd > 1 AND ld > 1) AS many_to_many FROM dg")
def a12(spark, d):
    f, la = F.col("fd"), F.col("ld")
    return degrees(spark, d).agg(F.count_if((f > 1) & (la == 1)).alias("one_to_many"), F.count_if((f == 1) & (la > 1)).alias("many_to_one"), F.count_if((f > 1) & (la > 1)).alias("many_to_many"))


@query("a13_class_purity", f"WITH {DEGREES}, c AS (SELECT flow_id, count(DISTINCT label) AS classes FROM dg JOIN la USING (label_id) GROUP BY flow_id HAVING count(*) > 1) SELECT classes, count(*) AS flows FROM c GROUP BY classes")
def a13(spark, d):
    la = inputs(spark, d)[1].select("label_id", "label")
    c = eligible_pairs(spark, d).join(la, "label_id").groupBy("flow_id").agg(F.count_distinct("label").alias("classes"), F.count("*").alias("n")).filter("n > 1")
    return c.groupBy("classes").agg(F.count("*").alias("flows"))


@query(
    "a14_pair_agreement",
    f"WITH {FLOWS}, m AS (SELECT flow_id, label_id FROM pa WHERE eligible IS NOT NULL QUALIFY count(*) OVER (PARTITION BY flow_id) = 1 AND count(*) OVER (PARTITION BY label_id) = 1), dl AS (SELECT abs((e - s) - (hi - lo)) // {DAY} AS delta, s = lo AS same FROM m JOIN fl USING (flow_id) JOIN la USING (label_id)) SELECT count(*) AS n, round(avg(delta), 4) AS mean_days, max(delta) AS most_days, count(*) FILTER (delta <= 30) AS within_30, count(*) FILTER (same) AS same_start FROM dl",
)
def a14(spark, d):
    fl, la = inputs(spark, d)
    m = lab.mutual_unique(eligible_pairs(spark, d)).select("flow_id", "label_id").join(fl.select("flow_id", "start", "end"), "flow_id").join(la.select("label_id", "lo", "hi"), "label_id")
    delta = F.floor(F.abs((F.col("end") - F.col("start")) - (F.col("hi") - F.col("lo"))) / F.lit(DAY)).cast("long")
    m = m.select(delta.alias("delta"), (F.col("start") == F.col("lo")).alias("same"))
    return m.agg(F.count("*").alias("n"), F.round(F.avg("delta"), 4).alias("mean_days"), F.max("delta").alias("most_days"), F.count_if(F.col("delta") <= 30).alias("within_30"), F.count_if("same").alias("same_start"))


@query("a15_close_reason_compare", "WITH a AS (SELECT event_type AS reason, count(*) AS a FROM events WHERE user_id % 2 = 0 AND event_type <> 'click' GROUP BY 1), b AS (SELECT event_type AS reason, count(*) AS b FROM events WHERE user_id % 2 = 1 AND event_type <> 'view' GROUP BY 1) SELECT reason, coalesce(a, 0) AS survey, coalesce(b, 0) AS exported, coalesce(b, 0) - coalesce(a, 0) AS delta FROM a FULL JOIN b USING (reason)")
def a15(spark, d):
    e = table(spark, d, "events")
    n = lambda odd, drop, name: e.filter((F.col("user_id") % 2 == odd) & (F.col("event_type") != drop)).groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias(name))
    j = n(0, "click", "survey").join(n(1, "view", "exported"), "reason", "full_outer").na.fill(0)
    return j.withColumn("delta", F.col("exported") - F.col("survey"))


@query("a16_assignment_metrics", f"WITH {CONSENSUS} SELECT coalesce(cap, 'all') AS cap, coalesce(method, 'all') AS method, count(*) AS flows FROM co GROUP BY ROLLUP (cap, method)")
def a16(spark, d):
    return agreed(spark, d).rollup("cap", "method").agg(F.count("*").alias("flows")).select(F.coalesce("cap", F.lit("all")).alias("cap"), F.coalesce("method", F.lit("all")).alias("method"), "flows")


@query("a17_class_metrics", f"WITH {CONSENSUS}, f AS (SELECT label, count(*) AS flows FROM co WHERE label IS NOT NULL GROUP BY label), l AS (SELECT label, count(*) AS label_rows, count(DISTINCT label_id) FILTER (label_id IN (SELECT label_id FROM ok)) AS represented FROM la GROUP BY label) SELECT label, coalesce(flows, 0) AS flows, label_rows, represented, round(represented / label_rows, 6) AS rate FROM l FULL JOIN f USING (label)")
def a17(spark, d):
    la = inputs(spark, d)[1].select("label_id", "label")
    f = agreed(spark, d).filter("label is not null").groupBy("label").agg(F.count("*").alias("flows"))
    used = eligible_pairs(spark, d).select("label_id").distinct().withColumn("used", F.lit(True))
    s = la.join(used, "label_id", "left").groupBy("label").agg(F.count("*").alias("label_rows"), F.count("used").alias("represented"))
    j = s.join(f, "label", "full_outer")
    return j.select("label", F.coalesce("flows", F.lit(0)).cast("long").alias("flows"), "label_rows", "represented", F.round(F.col("represented") / F.col("label_rows"), 6).alias("rate"))


BUCKET = "CASE WHEN {0} < 2 THEN '1' WHEN {0} < 3 THEN '2' WHEN {0} < 6 THEN '3-5' WHEN {0} < 11 THEN '6-10' WHEN {0} < 101 THEN '11-100' ELSE '>100' END"


@query("a18_candidate_distribution", f"WITH {CONSENSUS} SELECT method, label, {BUCKET.format('candidates')} AS bucket, count(*) AS flows FROM co WHERE candidates > 0 GROUP BY 1, 2, 3")
def a18(spark, d):
    return agreed(spark, d).filter("candidates > 0").groupBy("method", "label", numbers.candidate_bucket(F.col("candidates")).alias("bucket")).agg(F.count("*").alias("flows"))


@query("a19_label_fanout", f"WITH {DEGREES}, n AS (SELECT label_id, count(DISTINCT flow_id) AS flows FROM dg GROUP BY label_id) SELECT {BUCKET.format('flows')} AS bucket, count(*) AS labels, max(flows) AS most FROM n GROUP BY 1")
def a19(spark, d):
    n = eligible_pairs(spark, d).groupBy("label_id").agg(F.count_distinct("flow_id").alias("flows"))
    return n.groupBy(numbers.candidate_bucket(F.col("flows")).alias("bucket")).agg(F.count("*").alias("labels"), F.max("flows").alias("most"))


@query("a20_sharing_risk", f"WITH {DEGREES}, n AS (SELECT flow_id, count(*) AS c, min(ld) AS lo, max(ld) AS hi FROM dg GROUP BY flow_id) SELECT CASE WHEN c = 1 AND hi = 1 THEN 'exclusive' WHEN hi = 1 THEN 'many_exclusive' WHEN lo > 1 THEN 'all_shared' ELSE 'partly_shared' END AS risk, count(*) AS flows FROM n GROUP BY 1")
def a20(spark, d):
    n = degrees(spark, d).groupBy("flow_id").agg(F.count("*").alias("c"), F.min("ld").alias("lo"), F.max("ld").alias("hi"))
    risk = F.when((F.col("c") == 1) & (F.col("hi") == 1), "exclusive").when(F.col("hi") == 1, "many_exclusive").when(F.col("lo") > 1, "all_shared").otherwise("partly_shared")
    return n.groupBy(risk.alias("risk")).agg(F.count("*").alias("flows"))


@query("a21_candidate_agreement", f"WITH {FLOWS}, x AS (SELECT flow_id, min(abs(s - lo)) AS start_delta, min(abs(e - hi)) AS end_delta, bool_or(s = lo) AS any_exact FROM pa JOIN fl USING (flow_id) JOIN la USING (label_id) WHERE eligible IS NOT NULL GROUP BY flow_id) SELECT any_exact, count(*) AS flows, sum(start_delta // 1000000000)::BIGINT AS start_seconds, sum(end_delta // 1000000000)::BIGINT AS end_seconds FROM x GROUP BY any_exact")
def a21(spark, d):
    fl, la = inputs(spark, d)
    x = eligible_pairs(spark, d).join(fl.select("flow_id", "start", "end"), "flow_id").join(la.select("label_id", "lo", "hi"), "label_id")
    x = x.groupBy("flow_id").agg(F.min(F.abs(F.col("start") - F.col("lo"))).alias("s"), F.min(F.abs(F.col("end") - F.col("hi"))).alias("e"), F.bool_or(F.col("start") == F.col("lo")).alias("any_exact"))
    return x.groupBy("any_exact").agg(F.count("*").alias("flows"), F.sum(F.expr("s div 1000000000")).alias("start_seconds"), F.sum(F.expr("e div 1000000000")).alias("end_seconds"))


@query("j08_strict_join", f"WITH {FLOWS} SELECT (SELECT count(*) FROM fl) AS left_rows, (SELECT count(*) FROM la) AS right_rows, (SELECT count(*) FROM (SELECT flow_id FROM fl GROUP BY 1 HAVING count(*) > 1)) AS left_repeats, (SELECT count(*) FROM (SELECT label_id FROM la GROUP BY 1 HAVING count(*) > 1)) AS right_repeats, (SELECT count(*) FROM fl WHERE flow_id NOT IN (SELECT label_id FROM la)) AS left_only, (SELECT count(*) FROM la WHERE label_id NOT IN (SELECT flow_id FROM fl)) AS right_only")
def j08(spark, d):
    fl, la = inputs(spark, d)
    return lab.strict_join(fl.select(F.col("flow_id").alias("id")), la.select(F.col("label_id").alias("id")), ["id"])


@query("j09_subset_join", "SELECT count(*) AS rows, count(o_orderkey) AS matched, count(*) FILTER (o_orderkey IS NULL) AS unmatched FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F'")
def j09(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    j = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.agg(F.count("*").alias("rows"), F.count("o_orderkey").alias("matched"), F.count_if(F.col("o_orderkey").isNull()).alias("unmatched"))


@query("j10_last_row_wins", "WITH t AS (SELECT user_id % 40 AS pair, max_by(event_type, event_id) AS truth FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT event_id, truth FROM events LEFT JOIN t ON pair = user_id % 40")
def j10(spark, d):
    e = table(spark, d, "events").withColumn("pair", F.col("user_id") % 40)
    t = e.filter("event_type <> 'error'").groupBy("pair").agg(F.max_by("event_type", "event_id").alias("truth"))
    return e.join(t, "pair", "left").select("event_id", "truth")


@query(
    "j11_nearest_in_time",
    f"WITH a AS (SELECT event_id AS alert_id, user_id AS k, epoch_us(ts) * 1000 AS t_at FROM events WHERE event_type = 'error'), f AS (SELECT event_id AS flow_id, user_id AS k, epoch_us(ts) * 1000 AS s FROM events WHERE event_type = 'click') SELECT alert_id, flow_id, abs(s - t_at) AS gap FROM a JOIN f USING (k) WHERE abs(s - t_at) <= {DAY} QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY abs(s - t_at), s, flow_id) = 1",
)
def j11(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("k"), ns("ts").alias("t"), "event_type")
    a = e.filter("event_type = 'error'").select(F.col("event_id").alias("alert_id"), "k", F.col("t").alias("at"))
    f = e.filter("event_type = 'click'").select(F.col("event_id").alias("flow_id"), "k", F.col("t").alias("start"))
    return lab.nearest_in_time(a, f, ["k"], DAY)


@query("t01_examples", f"WITH {CONSENSUS} SELECT method, flow_id FROM co QUALIFY row_number() OVER (PARTITION BY method ORDER BY candidates DESC, flow_id) <= 5")
def t01(spark, d):
    from ..operators.topk import top_per_group

    return top_per_group(agreed(spark, d), ["method"], [F.desc("candidates"), F.asc("flow_id")], 5).select("method", "flow_id")


@query("u01_except_both_ways", f"WITH {FLOWS}, a AS (SELECT flow_id FROM fl WHERE n >= 2), b AS (SELECT flow_id FROM fl WHERE cap <> '1-URGENT') SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS left_only, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS right_only")
def u01(spark, d):
    from ..operators.quality import differences

    fl = inputs(spark, d)[0]
    return differences(fl.filter("packets >= 2").select("flow_id"), fl.filter("cap <> '1-URGENT'").select("flow_id"))


@query("u03_totals", f"WITH {CONSENSUS} SELECT cap, count(*) AS flows FROM (SELECT cap FROM co WHERE label IS NOT NULL UNION ALL SELECT cap FROM co WHERE label IS NULL) GROUP BY cap")
def u03(spark, d):
    a = agreed(spark, d)
    return a.filter("label is not null").select("cap").union(a.filter("label is null").select("cap")).groupBy("cap").agg(F.count("*").alias("flows"))


@query("u04_distinct_pairs", f"WITH {FLOWS} SELECT DISTINCT flow_id, label_id FROM ed")
def u04(spark, d):
    return edges(spark, d).select("flow_id", "label_id").distinct()


@query("q03_accounting", f"WITH {CONSENSUS} SELECT count(*) = count(*) FILTER (label IS NOT NULL) + count(*) FILTER (label IS NULL) AS assigned_plus_quarantined, count(*) = (SELECT count(*) FROM fl) AS complete FROM co")
def q03(spark, d):
    from ..operators.quality import invariants

    a = agreed(spark, d).agg(F.count("*").alias("n"), F.count("label").alias("yes"), F.count_if(F.col("label").isNull()).alias("no"))
    total = inputs(spark, d)[0].agg(F.count("*").alias("flows"))
    return invariants(a.join(F.broadcast(total)), {"assigned_plus_quarantined": F.col("n") == F.col("yes") + F.col("no"), "complete": F.col("n") == F.col("flows")})


@query("q11_independent_derivation", f"WITH {FLOWS}, pl AS (SELECT f.flow_id, l.label_id FROM fl f JOIN la l ON f.cust = l.cust AND greatest(f.s, l.lo) - least(f.e, l.hi - 1) <= {TOL}) SELECT (SELECT count(*) FROM (SELECT flow_id, label_id FROM ed EXCEPT ALL SELECT * FROM pl)) AS left_only, (SELECT count(*) FROM (SELECT * FROM pl EXCEPT ALL SELECT flow_id, label_id FROM ed)) AS right_only")
def q11(spark, d):
    """Edges once more by a plain interval join, compared with the binned one."""
    from ..operators.quality import differences

    fl, la = inputs(spark, d)
    plain = fl.join(la, "cust").filter((F.col("end") + TOL >= F.col("lo")) & (F.col("hi") + TOL > F.col("start"))).select("flow_id", "label_id")
    return differences(edges(spark, d).select("flow_id", "label_id"), plain)
