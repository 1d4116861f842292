"""Splits, metrics, thresholds and model-facing operators over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers, records
from ..operators import evaluate as ev
from ..operators import anomaly, boosting, forest, models, quality, splits
from .bindings import DAY, PE, PL, packets_e, packets_l, rounded, table
from .registry import query

# Scored rows: a made score in thousandths, a truth and a prediction.
SC = "sc AS (SELECT event_id AS id, event_type AS fam, user_id AS u, (event_id * 7919 % 1000 + CASE WHEN event_type = 'error' THEN 400 ELSE 0 END) / 1400.0::DOUBLE AS s, (event_id * 104729 % 1000) / 1000.0::DOUBLE AS s2, event_type = 'error' AS y FROM events)"


def scored(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events")
    return e.select(
        i.alias("id"), F.col("event_type").alias("fam"), F.col("user_id").alias("u"), ((i * 7919 % 1000 + F.when(F.col("event_type") == "error", 400).otherwise(0)) / 1400.0).alias("s"),
        ((i * 104729 % 1000) / 1000.0).alias("s2"), (F.col("event_type") == "error").alias("y"),
    )


BIN = """count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn"""
DV = lambda a, b: f"coalesce({a} / nullif({b}, 0), 0)"
BINARY = (
    f"SELECT grp, tp, fp, fn, tn, round({DV('tp', 'tp + fp')}, 6) AS precision, round({DV('tp', 'tp + fn')}, 6) AS recall, round({DV('2 * tp', '2 * tp + fp + fn')}, 6) AS f1, round(({DV('2 * tp', '2 * tp + fp + fn')} + {DV('2 * tn', '2 * tn + fp + fn')}) / 2, 6) AS macro_f1, "
    f"round({DV('fp', 'fp + tn')}, 6) AS fpr, round({DV('(tp::DOUBLE * tn - fp::DOUBLE * fn)', 'sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))')}, 6) AS mcc FROM c"
)


@query("a22_nested_accounting", "SELECT fam, part, cp, count(*) AS n FROM (SELECT event_type AS fam, CASE WHEN user_id % 10 < 7 THEN 'train' WHEN user_id % 10 < 8 THEN 'val' ELSE 'test' END AS part, event_id % 4 AS cp FROM events) GROUP BY ROLLUP (fam, part, cp)")
def a22(spark, d):
    part = F.when(F.col("user_id") % 10 < 7, "train").when(F.col("user_id") % 10 < 8, "val").otherwise("test")
    return table(spark, d, "events").select(F.col("event_type").alias("fam"), part.alias("part"), (F.col("event_id") % 4).alias("cp")).rollup("fam", "part", "cp").agg(F.count("*").alias("n"))


@query("a23_distribution_cuts", f"WITH {PL} SELECT cap, ttl, flags, count(*) AS n FROM pl GROUP BY GROUPING SETS ((cap), (ttl), (flags), (cap, ttl), (cap, flags), (ttl, flags))")
def a23(spark, d):
    p = packets_l(spark, d).select("cap", "ttl", F.col("tcp_flags").alias("flags"))
    return p.cube("cap", "ttl", "flags").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).filter(F.col("g").isin(1, 2, 3, 4, 5, 6)).drop("g")


@query("a24_rare_family_gate", "SELECT fam, n, CASE WHEN n >= 2000 THEN 'macro_eligible' WHEN n > 0 THEN 'case_study_only' ELSE 'unavailable' END AS gate, round(1.96 / (2 * sqrt(n + 1.96 * 1.96)), 6) AS half_width FROM (SELECT event_type AS fam, count(*) AS n FROM events GROUP BY 1)")
def a24(spark, d):
    n = table(spark, d, "events").groupBy(F.col("event_type").alias("fam")).agg(F.count("*").alias("n"))
    gate = F.when(F.col("n") >= 2000, "macro_eligible").when(F.col("n") > 0, "case_study_only").otherwise("unavailable")
    return n.select("fam", "n", gate.alias("gate"), F.round(numbers.wilson_half_width(F.col("n")), 6).alias("half_width"))


@query("a25_split_accounting", f"WITH {PE}, s AS (SELECT CASE WHEN ts // {DAY} % 10 < 7 THEN 'train' ELSE 'test' END AS part, ts // {DAY} AS block, kind FROM pe) SELECT part, count(*) AS rows, count(DISTINCT block) AS blocks, count(*) FILTER (kind = 'error') AS errors, round(count(*) / (SELECT count(*) FROM pe), 6) AS ratio FROM s GROUP BY part")
def a25(spark, d):
    b = numbers.time_block(F.col("timestamp_ns"), DAY)
    s = packets_e(spark, d).select(F.when(b % 10 < 7, "train").otherwise("test").alias("part"), b.alias("block"), "kind")
    g = s.groupBy("part").agg(F.count("*").alias("rows"), F.count_distinct("block").alias("blocks"), F.count_if(F.col("kind") == "error").alias("errors"))
    return g.withColumn("ratio", F.round(F.col("rows") / F.sum("rows").over(W.partitionBy(F.lit(0))), 6))


@query(
    "a26_vector_statistics",
    "SELECT feature, cohort, count(*) AS n, round(avg(v), 4) AS mean, round(var_pop(v) * count(*), 2) AS m2, min(v) AS least, max(v) AS most FROM (SELECT 'l_quantity' AS feature, l_returnflag AS cohort, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_returnflag, l_discount FROM lineitem) GROUP BY GROUPING SETS ((feature, cohort), (feature))",
)
def a26(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("cohort"), "l_quantity", "l_discount").unpivot(["cohort"], ["l_quantity", "l_discount"], "feature", "v")
    g = li.rollup("feature", "cohort").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2"), F.min("v").alias("least"), F.max("v").alias("most")).filter("feature is not null")
    return g.withColumns({"mean": F.round("mean", 4), "m2": F.round("m2", 2)})


@query("a27_structural_counts", f"WITH {PL} SELECT cap, count(*) FILTER (flags = 16) AS mode_hits, count(*) FILTER ((flags & 4) <> 0) AS resets, count(*) FILTER ((flags & 1) <> 0) AS fins, count(*) FILTER ((flags & 5) = 5) AS fins_and_resets FROM pl GROUP BY cap")
def a27(spark, d):
    f = F.col("tcp_flags")
    on = lambda m: f.bitwiseAND(m) != 0
    return packets_l(spark, d).groupBy("cap").agg(F.count_if(f == 16).alias("mode_hits"), F.count_if(on(4)).alias("resets"), F.count_if(on(1)).alias("fins"), F.count_if(on(4) & on(1)).alias("fins_and_resets"))


@query("a28_unique_mode", f"WITH {PL}, n AS (SELECT cap, flow, count(*) AS size FROM pl GROUP BY 1, 2), c AS (SELECT cap, size, count(*) AS n FROM n GROUP BY 1, 2), r AS (SELECT *, max(n) OVER (PARTITION BY cap) AS top FROM c) SELECT cap, CASE WHEN count(*) = 1 THEN min(size) END AS mode, count(*) AS ties FROM r WHERE n = top GROUP BY cap")
def a28(spark, d):
    n = packets_l(spark, d).groupBy("cap", "flow").agg(F.count("*").alias("size")).groupBy("cap", "size").agg(F.count("*").alias("n"))
    r = n.withColumn("top", F.max("n").over(W.partitionBy("cap"))).filter("n = top")
    return r.groupBy("cap").agg(F.when(F.count("*") == 1, F.min("size")).alias("mode"), F.count("*").alias("ties"))


@query(
    "a29_domain_shift",
    "WITH r AS (SELECT 'l_quantity' AS feature, l_quantity AS v, l_linestatus = 'F' AS live FROM lineitem WHERE NOT (l_linestatus = 'O' AND l_quantity > 40) UNION ALL SELECT 'l_discount', l_discount, l_linestatus = 'F' FROM lineitem WHERE NOT (l_linestatus = 'O' AND l_quantity > 40)), a AS (SELECT feature, min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_pop(v) AS s FROM r WHERE NOT live GROUP BY 1) SELECT feature, count(*) FILTER (v < lo OR v > hi) AS outside, round((avg(v) - any_value(m)) / any_value(s), 6) AS delta FROM r JOIN a USING (feature) WHERE live GROUP BY feature",
)
def a29(spark, d):
    li = table(spark, d, "lineitem").filter("not (l_linestatus = 'O' and l_quantity > 40)")
    long = li.select((F.col("l_linestatus") == "F").alias("live"), "l_quantity", "l_discount").unpivot(["live"], ["l_quantity", "l_discount"], "feature", "v")
    a = long.filter("not live").groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    j = long.filter("live").join(F.broadcast(a), "feature")
    return rounded(j.groupBy("feature").agg(F.count_if((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi"))).alias("outside"), ((F.avg("v") - F.first("m")) / F.first("s")).alias("delta")), 6)


@query("a30_binary_metrics", f"WITH {SC}, c AS (SELECT u % 5 AS grp, {BIN} FROM (SELECT *, s >= 0.5 AS p FROM sc) GROUP BY 1) {BINARY}")
def a30(spark, d):
    return rounded(ev.binary_metrics(scored(spark, d).withColumn("grp", F.col("u") % 5), ["grp"], F.col("y"), F.col("s") >= 0.5), 6)


PRED = "pr AS (SELECT event_type AS y, CASE WHEN event_id % 4 = 0 THEN 'click' WHEN event_id % 9 = 0 THEN 'ghost' ELSE event_type END AS p FROM events)"
CLASSES = f"{PRED}, g AS (SELECT class, sum(t)::BIGINT AS support, sum(o)::BIGINT AS predicted, sum(h)::BIGINT AS correct FROM (SELECT y AS class, 1 AS t, 0 AS o, CASE WHEN y = p THEN 1 ELSE 0 END AS h FROM pr UNION ALL SELECT p, 0, 1, 0 FROM pr) GROUP BY class), m AS (SELECT *, coalesce(correct / nullif(predicted, 0), 0) AS pr, CASE WHEN support > 0 THEN correct / support END AS re, CASE WHEN support > 0 THEN 2.0 * correct / (support + predicted) END AS f FROM g)"


def predicted(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(F.col("event_type").alias("y"), F.when(i % 4 == 0, "click").when(i % 9 == 0, "ghost").otherwise(F.col("event_type")).alias("p"))


@query("a31_class_metrics", f"WITH {CLASSES} SELECT class, support, predicted, correct, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1 FROM m")
def a31(spark, d):
    return rounded(ev.class_metrics(predicted(spark, d), "y", "p"), 6)


@query("a32_class_summary", f"WITH {CLASSES} SELECT round(sum(correct) / sum(support), 6) AS accuracy, round(avg(f), 6) AS macro_f1, round(sum(f * support) / sum(support), 6) AS weighted_f1, round(avg(re), 6) AS balanced_accuracy, round(min(f), 6) AS least_f1 FROM m WHERE support >= 10")
def a32(spark, d):
    return rounded(ev.summary_of_classes(ev.class_metrics(predicted(spark, d), "y", "p"), 10), 6)


ROLE = "CASE fam WHEN 'view' THEN 'benign' WHEN 'signup' THEN 'holdout' ELSE 'known' END"


def roles(df):
    return df.withColumn("role", F.when(F.col("fam") == "view", "benign").when(F.col("fam") == "signup", "holdout").otherwise("known"))


@query("a33_role_metrics", f"WITH {SC} SELECT {ROLE} AS role, count(*) AS n, round(count(*) FILTER (s >= 0.5) / count(*), 6) AS positive_rate FROM sc GROUP BY 1")
def a33(spark, d):
    return roles(scored(spark, d)).groupBy("role").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("s") >= 0.5) / F.count("*"), 6).alias("positive_rate"))


@query("a34_novel_metrics", f"WITH {SC}, c AS (SELECT 'all' AS grp, {BIN} FROM (SELECT {ROLE} = 'holdout' AS y, s >= 0.5 AS p FROM sc WHERE {ROLE} <> 'known')) {BINARY}")
def a34(spark, d):
    r = roles(scored(spark, d)).filter("role <> 'known'").withColumn("grp", F.lit("all"))
    return rounded(ev.binary_metrics(r, ["grp"], F.col("role") == "holdout", F.col("s") >= 0.5), 6)


GROUPS = f"{SC}, n AS (SELECT s, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM sc GROUP BY s), g AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS q FROM n WINDOW w AS (ORDER BY s DESC))"


@query("a35_curve_areas", f"WITH {GROUPS} SELECT round(sum((neg / q) * (tp / p + (tp - pos) / p) / 2), 6) AS roc_auc, round(sum((pos / p) * tp / (tp + fp)), 6) AS average_precision FROM g")
def a35(spark, d):
    return rounded(ev.curve_areas(ev.score_groups(scored(spark, d), "s", F.col("y"))), 6)


@query("a36_score_histogram", f"WITH {SC} SELECT fam, least(floor(s * 20), 19)::INT AS bin, count(*) AS n FROM sc GROUP BY 1, 2")
def a36(spark, d):
    return ev.histogram(scored(spark, d), ["fam"], "s", 20)


@query("a37_mean_histogram", f"WITH {SC}, h AS (SELECT fam, least(floor(s * 20), 19)::INT AS bin, count(*) AS n FROM sc GROUP BY 1, 2), sh AS (SELECT *, n / sum(n) OVER (PARTITION BY fam) AS share FROM h), gr AS (SELECT fam, b::INT AS bin FROM (SELECT DISTINCT fam FROM sc), range(20) r(b)) SELECT bin, round(avg(coalesce(share, 0)), 6) AS share FROM gr LEFT JOIN sh USING (fam, bin) GROUP BY bin")
def a37(spark, d):
    return rounded(ev.mean_histogram(ev.histogram(scored(spark, d), ["fam"], "s", 20), "fam", 20), 6)


@query("a38_macro_aggregate", f"WITH {SC}, c AS (SELECT fam, u % 2 AS model, {BIN} FROM (SELECT *, s >= 0.5 AS p FROM sc) GROUP BY 1, 2) SELECT model, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, round(avg(coalesce(fp / nullif(fp + tn, 0), 0)), 6) AS mean_fpr FROM c GROUP BY model")
def a38(spark, d):
    m = ev.binary_metrics(scored(spark, d).withColumn("model", F.col("u") % 2), ["fam", "model"], F.col("y"), F.col("s") >= 0.5)
    return rounded(m.groupBy("model").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.avg("fpr").alias("mean_fpr")), 6)


# splits


def day_rows(spark, d):
    return packets_e(spark, d).select("idx", F.lit("E").alias("capture_id"), numbers.time_block(F.col("timestamp_ns"), DAY).alias("block"), F.col("kind").alias("label"))


def split_map(spark, d):
    return splits.allocate(splits.block_counts(day_rows(spark, d), "capture_id", "block", "label"), {"train": 0.7, "validation": 0.1, "test": 0.2}, 3607)


@query("d01_block_allocator")
def d01(spark, d):
    return split_map(spark, d)


@query("d02_block_map")
def d02(spark, d):
    return splits.apply_split(day_rows(spark, d), split_map(spark, d), "capture_id", "block").groupBy("partition", "label").agg(F.count("*").alias("n"))


@query("d03_locked_extension")
def d03(spark, d):
    rows = day_rows(spark, d)
    half = rows.groupBy("capture_id").agg(F.percentile_approx("block", 0.5).alias("mid"))
    first = splits.allocate(splits.block_counts(rows.join(half, "capture_id").filter("block <= mid"), "capture_id", "block", "label"), {"train": 0.7, "test": 0.3}, 3607)
    return splits.allocate(splits.block_counts(rows, "capture_id", "block", "label"), {"train": 0.7, "test": 0.3}, 3607, first)


@query("d04_folds")
def d04(spark, d):
    return splits.allocate(splits.block_counts(day_rows(spark, d), "capture_id", "block", "label"), {f"fold{k}": 0.2 for k in range(5)}, 4404)


@query("d05_leave_one_out", "WITH r AS (SELECT event_type AS fam, CASE WHEN user_id % 10 < 7 THEN 'train' WHEN user_id % 10 < 8 THEN 'val' ELSE 'test' END AS part FROM events), f AS (SELECT DISTINCT fam AS holdout FROM r WHERE fam <> 'view') SELECT holdout, CASE WHEN fam = holdout THEN 'test' ELSE part END AS role, count(*) AS rows, count(*) FILTER (fam = holdout) AS holdout_rows FROM r, f GROUP BY 1, 2")
def d05(spark, d):
    part = F.when(F.col("user_id") % 10 < 7, "train").when(F.col("user_id") % 10 < 8, "val").otherwise("test")
    return splits.leave_one_out(table(spark, d, "events").select(F.col("event_type").alias("fam"), part.alias("part")), "fam", "part", "view")


@query("d06_roles", f"WITH {SC} SELECT id, {ROLE} AS role FROM sc")
def d06(spark, d):
    return roles(scored(spark, d)).select("id", "role")


@query("d08_tie_hash", f"WITH {PE} SELECT idx, substr(sha256('3607|E|' || (ts // {DAY})), 1, 16) AS tie FROM pe")
def d08(spark, d):
    return day_rows(spark, d).select("idx", splits.tie_hash(3607, F.col("capture_id"), F.col("block")).alias("tie"))


@query("d09_paired_cohort", f"WITH {PL} SELECT flow, count(*) >= 9 AS paired FROM pl GROUP BY flow")
def d09(spark, d):
    return packets_l(spark, d).groupBy("flow").agg((F.count("*") >= 9).alias("paired"))


@query(
    "d10_oversample",
    "WITH c AS (SELECT (l_quantity > 48)::INT AS y, count(*) AS n, min(l_extendedprice)::DOUBLE AS lo, max(l_extendedprice)::DOUBLE AS hi FROM lineitem GROUP BY 1), m AS (SELECT max(n) AS most, min(n) AS least, arg_min(y, n) AS small FROM c) SELECT y, FALSE AS made, n, TRUE AS within FROM c UNION ALL SELECT small, TRUE, most - least, TRUE FROM m WHERE most > 5 * least",
)
def d10(spark, d):
    """Rows by class, given or made, and whether made ones lie within the range of their class."""
    li = table(spark, d, "lineitem").select(*NUM, (F.col("l_quantity") > 48).cast("int").alias("y"))
    r = li.groupBy("y").agg(*[f(c).cast("double").alias(f"{f.__name__}_{c}") for c in NUM for f in (F.min, F.max)])
    inside = reduce(lambda a, b: a & b, (F.col(c).between(F.col(f"min_{c}") - 1e-6, F.col(f"max_{c}") + 1e-6) for c in NUM))
    return models.oversample(li, NUM, "y").join(F.broadcast(r), "y").groupBy("y", "made").agg(F.count("*").alias("n"), F.bool_and(inside).alias("within"))


# models

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "m01_scaling_fit",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(quantile_cont(v, 0.5), 6) AS median, round(avg(coalesce(v, (SELECT quantile_cont({c}, 0.5) FROM lineitem WHERE l_linenumber <> 3))), 4) AS mean, round(stddev_pop(coalesce(v, (SELECT quantile_cont({c}, 0.5) FROM lineitem WHERE l_linenumber <> 3))), 4) AS std FROM (SELECT CASE WHEN l_linenumber <> 3 THEN {c} END AS v FROM lineitem)" for c in NUM) + ")",
)
def m01(spark, d):
    li = table(spark, d, "lineitem").select(*[F.when(F.col("l_linenumber") != 3, F.col(c)).alias(c) for c in NUM], F.lit(1.0).alias("constant"))
    p = models.fit_scaling(li, [*NUM, "constant"])
    return p.select("feature", F.round("median", 6).alias("median"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("m02_scaling_apply", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 3) AS {c}" for c in sorted(NUM)) + " FROM lineitem")
def m02(spark, d):
    li = table(spark, d, "lineitem")
    params = models.fit_scaling(li, NUM).collect()  # one row for a feature
    return models.apply_scaling(li, params, KEYS).select(*KEYS, *[F.round(F.col(c).cast("double"), 3).alias(c) for c in sorted(NUM)])


@query("m03_populations", "SELECT 'supervised_known' AS population, count(*) AS n FROM events WHERE event_type <> 'signup' AND user_id % 10 < 7 UNION ALL SELECT 'anomaly_benign', count(*) FROM events WHERE event_type = 'view' AND user_id % 10 < 7")
def m03(spark, d):
    e = table(spark, d, "events").filter("user_id % 10 < 7")
    which = F.filter(F.array(F.when(F.col("event_type") != "signup", "supervised_known"), F.when(F.col("event_type") == "view", "anomaly_benign")), lambda x: x.isNotNull())
    return e.select(F.explode(which).alias("population")).groupBy("population").agg(F.count("*").alias("n"))


def labelled(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(*KEYS, *NUM, (F.col("l_quantity") * 0.02 + F.col("l_discount") * 5 > 0.8).cast("double").alias("y"), (F.col("l_quantity") / 13).cast("int").cast("double").alias("k"))


@query("m04_forest")
def m04(spark, d):
    x = labelled(spark, d)
    return forest.with_probabilities(x, forest.fit(x, NUM, "y", KEYS)).select(*KEYS, F.round(F.get("p", F.lit(1)), 6).alias("attack_probability"))


@query("m05_family_forest")
def m05(spark, d):
    x = labelled(spark, d)
    f = forest.fit(x, NUM, "k", KEYS)
    name = lambda c: F.get(F.array(*map(F.lit, f.classes)), F.col(c)).cast("int").alias(c)
    top = forest.with_probabilities(x, f).select(*KEYS, models.top_two(F.col("p")).alias("t")).select(*KEYS, "t.*")
    return top.select(*KEYS, name("first"), F.round("p_first", 6).alias("p_first"), name("second"), F.round("p_second", 6).alias("p_second"))


@query("m06_tree_and_boosted")
def m06(spark, d):
    x = labelled(spark, d)
    a = models.with_probabilities(models.fit_tree(x, NUM, "y", 15), x, "p1").select(*KEYS, F.get("p1", F.lit(1)).alias("tree"), *NUM, "y")
    return models.with_probabilities(models.fit_boosted(x, NUM, "y", 200), a, "p2").select(*KEYS, "tree", F.get("p2", F.lit(1)).alias("boosted"))


@query("m07_boosted_classes")
def m07(spark, d):
    x = labelled(spark, d)
    return boosting.predict(x, boosting.fit(x, NUM, "k")).groupBy("k", "prediction").agg(F.count("*").alias("n"))


HB = [*NUM[:1], NUM[2]]
HBOS = "lg AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS pr, 'l_quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 'l_discount', l_discount FROM lineitem), r AS (SELECT feature, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi, count(*) AS al FROM lg GROUP BY 1), b AS (SELECT lg.*, lo, hi, al, CASE WHEN v < lo THEN 0 WHEN v > hi THEN 9 ELSE least(floor((v - lo) / (hi - lo) * 8) + 1, 8) END::INT AS bin FROM lg JOIN r USING (feature)), n AS (SELECT feature, bin, count(*) AS n FROM b GROUP BY 1, 2), md AS (SELECT feature, lo, hi, g::INT AS bin, ln((coalesce(n, 0) + 1) / (al + 10)) AS logp FROM r CROSS JOIN range(10) t(g) LEFT JOIN (SELECT feature, bin AS g, n FROM n) USING (feature, g))"


@query("m08_hbos_fit", f"WITH {HBOS} SELECT feature, round(lo, 6) AS lo, round(hi, 6) AS hi, bin, round(logp, 6) AS logp FROM md")
def m08(spark, d):
    return rounded(models.hbos_fit(table(spark, d, "lineitem"), HB, 8, (0.1, 0.9)), 6)


@query("m09_hbos_score", f"WITH {HBOS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, pr AS l_extendedprice, round(-avg(logp), 6) AS score FROM b JOIN (SELECT feature, bin, logp FROM md) USING (feature, bin) GROUP BY 1, 2, 3, 4, 5")
def m09(spark, d):
    li = table(spark, d, "lineitem")
    return rounded(models.hbos_score(li, [*KEYS, "l_extendedprice"], models.hbos_fit(li, HB, 8, (0.1, 0.9)), HB, 8), 6)


@query(
    "m10_correlation_mask",
    "WITH c AS (SELECT abs(corr(l_quantity, l_quantity * 2 + 1)) AS qt, abs(corr(l_quantity, l_discount)) AS qd, abs(corr(l_quantity, l_tax)) AS qx, abs(corr(l_quantity * 2 + 1, l_discount)) AS td, abs(corr(l_quantity * 2 + 1, l_tax)) AS tx, abs(corr(l_discount, l_tax)) AS dx FROM lineitem), "
    "t AS (SELECT *, qt < 0.95 AS kt FROM c), k AS (SELECT *, qd < 0.95 AND NOT (kt AND td >= 0.95) AS kd FROM t), x AS (SELECT *, qx < 0.95 AND NOT (kt AND tx >= 0.95) AND NOT (kd AND dx >= 0.95) AS kx FROM k) "
    "SELECT 'l_quantity' AS kept FROM x UNION ALL SELECT 'twin' FROM x WHERE kt UNION ALL SELECT 'l_discount' FROM x WHERE kd UNION ALL SELECT 'l_tax' FROM x WHERE kx",
)
def m10(spark, d):
    li = table(spark, d, "lineitem").withColumn("twin", F.col("l_quantity") * 2 + 1)
    kept = models.correlation_mask(li, ["l_quantity", "twin", "l_discount", "l_tax"], 0.95)
    return li.limit(1).select(F.explode(F.array(*map(F.lit, kept))).alias("kept"))


@query("m11_isolation_forest")
def m11(spark, d):
    li = table(spark, d, "lineitem")
    forest = anomaly.isolation_forest(li, NUM, KEYS, trees=300, sample=4096)
    return anomaly.isolation_score(li.select(*KEYS, *NUM), NUM, forest).select(*KEYS, F.round("score", 6).alias("score"))


@query("m12_score_decision", f"WITH {SC}, t AS (SELECT fam, s AS threshold FROM (SELECT fam, s, row_number() OVER (PARTITION BY fam ORDER BY s) AS r, count(*) OVER (PARTITION BY fam) AS n FROM sc) WHERE r = ceil((n - 1) * 0.99::DOUBLE) + 1) SELECT fam, round(threshold, 9) AS threshold FROM t")
def m12(spark, d):
    return rounded(ev.higher_quantile(scored(spark, d), ["fam"], "s", 0.99), 9)


@query("m13_meta_features", f"WITH {SC} SELECT id, round(s, 6) AS a, round(s2, 6) AS b, (CASE WHEN s >= 0.9 THEN 1 ELSE 0 END + CASE WHEN s2 >= 0.9 THEN 1 ELSE 0 END)::INT AS votes, round((s + s2) / 2, 6) AS mean FROM sc")
def m13(spark, d):
    vote = lambda c: F.when(F.col(c) >= 0.9, 1).otherwise(0)
    return scored(spark, d).select("id", F.round("s", 6).alias("a"), F.round("s2", 6).alias("b"), (vote("s") + vote("s2")).alias("votes"), F.round((F.col("s") + F.col("s2")) / 2, 6).alias("mean"))


def meta_scores(spark, d):
    """Out-of-fold anomaly scores of all rows; folds are dealt by order, so that an order lies in one fold."""
    x = labelled(spark, d).withColumn("fold", F.pmod(F.xxhash64("l_orderkey"), F.lit(5)).cast("int"))
    return anomaly.out_of_fold(x, NUM, KEYS, "fold", F.col("y") == 0)


@query("m14_out_of_fold")
def m14(spark, d):
    return meta_scores(spark, d).select(*KEYS, "fold", *[F.round(c, 6).alias(c) for c in ("hbos", "hbos_z", "isolation", "isolation_z")], "hbos_vote", "isolation_vote")


@query("m15_stacked_forest")
def m15(spark, d):
    """A forest on the features and the out-of-fold scores: z-scores, votes, their number, and the mean z-score."""
    x = meta_scores(spark, d).withColumns({"votes": F.col("hbos_vote") + F.col("isolation_vote"), "mean_z": 0.5 * F.col("hbos_z") + 0.5 * F.col("isolation_z")}).persist()
    meta = ["hbos_z", "isolation_z", "hbos_vote", "isolation_vote", "votes", "mean_z"]
    return forest.with_probabilities(x, forest.fit(x, [*NUM, *meta], "y", KEYS)).select(*KEYS, F.round(F.get("p", F.lit(1)), 6).alias("p"))


@query("m16_leave_one_out_training")
def m16(spark, d):
    """Every family held out in turn at every checkpoint: a forest of the checkpoint's other rows scores it. Two lines of an order stand for a checkpoint."""
    x = labelled(spark, d).withColumn("checkpoint", 3 + 2 * F.expr("(l_linenumber - 1) div 2").cast("int"))
    scored_rows = forest.leave_one_out(forest.cells(x, NUM, "y", KEYS, ["k", "checkpoint"]), NUM, "y", "k", "checkpoint", KEYS)
    mean = lambda c: F.sum(c * F.col("_m")) / F.sum(F.when(F.col("p").isNotNull(), F.col("_m")))
    return scored_rows.groupBy("checkpoint", F.col("k").alias("holdout")).agg(F.sum("_m").alias("n"), F.round(mean(F.col("p")), 6).alias("mean_p"), mean((F.col("p") >= 0.5).cast("int")).alias("flagged"))


@query("m17_decision_fusion", f"WITH {SC} SELECT id, CASE WHEN s >= 0.8 THEN 'known_attack' WHEN v >= 2 THEN 'unknown_candidate' WHEN v = 1 THEN 'uncertain' ELSE 'benign' END AS decision FROM (SELECT *, CASE WHEN s >= 0.6 THEN 1 ELSE 0 END + CASE WHEN s2 >= 0.6 THEN 1 ELSE 0 END AS v FROM sc)")
def m17(spark, d):
    vote = lambda c: F.when(F.col(c) >= 0.6, 1).otherwise(0)
    return scored(spark, d).select("id", records.fused_decision(F.col("s"), 0.8, vote("s") + vote("s2")).alias("decision"))


@query("m18_gated_class", f"WITH {SC} SELECT id, CASE WHEN s >= 0.4 THEN CASE WHEN s2 >= 1 - s2 THEN 'dos' ELSE 'web' END ELSE 'benign' END AS decision FROM sc")
def m18(spark, d):
    p = F.array(1 - F.col("s"), F.col("s") * F.col("s2"), F.col("s") * (1 - F.col("s2")))
    x = scored(spark, d).select("id", "s", p.alias("p"))
    return x.select("id", F.when(F.col("s") >= 0.4, records.gated_class(F.col("p"), ["benign", "dos", "web"], 0.0)).otherwise("benign").alias("decision"))


@query("m19_candidate_thresholds", f"WITH {SC}, b AS (SELECT s, row_number() OVER (ORDER BY s) AS r, count(*) OVER () AS n FROM sc WHERE fam = 'view'), g AS (SELECT unnest([0.9::DOUBLE, 0.95, 0.99, 0.999]) AS q) SELECT DISTINCT round(s, 9) AS threshold FROM b, g WHERE r = ceil((n - 1) * q) + 1")
def m19(spark, d):
    v = scored(spark, d).filter("fam = 'view'")
    parts = [ev.higher_quantile(v, [], "s", q) for q in (0.9, 0.95, 0.99, 0.999)]
    return rounded(reduce(lambda a, b: a.unionByName(b), parts), 9).distinct()


CUTS = [0.2, 0.5, 0.8]
SURFACE = f"{SC}, gr AS (SELECT i::INT AS i, j::INT AS j, (CASE i WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 WHEN 2 THEN 0.8 ELSE 9 END)::DOUBLE AS ca, (CASE j WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 WHEN 2 THEN 0.8 ELSE 9 END)::DOUBLE AS cb FROM range(4) a(i), range(4) b(j)), su AS (SELECT i, j, count(*) FILTER (y AND s < ca AND s2 < cb) AS pos_below, count(*) FILTER (NOT y AND s < ca AND s2 < cb) AS neg_below FROM gr, sc GROUP BY i, j)"


@query("m20_threshold_surface", f"WITH {SURFACE} SELECT i, j, pos_below, neg_below FROM su")
def m20(spark, d):
    return ev.threshold_surface(scored(spark, d), "s", "s2", CUTS, CUTS, F.col("y"))


ROLE_OF = "CASE WHEN fam IN ('view', 'click') THEN 'benign' WHEN fam = 'purchase' THEN 'known' ELSE 'unknown' END"


@query(
    "m21_pair_selection",
    f"""WITH {SC}, r AS (SELECT {ROLE_OF} AS role, fam, s >= 0.8 AS fires, s2 AS a, id * 31 % 1000 / 1000.0::DOUBLE AS b FROM sc), gr AS (SELECT i::INT AS i, j::INT AS j, (CASE i WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 0.8 END)::DOUBLE AS ca, (CASE j WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 0.8 END)::DOUBLE AS cb FROM range(3) x(i), range(3) z(j)),
e AS (SELECT i, j, avg((fires OR a >= ca OR b >= cb)::INT) FILTER (role = 'benign') AS fpr, avg((fires OR a >= ca OR b >= cb)::INT) FILTER (role = 'known') AS known FROM r, gr GROUP BY i, j),
f AS (SELECT i, j, fam, avg((NOT fires AND a >= ca AND b >= cb)::INT) AS q FROM r, gr WHERE role = 'unknown' GROUP BY i, j, fam), u AS (SELECT i, j, avg(q) AS unk FROM f GROUP BY i, j)
SELECT i, j, round(fpr, 6) AS fpr, round(known, 6) AS known_recall, round(unk, 6) AS unknown_recall FROM e JOIN u USING (i, j) WHERE fpr <= 0.7 ORDER BY round(unk, 12) DESC, known DESC, fpr, i, j LIMIT 1""",
)
def m21(spark, d):
    fam = F.col("fam")
    role = F.when(fam.isin("view", "click"), "benign").when(fam == "purchase", "known").otherwise("unknown")
    x = scored(spark, d).select(role.alias("role"), "fam", "s", F.col("s2").alias("a"), (F.col("id") * 31 % 1000 / 1000.0).alias("b"))
    return rounded(ev.best_pair(ev.fusion_surface(x, F.col("s") >= 0.8, "a", "b", CUTS, CUTS, "role", "fam"), 0.7), 6)


@query("m22_threshold_scan", f"WITH {GROUPS} SELECT round(s, 9) AS score, round(tp / p, 6) AS recall, round(tp / (tp + fp), 6) AS precision, round(fp / q, 6) AS fpr FROM g WHERE fp / q <= 0.05 ORDER BY tp / p DESC, tp / (tp + fp) DESC, s DESC LIMIT 1")
def m22(spark, d):
    b = ev.best_threshold(ev.score_groups(scored(spark, d), "s", F.col("y")), 0.05)
    return b.select(F.round("score", 9).alias("score"), *[F.round(c, 6).alias(c) for c in ("recall", "precision", "fpr")])


@query(
    "m22_profile_scan",
    f"""WITH {SC}, x AS (SELECT p.profile, CASE fam WHEN 'view' THEN 'benign' WHEN 'click' THEN 'benign' WHEN 'error' THEN 'dos' ELSE 'web' END AS truth, CASE p.profile WHEN 'A' THEN s2 WHEN 'B' THEN (s + s2) / 2 ELSE s END AS score, CASE WHEN id % 5 = 0 THEN CASE WHEN id % 2 = 0 THEN 'dos' ELSE 'web' END WHEN fam = 'error' THEN 'dos' ELSE 'web' END AS family
  FROM sc, (VALUES ('A'), ('B'), ('C')) p(profile)), t AS (SELECT DISTINCT profile, score AS threshold FROM x),
c AS (SELECT t.profile, t.threshold, count(*) FILTER (score >= threshold AND truth = 'benign') AS neg, count(*) FILTER (truth = 'benign') AS s0, count(*) FILTER (truth <> 'benign') AS pos, count(*) FILTER (truth <> 'benign' AND score >= threshold) AS hit, count(*) FILTER (score < threshold) AS said0,
  count(*) FILTER (family = 'dos' AND score >= threshold) AS pd, count(*) FILTER (family = 'dos' AND truth = 'dos' AND score >= threshold) AS td, count(*) FILTER (truth = 'dos') AS sd, count(*) FILTER (family = 'web' AND score >= threshold) AS pw, count(*) FILTER (family = 'web' AND truth = 'web' AND score >= threshold) AS tw, count(*) FILTER (truth = 'web') AS sw
  FROM t JOIN x ON x.profile = t.profile GROUP BY 1, 2),
m AS (SELECT profile, threshold, 2 * td / (pd + sd) AS fd, (2 * (s0 - neg) / (said0 + s0) + 2 * td / (pd + sd) + 2 * tw / (pw + sw)) / 3 AS mf, hit / pos AS ar, neg / s0 AS fpr, td / pd AS prd, td / sd AS rcd FROM c WHERE neg / s0 <= 0.3 + 1e-15),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY profile ORDER BY fd DESC, mf DESC, ar DESC, fpr, threshold DESC) = 1), g AS (SELECT *, list_filter([CASE WHEN prd < 0.3 THEN 'dos:precision' END, CASE WHEN rcd < 0.5 THEN 'dos:recall' END, CASE WHEN ar < max(ar) OVER () - 0.2 THEN 'attack_recall_drop' END,
  CASE WHEN mf < max(mf) OVER () - 0.1 THEN 'macro_f1_drop' END, CASE WHEN fd < max(fd) OVER () - 0.2 THEN 'target_f1_drop' END], lambda v: v IS NOT NULL) AS why FROM b)
SELECT profile, round(threshold, 6) AS threshold, round(fd, 6) AS least_target_f1, round(mf, 6) AS macro_f1, round(ar, 6) AS attack_recall, round(fpr, 6) AS fpr, array_to_string(why, ',') AS reasons, len(why) = 0 AS eligible, coalesce(profile = (SELECT min(profile) FROM g WHERE len(why) = 0), FALSE) AS selected FROM g""",
)
def m22_profiles(spark, d):
    """Three profiles of 54, 61 and 64 features, by made scores: their best thresholds, gates, and the smallest that passes."""
    i, fam = F.col("id"), F.col("fam")
    family = F.when(i % 5 == 0, F.when(i % 2 == 0, "dos").otherwise("web")).when(fam == "error", "dos").otherwise("web")
    truth = F.when(fam.isin("view", "click"), "benign").when(fam == "error", "dos").otherwise("web")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("profile"), c.alias("score")) for n, c in (("A", F.col("s2")), ("B", (F.col("s") + F.col("s2")) / 2), ("C", F.col("s")))])).alias("x")
    x = scored(spark, d).select(truth.alias("truth"), family.alias("family"), each).select("truth", "family", "x.*")
    scans = ev.threshold_scan(x, "profile", "truth", "score", "family", ["benign", "dos", "web"], ["dos"], 0.3)
    e = ev.eligible_profiles(scans, "profile", {"A": 54, "B": 61, "C": 64}, ["dos"], 0.3, 0.5, 0.2, 0.1, 0.2)
    return rounded(e.select("profile", "threshold", "least_target_f1", "macro_f1", "attack_recall", "fpr", F.array_join("reasons", ",").alias("reasons"), "eligible", "selected"), 6)


TREES = [50, 100, 150, 200, 300]


@query("m24_tree_convergence")
def m24(spark, d):
    """Curves over one forest's first trees."""
    x = forest.cells(labelled(spark, d), NUM, "y", KEYS, [])
    p = forest.with_probabilities(x, forest.fit(x, NUM, "y"), "q", TREES).withColumn("p", F.array(*[F.get("q", F.lit(2 * k + 1)) for k in range(len(TREES))]))
    return rounded(models.convergence(p, TREES, F.col("y") == 1, times=F.col("_m")), 6)


FAMS = f"{SC}, fm AS (SELECT u, avg(s) AS v FROM sc GROUP BY u)"
BOOT = "(('0x' || substr(sha256(rep || ':' || i), 1, 7))::BIGINT % n)"


@query("m25_bootstrap_mean", f"WITH {FAMS}, r AS (SELECT row_number() OVER (ORDER BY u) - 1 AS i, v, count(*) OVER () AS n FROM fm), pl AS (SELECT rep, {BOOT} AS j FROM r, range(100) t(rep)), m AS (SELECT rep, avg(r.v) AS m FROM pl JOIN r ON r.i = pl.j GROUP BY rep) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.975), 6) AS high FROM m")
def m25(spark, d):
    f = scored(spark, d).groupBy("u").agg(F.avg("s").alias("v"))
    return rounded(ev.bootstrap_mean(f, "u", "v", 100), 6)


@query(
    "m26_cluster_bootstrap",
    f"""WITH {SC}, c AS (SELECT u % 3 AS st, u, {", ".join(f"count(*) FILTER ({t} AND {p}) AS {m}{n}" for m, v in (("c", "s"), ("b", "s2")) for n, t, p in (("tn", "NOT y", f"NOT {v} >= 0.5"), ("fp", "NOT y", f"{v} >= 0.5"), ("fn", "y", f"NOT {v} >= 0.5"), ("tp", "y", f"{v} >= 0.5")))} FROM sc GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY u) - 1 AS i, count(*) OVER (PARTITION BY st) AS n FROM c), pl AS (SELECT rep, st, ('0x' || substr(sha256(rep || ':' || st || ':' || i), 1, 7))::BIGINT % n AS j FROM r, range(200) t(rep)),
w AS (SELECT 0 AS kind, 0 AS rep, sum(ctn) AS ctn, sum(cfp) AS cfp, sum(cfn) AS cfn, sum(ctp) AS ctp, sum(btn) AS btn, sum(bfp) AS bfp, sum(bfn) AS bfn, sum(btp) AS btp FROM c UNION ALL SELECT 1, rep, sum(ctn), sum(cfp), sum(cfn), sum(ctp), sum(btn), sum(bfp), sum(bfn), sum(btp) FROM pl JOIN r ON r.st = pl.st AND r.i = pl.j GROUP BY rep),
m AS (SELECT kind, rep, unnest(['f1', 'recall', 'fpr']) AS metric, unnest([2 * ctp / (2 * ctp + cfp + cfn), ctp / (ctp + cfn), cfp / (cfp + ctn)]) AS cand, unnest([2 * btp / (2 * btp + bfp + bfn), btp / (btp + bfn), bfp / (bfp + btn)]) AS base FROM w),
o AS (SELECT metric, max(cand) FILTER (kind = 0) AS cand, max(base) FILTER (kind = 0) AS base, quantile_cont(cand - base, 0.025) FILTER (kind = 1) AS low, quantile_cont(cand - base, 0.975) FILTER (kind = 1) AS high FROM m GROUP BY metric)
SELECT metric, round(cand, 6) AS candidate, round(base, 6) AS baseline, round(cand - base, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, (SELECT low > 0 FROM o WHERE metric = 'f1') AND (SELECT cand - base >= -0.01 FROM o WHERE metric = 'recall') AND (SELECT cand - base <= 0.01 FROM o WHERE metric = 'fpr') AS accepted FROM o""",
)
def m26(spark, d):
    x = scored(spark, d).withColumn("st", F.col("u") % 3)
    return rounded(ev.accepted(ev.cluster_bootstrap(x, "st", "u", F.col("y"), F.col("s") >= 0.5, F.col("s2") >= 0.5, 200)), 6)


@query("m28_paired_delta")
def m28(spark, d):
    """Recall of every family by forests of 50 and of 300 trees, and the interval of the mean difference over families."""
    x = forest.cells(labelled(spark, d), NUM, "y", KEYS, ["k"])
    both = forest.with_probabilities(x, forest.fit(x, NUM, "y", trees=50), "p50")
    both = forest.with_probabilities(both, forest.fit(x, NUM, "y", trees=300), "p300")
    hit = lambda c: F.sum(F.when(F.col("y") == 1, (F.get(c, F.lit(1)) >= 0.5).cast("long") * F.col("_m"))) / F.sum(F.when(F.col("y") == 1, F.col("_m")))
    f = both.groupBy("k").agg(F.sum("_m").alias("n"), hit("p50").alias("rf50"), hit("p300").alias("rf300")).withColumn("delta", F.col("rf300") - F.col("rf50")).persist()
    b = ev.bootstrap_mean(f.filter("delta is not null"), "k", "delta", 1000).select(F.col("low").alias("mean_low"), F.col("mean").alias("mean_delta"), F.col("high").alias("mean_high"))
    return rounded(f.join(F.broadcast(b)), 6)


@query("m29_error_overlap", "WITH h AS (SELECT event_type = 'error' AS side, least(greatest(floor(value / 100 * 30), 0), 29) AS b, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY side) AS share FROM h), m AS (SELECT b, min(share) AS least, count(*) AS k FROM s GROUP BY b) SELECT round(coalesce(sum(least) FILTER (k = 2), 0), 6) AS overlap FROM m")
def m29(spark, d):
    e = table(spark, d, "events").withColumn("side", F.col("event_type") == "error")
    return rounded(ev.histogram_overlap(e, "side", "value", 0.0, 100.0, 30), 6)


@query(
    "m29_error_groups",
    f"""WITH {SC}, r AS (SELECT fam, s AS prob, CASE WHEN NOT y AND s >= 0.5 THEN 'FP' WHEN y AND s < 0.5 THEN 'FN' WHEN y THEN 'TP' ELSE 'TN' END AS cell, u % 4 AS g, u::DOUBLE AS fa, s * s2 AS fb, s2 AS fc FROM sc),
lg AS (SELECT cell, CASE WHEN cell IN ('FP', 'FN') THEN g END AS g, prob, unnest(['fa', 'fb', 'fc']) AS f, unnest([fa, fb, fc]) AS v FROM r),
st AS (SELECT cell, g, f, avg(v) AS m, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi FROM lg GROUP BY 1, 2, 3),
t AS (SELECT e.cell, e.g, e.f, abs(e.m - o.m) / (o.sd + 1e-9) AS sg, least(e.lo, x.lo) AS a, greatest(e.hi, x.hi) AS b, x.cell AS xc FROM st e JOIN st o ON o.f = e.f AND o.cell = CASE e.cell WHEN 'FP' THEN 'TN' ELSE 'TP' END JOIN st x ON x.f = e.f AND x.cell = CASE e.cell WHEN 'FP' THEN 'TP' ELSE 'TN' END WHERE e.cell IN ('FP', 'FN')
  QUALIFY row_number() OVER (PARTITION BY e.cell, e.g ORDER BY abs(e.m - o.m) / (o.sd + 1e-9) DESC, e.f) <= 2),
hh AS (SELECT t.cell, t.g, t.f, side, least(floor((v - a) / (b - a) * 30), 29) AS bin FROM t JOIN (SELECT *, 0 AS side FROM lg WHERE cell IN ('FP', 'FN') UNION ALL SELECT *, 1 FROM lg WHERE cell IN ('TP', 'TN')) l ON l.f = t.f AND CASE side WHEN 0 THEN l.cell = t.cell AND l.g = t.g ELSE l.cell = t.xc END),
hn AS (SELECT cell, g, f, side, bin, count(*) / sum(count(*)) OVER (PARTITION BY cell, g, f, side) AS p FROM hh GROUP BY 1, 2, 3, 4, 5), ar AS (SELECT cell, g, f, sum(p) AS area FROM (SELECT cell, g, f, bin, min(p) AS p FROM hn GROUP BY 1, 2, 3, 4 HAVING count(*) = 2) GROUP BY 1, 2, 3),
ov AS (SELECT t.cell, t.g, avg(coalesce(area, 0)) AS overlap, max_by(t.f, sg) AS tf, max(sg) AS ts FROM t LEFT JOIN ar ON ar.cell = t.cell AND ar.g = t.g AND ar.f = t.f GROUP BY 1, 2),
cf AS (SELECT cell, g, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY cell) AS share, avg(prob) AS mp, avg((CASE cell WHEN 'FP' THEN prob > 0.5 AND prob <= 0.65 ELSE prob >= 0.35 AND prob < 0.5 END)::INT) AS bo, avg((CASE cell WHEN 'FP' THEN prob > 0.8 ELSE prob < 0.2 END)::INT) AS co FROM r WHERE cell IN ('FP', 'FN') GROUP BY 1, 2)
SELECT cf.cell AS error, cf.g AS g, n, round(share, 6) AS share, round(mp, 6) AS mean_prob, round(bo, 6) AS boundary, round(co, 6) AS confident, round(overlap, 6) AS overlap, tf AS top_feature, round(ts, 5) AS top_sigmas,
CASE WHEN bo >= 0.5 THEN 'threshold' WHEN co >= 0.5 AND overlap < 0.5 THEN 'drift' WHEN overlap >= 0.5 THEN 'overlap' ELSE 'mixed' END AS cause FROM cf JOIN ov ON ov.cell = cf.cell AND ov.g = cf.g""",
)
def m29_groups(spark, d):
    x = scored(spark, d).select("y", "s", (F.col("u") % 4).alias("g"), F.col("u").cast("double").alias("fa"), (F.col("s") * F.col("s2")).alias("fb"), F.col("s2").alias("fc"))
    out = ev.error_groups(x, F.col("y"), F.col("s") >= 0.5, F.col("s"), "g", ["fa", "fb", "fc"], k=2)
    return rounded(out.withColumn("top_sigmas", F.round("top_sigmas", 5)), 6)


@query("m30_log_loss", f"WITH {SC} SELECT fam, round(avg(-ln(greatest(1e-15, CASE WHEN y THEN s ELSE 1 - s END))), 6) AS log_loss FROM sc GROUP BY fam")
def m30(spark, d):
    return rounded(ev.log_loss(scored(spark, d), ["fam"], F.when(F.col("y"), F.col("s")).otherwise(1 - F.col("s"))), 6)


@query("m31_max_vote", f"WITH {SC} SELECT id, round(greatest(s, s2), 6) AS p FROM sc")
def m31(spark, d):
    return scored(spark, d).select("id", F.round(F.greatest("s", "s2"), 6).alias("p"))


@query("a53_importances")
def a53(spark, d):
    x = labelled(spark, d)
    return rounded(spark.createDataFrame(forest.importances(forest.fit(x, NUM, "y", KEYS)), "feature string, importance double"), 6)


@query("st12_drift", f"WITH {PE}, w AS (SELECT ts // {DAY} AS day, count(*) AS n, avg(wire) AS m FROM pe GROUP BY 1), l AS (SELECT day, n, m, lag(n) OVER (ORDER BY day) AS n0, lag(m) OVER (ORDER BY day) AS m0 FROM w) SELECT day, round(abs(m - m0), 4) AS delta, round(20000 * sqrt(ln(2 / 0.002::DOUBLE) / 2 * (1 / n + 1 / n0)), 4) AS bound, abs(m - m0) > 20000 * sqrt(ln(2 / 0.002::DOUBLE) / 2 * (1 / n + 1 / n0)) AS drift FROM l WHERE m0 IS NOT NULL")
def st12(spark, d):
    from ..streaming.drift import drift_windows

    return rounded(drift_windows(packets_e(spark, d).withColumn("day", numbers.time_block(F.col("timestamp_ns"), DAY)), "day", "wire_length", 20000.0, 0.002))


@query("st13_runtime_epochs", f"WITH {PE}, e AS (SELECT k % 10 AS sensor, sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY k % 10 ORDER BY idx)::BIGINT AS epoch FROM pe) SELECT sensor, epoch, count(*) AS n FROM e GROUP BY 1, 2")
def st13(spark, d):
    from ..operators.windows import epochs

    e = epochs(packets_e(spark, d).withColumn("sensor", F.col("k") % 10), ["sensor"], "idx", F.col("kind") == "signup")
    return e.groupBy("sensor", "epoch").agg(F.count("*").alias("n"))


# checks


@query("q01_contiguous", f"WITH {PL} SELECT flow, min(ttl) AS least, max(ttl) AS most, count(*) AS n, count(DISTINCT ttl) AS distinct_n FROM pl GROUP BY flow HAVING min(ttl) <> 1 OR max(ttl) <> count(*) OR count(DISTINCT ttl) <> count(*)")
def q01(spark, d):
    return quality.contiguous(packets_l(spark, d), ["flow"], "ttl")


@query("q02_snapshot_completeness", f"WITH {PL}, n AS (SELECT flow, count(*) AS size FROM pl GROUP BY flow) SELECT k AS checkpoint, count(*) FILTER (size >= k) AS expected, count(*) FILTER (size >= k) AS present FROM n, (VALUES (3), (5), (7), (9)) c(k) GROUP BY k")
def q02(spark, d):
    from ..operators.windows import checkpoints, with_flow_steps

    p = with_flow_steps(packets_l(spark, d), ["flow"], ["ord"])
    have = checkpoints(p, ["flow"]).select("flow", "checkpoint").distinct().groupBy("checkpoint").agg(F.count("*").alias("present"))
    n = p.groupBy("flow").agg(F.count("*").alias("size")).select(F.explode(F.array(*map(F.lit, (3, 5, 7, 9)))).alias("checkpoint"), "size").groupBy("checkpoint").agg(F.count_if(F.col("size") >= F.col("checkpoint")).alias("expected"))
    return n.join(have, "checkpoint", "left").na.fill(0)


@query("q04_metadata_equality", f"WITH {PL} SELECT count(*) FILTER (wire - pay <> hdr) AS header, count(*) FILTER (dir NOT IN ('forward', 'reverse')) AS direction FROM pl")
def q04(spark, d):
    p = packets_l(spark, d)
    return p.agg(F.count_if(F.col("wire_length") - F.col("payload_length") != F.col("header_length")).alias("header"), F.count_if(~F.col("direction").isin("forward", "reverse")).alias("direction"))


@query("q05_finite", "SELECT count(*) FILTER (event_id % 50 = 0) AS value, 0::BIGINT AS other FROM events")
def q05(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 50 != 0, F.col("value")).otherwise(float("inf")).alias("value"), F.lit(1.0).alias("other"))
    return quality.finite_counts(e, ["value", "other"])


@query("q06_block_leakage", f"WITH {PE}, s AS (SELECT ts // {DAY} AS block, CASE WHEN ts // {DAY} % 10 = 3 THEN k % 2 ELSE 0 END AS part FROM pe) SELECT block, count(DISTINCT part) AS partitions FROM s GROUP BY block HAVING count(DISTINCT part) > 1")
def q06(spark, d):
    b = numbers.time_block(F.col("timestamp_ns"), DAY)
    return quality.leaking_blocks(packets_e(spark, d).select(b.alias("block"), F.when(b % 10 == 3, F.col("k") % 2).otherwise(0).alias("part")), ["block"], "part")


@query("q07_checkpoint_chain", f"WITH {PL}, n AS (SELECT flow, max(ord) AS size FROM pl GROUP BY flow), ck AS (SELECT flow, k AS checkpoint FROM n, (VALUES (3), (5), (7), (9)) c(k) WHERE size >= k) SELECT p.hi::INT AS upper, p.lo::INT AS lower, (SELECT count(*) FROM ck a WHERE a.checkpoint = p.hi AND NOT EXISTS (SELECT 1 FROM ck b WHERE b.flow = a.flow AND b.checkpoint = p.lo)) AS missing FROM (VALUES (9, 7), (7, 5), (5, 3)) p(hi, lo)")
def q07(spark, d):
    from ..operators.windows import checkpoints, with_flow_steps

    c = checkpoints(with_flow_steps(packets_l(spark, d), ["flow"], ["ord"]), ["flow"]).select("flow", "checkpoint").distinct()
    at = lambda k: c.filter(F.col("checkpoint") == k).select("flow")
    parts = [quality.missing_from(at(a), at(b), ["flow"]).select(F.lit(a).alias("upper"), F.lit(b).alias("lower"), "missing") for a, b in ((9, 7), (7, 5), (5, 3))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("q08_membership_digest", f"WITH {PL}, h AS (SELECT DISTINCT cap, sha256(cap || '|' || flow) AS h FROM pl), l AS (SELECT cap, substr(h, 1, 4) AS b, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY 1, 2) SELECT cap, sha256(string_agg(d, '' ORDER BY b)) AS digest FROM l GROUP BY cap")
def q08(spark, d):
    m = packets_l(spark, d).select("cap", "flow").distinct()
    return quality.membership_digest(m, ["cap"], F.concat_ws("|", "cap", "flow"))


@query("q10_content_fingerprint")
def q10(spark, d):
    return quality.content_fingerprint(table(spark, d, "orders"))


@query(
    "q12_experiment_proof",
    "WITH r AS (SELECT event_type AS fam, CASE WHEN user_id % 10 < 7 THEN 'train' WHEN user_id % 10 < 8 THEN 'val' ELSE 'test' END AS part FROM events), f AS (SELECT DISTINCT fam AS holdout FROM r WHERE fam <> 'view'), e AS (SELECT holdout, CASE WHEN fam = holdout THEN 'test' ELSE part END AS role, count(*) FILTER (fam = holdout) AS held FROM r, f GROUP BY 1, 2) SELECT count(*) FILTER (role <> 'test' AND held > 0) AS violations FROM e",
)
def q12(spark, d):
    e = d05(spark, d)
    bad = (F.col("role") != "test") & (F.col("holdout_rows") > 0)
    return e.agg(F.count_if(bad).alias("violations"))


@query("q13_source_accounting", "SELECT o_orderpriority AS source, count(*) AS rows, count(*) >= 100 AS ok FROM orders GROUP BY 1")
def q13(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("rows"))
    return n.withColumn("ok", F.col("rows") >= 100)
