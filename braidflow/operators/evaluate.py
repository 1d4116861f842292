"""Metrics, curves, thresholds, bootstraps and decisions of scored rows, as grouped aggregations and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import safe_divide
from .quantiles import group_ranks
from .topk import top_per_group


def binary_metrics(df: DataFrame, by: list[str], y: Column, p: Column) -> DataFrame:
    """Confusion counts and their ratios; 0 where a denominator is empty."""
    c = df.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    f1 = safe_divide(2 * tp, 2 * tp + fp + fn)
    out = {
        "precision": safe_divide(tp, tp + fp), "recall": safe_divide(tp, tp + fn), "f1": f1, "macro_f1": (f1 + safe_divide(2 * tn, 2 * tn + fp + fn)) / 2,
        "fpr": safe_divide(fp, fp + tn), "mcc": safe_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }
    return c.withColumns(out)


def class_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """Precision, recall and F1 of every class that occurs as truth or prediction; null recall without support."""
    cells = df.groupBy(y, p).agg(F.count("*").alias("n"))
    each = cells.select(F.explode(F.array(F.struct(F.col(y).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("o")), F.struct(F.col(p).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("o")))).alias("x"), (F.col(y) == F.col(p)).alias("hit"), "n")
    g = each.groupBy(F.col("x.c").alias("class")).agg(F.sum(F.col("x.t") * F.col("n")).alias("support"), F.sum(F.col("x.o") * F.col("n")).alias("predicted"), F.sum(F.when(F.col("hit"), F.col("x.t") * F.col("n")).otherwise(0)).alias("correct"))
    has = F.col("support") > 0
    return g.withColumns(
        {
            "precision": safe_divide(F.col("correct"), F.col("predicted")), "recall": F.when(has, F.col("correct") / F.col("support")), "f1": F.when(has, safe_divide(2.0 * F.col("correct"), F.col("support") + F.col("predicted"))),
        }
    )


def summary_of_classes(classes: DataFrame, least_support: int = 0) -> DataFrame:
    """Accuracy, macro and weighted F1, balanced accuracy and the least F1 over classes with enough support."""
    c = classes.filter((F.col("support") > 0) & (F.col("support") >= least_support))
    return c.agg(
        (F.sum("correct") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.avg("recall").alias("balanced_accuracy"), F.min("f1").alias("least_f1")
    )


def score_groups(df: DataFrame, score: str, y: Column, bucket: Column | None = None) -> DataFrame:
    """Confusion counts at every distinct score taken as threshold (ties together), highest first.

    Rows are first counted by score; running sums come from a window over coarse score ranges' totals and one inside
    each range.
    """
    n = df.groupBy(F.col(score).alias("score")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    n = n.withColumn("_b", F.floor(F.col("score") * 1000) if bucket is None else bucket)
    t = n.groupBy("_b").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    before = W.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.select("_b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "pq"], F.sum("p").over(whole).alias("positives"), F.sum("q").over(whole).alias("negatives"))
    w = W.partitionBy("_b").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    j = n.join(t, "_b")
    return j.select("score", "pos", "neg", (F.col("p0") + F.sum("pos").over(w)).alias("tp"), (F.col("q0") + F.sum("neg").over(w)).alias("fp"), "positives", "negatives")


def curve_areas(groups: DataFrame) -> DataFrame:
    """Area under the ROC curve (trapezoids over score groups) and average precision."""
    p, q = F.col("positives"), F.col("negatives")
    tpr1, tpr0 = F.col("tp") / p, (F.col("tp") - F.col("pos")) / p
    return groups.agg(F.sum((F.col("neg") / q) * (tpr1 + tpr0) / 2).alias("roc_auc"), F.sum((F.col("pos") / p) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def best_threshold(groups: DataFrame, fpr_cap: float) -> DataFrame:
    """Best threshold whose false-positive rate is within the cap: recall, then precision, then the higher score."""
    r, pr = F.col("tp") / F.col("positives"), F.col("tp") / (F.col("tp") + F.col("fp"))
    g = groups.withColumns({"recall": r, "precision": pr, "fpr": F.col("fp") / F.col("negatives")}).filter(F.col("fpr") <= fpr_cap)
    return g.orderBy(F.desc("recall"), F.desc("precision"), F.desc("score")).limit(1).select("score", "recall", "precision", "fpr")


def histogram(df: DataFrame, by: list[str], score: str, bins: int) -> DataFrame:
    """Counts in equal bins of [0, 1]; values beyond are clipped, the last bin is closed."""
    b = F.least(F.greatest(F.floor(F.col(score) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def mean_histogram(hist: DataFrame, family: str, bins: int) -> DataFrame:
    """Mean share of each bin over families, 0 where a family has none."""
    share = F.col("n") / F.sum("n").over(W.partitionBy(family))
    families = hist.select(family).distinct()
    grid = families.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    j = grid.join(hist.withColumn("share", share), [family, "bin"], "left")
    return j.groupBy("bin").agg(F.avg(F.coalesce("share", F.lit(0.0))).alias("share"))


def higher_quantile(df: DataFrame, by: list[str], v: str, p: float) -> DataFrame:
    """The value at place ``ceil((n - 1) p)`` from 0 of the order: the "higher" rule, of all rows or of every group."""
    rows = df.filter(F.col(v).isNotNull())
    rows = rows.select(F.lit(0).alias("_all"), v) if not by else rows.select(*by, v)
    found = group_ranks(rows, by[0] if by else "_all", v, {"threshold": lambda n: math.ceil((n - 1) * p)}) if len(by) < 2 else None
    if found is None:  # many groups: each is ranked by itself
        w = W.partitionBy(*by)
        ranked = rows.withColumns({"_r": F.row_number().over(w.orderBy(v)) - 1, "_n": F.count("*").over(w)})
        found = ranked.filter(F.col("_r") == F.ceil((F.col("_n") - 1) * p)).select(*by, F.col(v).alias("threshold"))
    return found if by else found.drop("_all")


def threshold_surface(df: DataFrame, a: str, b: str, cuts_a: list[float], cuts_b: list[float], y: Column) -> DataFrame:
    """Rows of either class with both scores under every pair of cuts: one count by cell, then two cumulative windows."""
    idx = lambda c, cuts: sum((F.when(F.col(c) >= t, 1).otherwise(0) for t in cuts), F.lit(0))
    cells = df.groupBy(idx(a, cuts_a).alias("i"), idx(b, cuts_b).alias("j")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    grid = df.sparkSession.createDataFrame([(i, j) for i in range(len(cuts_a) + 1) for j in range(len(cuts_b) + 1)], "i int, j int")
    g = grid.join(cells, ["i", "j"], "left").na.fill(0)
    wj = W.partitionBy("i").orderBy("j").rowsBetween(W.unboundedPreceding, 0)
    wi = W.partitionBy("j").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    g = g.withColumns({"pos": F.sum("pos").over(wj), "neg": F.sum("neg").over(wj)})
    return g.select("i", "j", F.sum("pos").over(wi).alias("pos_below"), F.sum("neg").over(wi).alias("neg_below"))


def bootstrap_mean(df: DataFrame, key: str, v: str, draws: int) -> DataFrame:
    """Percentile interval of a mean: each replicate draws rows by a hash of replicate and place in the order of the numeric ``key``.

    Places come from chunks of the order, drawn rows are found by a join on their place, and a replicate is a grouped
    average; only the ``draws`` averages meet.
    """
    from .windows import running_sum

    n = df.count()
    r = running_sum(df.select(F.col(key).alias("_k"), F.col(v).alias("_v"), F.lit(1).cast("long").alias("_1")), "_k", "_1", 100_000).select((F.col("_upto") - 1).alias("_i"), "_v")
    pick = F.conv(F.substring(F.sha2(F.concat_ws(":", "rep", "_i"), 256), 1, 7), 16, 10).cast("long") % F.lit(max(n, 1))
    places = r.select("_i", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("rep")).select("rep", pick.alias("_j"))
    values = r.select(F.col("_i").alias("_j"), "_v")
    means = places.join(values, "_j").groupBy("rep").agg(F.avg("_v").alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.avg("m").alias("mean"), F.percentile("m", F.lit(0.975)).alias("high"))


def fusion_surface(df: DataFrame, flow: Column, a: str, b: str, cuts_a: list[float], cuts_b: list[float], role: str, family: str) -> DataFrame:
    """For every pair of cuts ``i, j``: ``fpr`` of benign rows, ``known_recall``, and ``unknown_recall``, the mean over held-out families.

    ``role`` is benign, known or unknown; ``flow`` tells whether the classifier fires. Benign and known rows alert by the
    classifier or either score at or over its cut; an unknown row is a candidate if the classifier is silent and both
    scores are. Rows are counted by cell once; pairs of cuts look at the cells only.
    """
    over = lambda c, cuts: sum((F.when(F.col(c) >= t, 1).otherwise(0) for t in sorted(cuts)), F.lit(0))
    cells = df.groupBy(F.col(role).alias("role"), F.col(family).alias("family"), flow.alias("fires"), over(a, cuts_a).alias("_a"), over(b, cuts_b).alias("_b")).agg(F.count("*").alias("n"))
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(len(cuts_a)) for j in range(len(cuts_b))])).alias("c")
    c = cells.select("role", "family", "fires", "_a", "_b", "n", pairs).select("*", "c.i", "c.j")
    up_a, up_b = F.col("_a") > F.col("i"), F.col("_b") > F.col("j")
    share = lambda on: F.sum(F.when(on, F.col("n")).otherwise(0)) / F.sum("n")
    by_role = c.filter("role <> 'unknown'").groupBy("i", "j").pivot("role", ["benign", "known"]).agg(share(F.col("fires") | up_a | up_b))
    unknown = c.filter("role = 'unknown'").groupBy("i", "j", "family").agg(share(~F.col("fires") & up_a & up_b).alias("r")).groupBy("i", "j").agg(F.avg("r").alias("unknown_recall"))
    return by_role.join(unknown, ["i", "j"], "left").select("i", "j", F.col("benign").alias("fpr"), F.col("known").alias("known_recall"), F.coalesce("unknown_recall", F.lit(0.0)).alias("unknown_recall"))


def best_pair(surface: DataFrame, fpr_cap: float) -> DataFrame:
    """The pair within the cap with most unknown recall, then most known recall, then the least false-positive rate."""
    return surface.filter(F.col("fpr") <= fpr_cap).orderBy(F.desc(F.round("unknown_recall", 12)), F.desc("known_recall"), "fpr", "i", "j").limit(1)


def cluster_bootstrap(df: DataFrame, stratum: str, cluster: str, y: Column, candidate: Column, baseline: Column, draws: int, chunk: int = 100_000) -> DataFrame:
    """F1, recall and false-positive rate of two decisions, their difference, and its interval when clusters are drawn anew within strata.

    Every replicate draws as many clusters of a stratum as there are, by a hash of replicate, stratum and place; both
    decisions see the same draws. ``cluster`` is numeric; its places are counted in two phases.
    """
    from .windows import creation_numbers

    cells = {f"{m}_{n}": F.count_if(t & p) for m, d in (("c", candidate), ("b", baseline)) for n, t, p in (("tn", ~y, ~d), ("fp", ~y, d), ("fn", y, ~d), ("tp", y, d))}
    g = df.groupBy(F.col(stratum).alias("_s"), F.col(cluster).alias("_c")).agg(*[c.alias(n) for n, c in cells.items()])
    g = creation_numbers(g, ["_s"], "_c", F.lit(True), chunk, "_i").withColumn("_i", F.col("_i") - 1)
    sizes = g.groupBy(F.col("_s").alias("_t")).agg(F.count("*").alias("_n"))
    each = g.select("_s", "_i").join(sizes, F.col("_s").eqNullSafe(F.col("_t"))).drop("_t").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    pick = F.conv(F.substring(F.sha2(F.concat_ws(":", "rep", F.col("_s").cast("string"), "_i"), 256), 1, 7), 16, 10).cast("long") % F.col("_n")
    drawn = each.select("rep", F.col("_s").alias("_ds"), pick.alias("_di")).join(g, F.col("_ds").eqNullSafe(F.col("_s")) & (F.col("_di") == F.col("_i")))
    total = [F.sum(n).cast("double").alias(n) for n in cells]

    def metrics(t: DataFrame) -> DataFrame:
        def of(m: str):
            tn, fp, fn, tp = (F.col(f"{m}_{n}") for n in ("tn", "fp", "fn", "tp"))
            return {"f1": safe_divide(2 * tp, 2 * tp + fp + fn), "recall": safe_divide(tp, tp + fn), "fpr": safe_divide(fp, fp + tn)}

        c, b = of("c"), of("b")
        return t.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), c[n].alias("candidate"), b[n].alias("baseline")) for n in c])).alias("m")).select("m.*")

    point = metrics(g.agg(*total)).withColumn("delta", F.col("candidate") - F.col("baseline"))
    spread = metrics(drawn.groupBy("rep").agg(*total)).withColumn("_d", F.col("candidate") - F.col("baseline"))
    spread = spread.groupBy("metric").agg(F.percentile("_d", F.lit(0.025)).alias("low"), F.percentile("_d", F.lit(0.975)).alias("high"))  # ``draws`` values each
    return point.join(spread, "metric")


def accepted(comparison: DataFrame, primary: str = "f1", least_recall_delta: float = -0.01, most_fpr_delta: float = 0.01) -> DataFrame:
    """Adds ``accepted``: the primary metric's interval lies above 0, and recall and false-positive rate stay within their safeguards."""
    d = lambda n, c: F.max(F.when(F.col("metric") == n, F.col(c)))
    ok = comparison.agg(((d(primary, "low") > 0) & (d("recall", "delta") >= least_recall_delta) & (d("fpr", "delta") <= most_fpr_delta)).alias("accepted"))
    return comparison.join(F.broadcast(ok))


def log_loss(df: DataFrame, by: list[str], p_true: Column, eps: float = 1e-15) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(-F.log(F.greatest(p_true, F.lit(eps)))).alias("log_loss"))


def deviating_features(reference: DataFrame, errors: DataFrame, group: Column, features: list[str], k: int) -> DataFrame:
    """For every error group, the features whose mean lies most standard deviations from the reference mean."""
    ref = reference.select(*features).unpivot([], features, "feature", "v").groupBy("feature").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    err = errors.select(group.alias("grp"), *features).unpivot(["grp"], features, "feature", "v").groupBy("grp", "feature").agg(F.avg("v").alias("em"))
    j = err.join(F.broadcast(ref), "feature").withColumn("sigmas", safe_divide(F.abs(F.col("em") - F.col("m")), F.col("s")))
    return top_per_group(j, ["grp"], [F.desc("sigmas"), F.asc("feature")], k).select("grp", "feature", "sigmas")


def histogram_overlap(df: DataFrame, side: str, v: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Shared area of two sides' normalised histograms."""
    b = F.least(F.greatest(F.floor((F.col(v) - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1))
    h = df.groupBy(F.col(side).alias("_s"), b.alias("_b")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("_s"))
    g = h.withColumn("share", share).groupBy("_b").agg(F.min("share").alias("least"), F.count("*").alias("sides"))
    return g.agg(F.coalesce(F.sum(F.when(F.col("sides") == 2, F.col("least"))), F.lit(0.0)).alias("overlap"))


#: Causes of errors.
CAUSES = ("threshold", "drift", "overlap", "mixed")


def error_groups(df: DataFrame, y: Column, p: Column, probability: Column, group: str, features: list[str], k: int = 3, bins: int = 30, least: int = 1) -> DataFrame:
    """False positives and negatives by group: size, share, confidence, and how far their most deviating features overlap with the class they were taken for.

    A group's features are ranked by the distance of its mean from that of correct rows of its own class, in their
    deviations; the overlap is the mean shared area of histograms with correct rows of the other class over the ``k``
    first. Groups and features are few; rows are only counted. Errors near the threshold speak for the threshold,
    confident ones without overlap for drift, overlap for itself.
    """
    cell = F.when(~y & p, "FP").when(y & ~p, "FN").when(y, "TP").otherwise("TN")
    rows = df.select(cell.alias("cell"), F.when(cell.isin("FP", "FN"), F.col(group)).alias("grp"), probability.alias("prob"), *[F.col(f).cast("double").alias(f) for f in features])
    long = rows.unpivot(["cell", "grp"], features, "feature", "v")
    stats = long.groupBy("cell", "grp", "feature").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    err = stats.filter(F.col("cell").isin("FP", "FN") & (F.col("n") >= least))
    of = lambda fp, fn: F.when(F.col("cell") == "FP", fp).otherwise(fn)
    ref = stats.filter(F.col("cell").isin("TP", "TN")).select(F.col("cell").alias("c"), F.col("feature").alias("f"), F.col("m").alias("rm"), F.col("s").alias("rs"), F.col("lo").alias("rlo"), F.col("hi").alias("rhi"))
    own = ref.select(F.col("c").alias("c1"), F.col("f").alias("f1"), "rm", "rs")
    other = ref.select(F.col("c").alias("c2"), F.col("f").alias("f2"), "rlo", "rhi")
    j = err.join(own, (F.col("c1") == of("TN", "TP")) & (F.col("f1") == F.col("feature")), "left").join(other, (F.col("c2") == of("TP", "TN")) & (F.col("f2") == F.col("feature")), "left")
    sigmas = F.abs(F.col("m") - F.col("rm")) / (F.col("rs") + 1e-9)
    w = W.partitionBy("cell", "grp").orderBy(F.desc_nulls_last("sigmas"), "feature")
    top = j.withColumn("sigmas", sigmas).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    top = top.select("cell", "grp", "feature", "sigmas", "c2", F.least("lo", "rlo").alias("a"), F.greatest("hi", "rhi").alias("b"))
    few = F.broadcast(top)  # groups x k rows
    bin_ = F.least(F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1))
    mine = long.join(few, ["cell", "grp", "feature"]).select("cell", "grp", "feature", "v", "a", "b", F.lit(0).alias("side"))
    theirs = long.drop("grp").withColumnRenamed("cell", "c3").join(F.broadcast(top.withColumnRenamed("feature", "f3")), (F.col("c3") == F.col("c2")) & (F.col("feature") == F.col("f3")))
    theirs = theirs.select("cell", "grp", "feature", "v", "a", "b", F.lit(1).alias("side"))
    h = mine.unionByName(theirs).filter("b > a").groupBy("cell", "grp", "feature", "side", bin_.alias("bin")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("cell", "grp", "feature", "side"))
    area = h.withColumn("share", share).groupBy("cell", "grp", "feature", "bin").agg(F.min("share").alias("both"), F.count("*").alias("sides")).filter("sides = 2").groupBy("cell", "grp", "feature").agg(F.sum("both").alias("area"))
    flat = top.select("cell", "grp", "feature", "sigmas", F.when(F.col("c2").isNull(), 0.0).when(F.col("b") <= F.col("a"), 1.0).alias("known"))
    overlap = flat.join(area, ["cell", "grp", "feature"], "left").groupBy("cell", "grp").agg(F.avg(F.coalesce("known", "area", F.lit(0.0))).alias("overlap"), F.max_by("feature", "sigmas").alias("top_feature"), F.max("sigmas").alias("top_sigmas"))
    pr = F.col("prob")
    near = of((pr > 0.5) & (pr <= 0.65), (pr >= 0.35) & (pr < 0.5))
    sure = of(pr > 0.8, pr < 0.2)
    conf = rows.filter(F.col("cell").isin("FP", "FN")).groupBy("cell", "grp").agg(F.count("*").alias("n"), F.avg("prob").alias("mean_prob"), F.avg(near.cast("double")).alias("boundary"), F.avg(sure.cast("double")).alias("confident"))
    out = conf.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("cell"))).filter(F.col("n") >= least).join(overlap, ["cell", "grp"])
    cause = F.when(F.col("boundary") >= 0.5, CAUSES[0]).when((F.col("confident") >= 0.5) & (F.col("overlap") < 0.5), CAUSES[1]).when(F.col("overlap") >= 0.5, CAUSES[2]).otherwise(CAUSES[3])
    return out.select(F.col("cell").alias("error"), F.col("grp").alias(group), "n", "share", "mean_prob", "boundary", "confident", "overlap", "top_feature", "top_sigmas", cause.alias("cause"))


def threshold_scan(df: DataFrame, profile: str, truth: str, score: str, family: str, classes: list[str], targets: list[str], fpr_cap: float, least_support: int = 1) -> DataFrame:
    """Per profile, the attack score at which a gated classifier is best within the false-positive cap, and its measures.

    Rows at or over a threshold take their ``family`` (never ``classes[0]``, the benign one), others are benign.
    Thresholds are the distinct scores; measures come from running counts by score, highest first: totals of coarse
    score ranges, then a window inside each. Best is the greatest least F1 of ``targets``, then macro F1 (of classes with
    ``least_support``), attack recall, the least false-positive rate, the highest threshold.
    """
    benign, attacks = classes[0], classes[1:]
    cells = {"all": F.count("*"), "neg": F.count_if(F.col(truth) == benign)}
    for n, c in enumerate(attacks):
        cells |= {f"p{n}": F.count_if(F.col(family) == c), f"t{n}": F.count_if((F.col(family) == c) & (F.col(truth) == c))}
    g = df.groupBy(profile, F.col(score).alias("threshold")).agg(*[c.alias(k) for k, c in cells.items()]).withColumn("_b", F.floor(F.col("threshold") * 1000))
    ranges = g.groupBy(F.col(profile).alias("_p"), F.col("_b").alias("_c")).agg(*[F.sum(k).alias(f"r_{k}") for k in cells])
    before = W.partitionBy("_p").orderBy(F.desc("_c")).rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("_p", "_c", *[F.coalesce(F.sum(f"r_{k}").over(before), F.lit(0)).alias(f"r_{k}") for k in cells])
    inside = W.partitionBy(profile, "_b").orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    run = g.join(ranges, F.col(profile).eqNullSafe(F.col("_p")) & (F.col("_b") == F.col("_c"))).select(profile, "threshold", *[(F.col(f"r_{k}") + F.sum(k).over(inside)).cast("double").alias(k) for k in cells])
    size = df.groupBy(F.col(profile).alias("_p")).agg(F.count("*").cast("double").alias("n"), *[F.count_if(F.col(truth) == c).cast("double").alias(f"s{k}") for k, c in enumerate(classes)])
    run = run.join(F.broadcast(size), F.col(profile).eqNullSafe(F.col("_p"))).drop("_p")
    correct = {benign: F.col("s0") - F.col("neg")} | {c: F.col(f"t{n}") for n, c in enumerate(attacks)}
    said = {benign: F.col("n") - F.col("all")} | {c: F.col(f"p{n}") for n, c in enumerate(attacks)}
    support = {c: F.col(f"s{k}") for k, c in enumerate(classes)}
    f1 = {c: safe_divide(2 * correct[c], said[c] + support[c]) for c in classes}
    enough = {c: support[c] >= least_support for c in classes}
    count = sum((F.when(enough[c], 1).otherwise(0) for c in classes), F.lit(0))
    macro = sum((F.when(enough[c], f1[c]).otherwise(0.0) for c in classes), F.lit(0.0)) / F.when(count > 0, count)
    least = F.least(*[f1[c] for c in targets]) if len(targets) > 1 else f1[targets[0]]
    measures = {"least_target_f1": least, "macro_f1": macro, "attack_recall": safe_divide(F.col("all") - F.col("neg"), F.col("n") - F.col("s0")), "fpr": safe_divide(F.col("neg"), F.col("s0"))}
    measures |= {f"precision_{c}": safe_divide(correct[c], said[c]) for c in targets} | {f"recall_{c}": safe_divide(correct[c], support[c]) for c in targets}
    ok = run.select(profile, "threshold", *[m.alias(k) for k, m in measures.items()]).filter(F.col("fpr") <= fpr_cap + 1e-15)
    return top_per_group(ok, [profile], [F.desc("least_target_f1"), F.desc("macro_f1"), F.desc("attack_recall"), F.asc("fpr"), F.desc("threshold")], 1)


def eligible_profiles(scans: DataFrame, profile: str, sizes: dict[str, int], targets: list[str], precision: float, recall: float, recall_drop: float, macro_drop: float, target_drop: float) -> DataFrame:
    """Which profiles pass the gates (of targets' precision and recall, and of losses against the best profile), and the smallest that does."""
    best = scans.agg(*[F.max(c).alias(f"_{c}") for c in ("attack_recall", "macro_f1", "least_target_f1")])
    gates = [(F.col(f"precision_{c}") < precision, f"{c}:precision") for c in targets] + [(F.col(f"recall_{c}") < recall, f"{c}:recall") for c in targets]
    gates += [(F.col(c) < F.col(f"_{c}") - drop, n) for c, drop, n in (("attack_recall", recall_drop, "attack_recall_drop"), ("macro_f1", macro_drop, "macro_f1_drop"), ("least_target_f1", target_drop, "target_f1_drop"))]
    reasons = F.array_compact(F.array(*[F.when(bad, name) for bad, name in gates]))
    size = F.create_map(*[F.lit(x) for item in sizes.items() for x in item])
    j = scans.join(F.broadcast(best)).select(*scans.columns, reasons.alias("reasons"), F.try_element_at(size, F.col(profile)).alias("features")).withColumn("eligible", F.size("reasons") == 0)
    chosen = j.filter("eligible").agg(F.min(F.struct("features", profile)).alias("_c"))
    return j.join(F.broadcast(chosen)).withColumn("selected", F.coalesce(F.col("_c")[profile] == F.col(profile), F.lit(False))).drop("_c")
