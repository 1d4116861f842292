"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence is a log likelihood ratio over binned statistics, learned from labelled documents and
tempered on them. Host posteriors come from the evidence of all of a host's documents, shrunk toward the global share;
path posteriors are shrunk toward their host's. The strength of either shrinkage is estimated from the spread of the
shares themselves (method of moments), so that sparse sites stay near their prior and large ones speak for themselves.
A document's posterior is its path's prior odds times its own evidence.

Sites are sums of partial sums, so a host with a third of all rows costs no more than others. The path table is
broadcast if it is small (checked); otherwise the join is a shuffle in which each path is dealt over several salts.
Defined results: null text counts as empty; null host or path is a site of its own; without labels of both classes the
evidence is 0 and every document is kept; rows that repeat a ``doc_id`` are judged one by one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, broadcast_if, small_enough, written
from .doc_stats import FEATURES, bin_of, thresholds, with_stats

BROADCAST_ROWS = 20_000
SALTS = 32


@dataclass(frozen=True)
class Model:
    """Cut points and log likelihood ratios of each feature's bins, the scale that tempers their sum, the global share."""

    cuts: dict[str, list[float]]
    ratios: dict[str, list[float]]
    scale: float
    share: float


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, bins: int = 16) -> Model:
    """Learns the evidence from at most about ``sample_rows`` labelled documents (a hash sample)."""
    known = bounded_sample(labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality"), "doc_id", sample_rows)
    stats = with_stats(docs.select("doc_id", "text").join(broadcast_if(known, 4 * sample_rows), "doc_id")).select(F.col("quality").cast("int").alias("y"), *FEATURES).persist()
    try:
        cuts = thresholds(stats, bins)
        binned = stats.select("y", *[bin_of(f, cuts[f]).alias(f) for f in FEATURES])
        counts = binned.unpivot(["y"], list(FEATURES), "feature", "bin").groupBy("feature", "bin").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad")).collect()
        good = sum(r["good"] for r in counts) / max(len(FEATURES), 1)
        bad = sum(r["bad"] for r in counts) / max(len(FEATURES), 1)
        if not good or not bad:
            return Model(cuts, {f: [0.0] * (len(cuts[f]) + 1) for f in FEATURES}, 1.0, 0.5)
        ratios = {f: [0.0] * (len(cuts[f]) + 1) for f in FEATURES}
        for r in counts:
            n = len(ratios[r["feature"]])
            ratios[r["feature"]][r["bin"]] = math.log((r["good"] + 1) / (good + n)) - math.log((r["bad"] + 1) / (bad + n))
        share = good / (good + bad)
        scales = (1.0, 0.7, 0.5, 0.35, 0.25)
        e = evidence(Model(cuts, ratios, 1.0, share))
        loss = lambda s: F.avg(F.log1p(F.exp(F.greatest(F.least((1 - 2 * F.col("y")) * (e * s + _logit(share)), F.lit(30.0)), F.lit(-30.0)))))
        row = stats.agg(*[loss(s).alias(str(k)) for k, s in enumerate(scales)]).first()
        return Model(cuts, ratios, scales[min(range(len(scales)), key=lambda k: row[k])], share)
    finally:
        stats.unpersist()


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def evidence(model: Model) -> Column:
    """Tempered log likelihood ratio of good against bad from the feature columns."""

    def of(f: str) -> Column:
        out = F.lit(model.ratios[f][-1])
        for cut, ratio in reversed(list(zip(model.cuts[f], model.ratios[f], strict=False))):
            out = F.when(F.col(f) <= cut, ratio).otherwise(out)
        return out

    return model.scale * reduce(lambda a, b: a + b, map(of, FEATURES))


def _strength(sites: DataFrame, prior: Column, default: float = 10.0) -> float:
    """Pseudo-observations of the prior, from the spread of site shares around it beyond sampling noise."""
    share = F.col("s") / F.col("n")
    r = sites.agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (share - prior) * (share - prior)).alias("spread"), F.sum(F.col("n") * prior * (1 - prior)).alias("var")
    ).first()
    if not r["n"] or not r["var"] or r["k"] < 2:
        return default
    noise = r["k"] * (r["var"] / r["n"]) / r["n"]  # expected spread if all sites shared their prior
    between = max(r["spread"] / r["n"] - noise, 1e-6)
    return min(max(r["var"] / r["n"] / between - 1, 1.0), 1e4)


def site_shares(scored: DataFrame, share: float) -> DataFrame:
    """``host, path, share`` from rows of ``host, path, p`` (each document's own posterior); the rows are read once."""
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    k = _strength(hosts, F.lit(share))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("s") + k * share) / (F.col("n") + k)).alias("host_share"))
    with_host = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k2 = _strength(with_host, F.col("host_share"))
    return with_host.select("host", "path", ((F.col("s") + k2 * F.col("host_share")) / (F.col("n") + k2)).alias("share"))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, carry: list[str] | None = None, least: float = 0.1, sample_rows: int = 20_000) -> DataFrame:
    """Columns ``carry`` of ``docs`` (all by default) as one struct column ``doc``, with ``evidence, site_share, p_good`` and ``kept``.

    ``least`` is low, so that only documents with clear evidence against them go. Texts are read twice, for the sites
    and for the result; without ``text`` in ``carry`` the scored rows are narrow and written, and texts are read once.
    """
    carry = docs.columns if carry is None else carry
    model = fit(docs, labels, sample_rows)
    packed = docs.select(F.struct(*carry).alias("doc"), host.alias("_host"), path.alias("_path"), "text")
    scored = with_stats(packed).select("doc", "_host", "_path", evidence(model).alias("evidence"))
    if "text" not in carry:
        scored = written(scored, "scored")
    own = F.lit(1.0) / (1 + F.exp(-(F.col("evidence") + _logit(model.share))))
    shares = written(site_shares(scored.select(F.col("_host").alias("host"), F.col("_path").alias("path"), own.alias("p")), model.share), "sites")
    shares = shares.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("share").alias("site_share"))
    same = F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p"))
    if small_enough(shares, BROADCAST_ROWS):
        joined = scored.join(F.broadcast(shares), same)
    else:
        salted = shares.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = scored.withColumn("_s", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_s") == F.col("_t")))
    site = F.greatest(F.least(F.col("site_share"), F.lit(1 - 1e-6)), F.lit(1e-6))
    p = F.lit(1.0) / (1 + F.exp(-(F.col("evidence") + F.log(site / (1 - site)))))
    return joined.select("doc", "evidence", "site_share", p.alias("p_good"), (p >= least).alias("kept"))
