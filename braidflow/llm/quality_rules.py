"""Learned decision lists over document statistics (Spark expressions only).

Sequential covering: grow one conjunction of threshold tests by information gain on the growing part of the labelled
statistics, prune its last tests on the other part, accept it if it is precise enough, take away the rows it covers,
and begin again. The list becomes one ordered ``CASE`` expression, so that applying it is a projection.

Defined results: null text has no words; no labelled rows, or only one class, gives an empty list (keep everything that
passes the base test); labels that occur twice count twice; extra columns of ``docs`` are left alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, broadcast_if, written
from .doc_stats import FEATURES, bin_of, thresholds, with_stats


@dataclass(frozen=True)
class Test:
    """``feature > cut`` if ``above``, else ``feature <= cut``; ``rank`` is the cut's place among the feature's cuts."""

    feature: str
    rank: int
    cut: float
    above: bool

    def on_bins(self) -> Column:
        return F.col("b_" + self.feature) > self.rank if self.above else F.col("b_" + self.feature) <= self.rank

    def on_values(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature[2:]} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Params:
    """``sample_rows`` bounds the labelled documents that the list is learned from (a hash sample beyond it)."""

    sample_rows: int = 20_000
    max_rules: int = 8
    max_tests: int = 3
    least_precision: float = 0.9
    least_support: int = 5
    bins: int = 24


def _all(tests: list[Test]) -> Column:
    return reduce(lambda a, b: a & b, (t.on_bins() for t in tests), F.lit(True))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gain of going from (p0, n0) to (p, n) covered rows of the two classes."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _grow(rows: DataFrame, cuts: dict[str, list[float]], params: Params, tried: frozenset[str] = frozenset()) -> list[Test]:
    """A conjunction that does not begin with a feature of ``tried``."""
    tests: list[Test] = []
    while len(tests) < params.max_tests:
        names = [f for f in FEATURES if cuts[f] and (tests or f not in tried)]
        if not names:
            break
        long = rows.filter(_all(tests) & F.col("grows")).unpivot(["y"], ["b_" + f for f in names], "feature", "bin")
        counts: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in names}
        for r in long.groupBy("feature", "bin").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).collect():  # features x bins rows
            counts[r["feature"][2:]][r["bin"]] = (r["p"], r["n"])
        p0, n0 = (sum(v[k] for v in counts[names[0]].values()) for k in (0, 1))
        if not p0 or not n0:
            break
        best, found = 1e-9, None
        for f in names:
            p = n = 0
            for rank, cut in enumerate(cuts[f]):
                p, n = p + counts[f].get(rank, (0, 0))[0], n + counts[f].get(rank, (0, 0))[1]
                for above, (cp, cn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    if cp >= params.least_support and (g := _gain(cp, cn, p0, n0)) > best:
                        best, found = g, Test(f, rank, cut, above)
        if found is None:
            break
        tests.append(found)
    return tests


def _prune(rows: DataFrame, tests: list[Test]) -> tuple[list[Test], int, int]:
    """The prefix with the best share on the pruning part, and what it covers there."""
    held = rows.filter(~F.col("grows"))
    aggs = [F.sum(F.when(_all(tests[:k]), v).otherwise(0)).alias(f"{c}{k}") for k in range(1, len(tests) + 1) for c, v in (("p", F.col("y")), ("n", 1 - F.col("y")))]
    r = held.agg(*aggs).first()
    worth = lambda k: ((r[f"p{k}"] or 0) + 1) / ((r[f"p{k}"] or 0) + (r[f"n{k}"] or 0) + 2)
    k = max(range(1, len(tests) + 1), key=lambda k: (round(worth(k), 3), -k))
    return tests[:k], r[f"p{k}"] or 0, r[f"n{k}"] or 0


def _widen(rows: DataFrame, tests: list[Test]) -> list[Test]:
    """The same tests with each cut moved to the middle of the gap between the rows on its two sides.

    A cut is a quantile, so it lies on a value that was seen; the middle leaves the same room to either side.
    """
    r = rows.filter(_all(tests)).agg(*[(F.min if t.above else F.max)(F.when(F.col("y") == 1, F.col(t.feature))).alias(f"in{k}") for k, t in enumerate(tests)]).first()
    out = []
    for k, t in enumerate(tests):
        beyond = rows.filter(_all([x for x in tests if x is not t]) & ~t.on_bins())
        edge = beyond.agg((F.max if t.above else F.min)(t.feature)).first()[0]
        out.append(t if edge is None or r[f"in{k}"] is None else Test(t.feature, t.rank, (edge + r[f"in{k}"]) / 2, t.above))
    return out


def learn(labelled: DataFrame, params: Params = Params()) -> list[list[Test]]:
    """Rules, in order, for documents with ``y = 1`` (to reject), from rows of features and ``y``.

    The loop runs on the driver, over counts of at most ``features x bins`` rows for each step; the rows stay in Spark.
    """
    cuts = thresholds(labelled, params.bins)
    if not any(cuts.values()):
        return []
    binned = labelled.select(
        F.col("y").cast("long").alias("y"), (F.pmod(F.xxhash64(*FEATURES), F.lit(3)) != 0).alias("grows"), *FEATURES, *[bin_of(f, cuts[f]).alias("b_" + f) for f in FEATURES]
    )
    rows = written(binned.coalesce(1), "rules-binned")  # a bounded sample: one partition needs no exchanges
    rules: list[list[Test]] = []
    tried: frozenset[str] = frozenset()
    while len(rules) < params.max_rules:
        tests = _grow(rows, cuts, params, tried)
        if not tests:
            break
        first = tests[0].feature
        tests, p, n = _prune(rows, tests)
        if 2 * p < params.least_support or p / max(p + n, 1) < params.least_precision:
            tried |= {first}  # begin with another feature
            continue
        tried = frozenset()
        rules.append(_widen(rows, tests))
        rows = rows.filter(~_all(tests))
    return rules


def verdict(rules: list[list[Test]]) -> Column:
    """The ordered ``CASE``: the text of the first rule that fires, else null (keep)."""
    out = F.lit(None).cast("string")
    for tests in reversed(rules):
        out = F.when(reduce(lambda a, b: a & b, (t.on_values() for t in tests)), F.lit(" and ".join(map(str, tests)))).otherwise(out)
    return out


def labelled_stats(docs: DataFrame, labels: DataFrame, params: Params) -> DataFrame:
    """Statistics of a bounded sample of the labelled documents, with ``y = 1`` for quality 0."""
    known = bounded_sample(labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality"), "doc_id", params.sample_rows)
    texts = docs.select("doc_id", "text").join(broadcast_if(known, 4 * params.sample_rows), "doc_id")  # texts stay where they are
    stats = with_stats(texts).select((1 - F.col("quality")).cast("int").alias("y"), *FEATURES)
    return written(stats, "rules-sample")


def apply_rules(docs: DataFrame, rules: list[list[Test]], min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """``docs`` with statistics, ``base_failed``, the fired ``rule`` and ``kept``."""
    s = with_stats(docs)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return s.withColumns({"base_failed": failed, "rule": verdict(rules)}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """Learns the list from ``labels`` and applies it to every document."""
    return apply_rules(docs, learn(labelled_stats(docs, labels, params), params))
