"""Exact quantiles by narrowing, out-of-fold scores, and the block allocator, against slow versions."""

import hashlib
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidflow.operators import splits
from braidflow.operators.quantiles import exact_quantiles, order_statistics
from braidflow.sources.shared import new_path

SHARES = (0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0)


@pytest.mark.parametrize("few", [10, 20_000])
def test_exact_quantiles(spark, few):
    rng = np.random.default_rng(1)
    heavy = np.concatenate([np.zeros(3000), rng.random(40), np.ones(3000)])
    cols = {"normal": rng.normal(0, 1, 6040), "heavy": heavy, "same": np.full(6040, 7.0), "whole": rng.integers(0, 9, 6040).astype(float)}
    df = spark.createDataFrame([(*map(float, r), None) for r in zip(*cols.values(), strict=True)], ", ".join(f"{c} double" for c in cols) + ", none double")
    targets = [(c, q) for c in cols for q in SHARES]
    got = exact_quantiles(df, targets, few)
    assert got == pytest.approx([float(np.quantile(cols[c], q)) for c, q in targets], abs=1e-12)
    assert exact_quantiles(df, [("none", 0.5)], few) == [None]
    ranks = [("heavy", k) for k in (0, 2999, 3000, 3020, 3039, 3040, 6039)]
    assert list(order_statistics(df, ranks, {"heavy": 6040}, few).values()) == [float(np.sort(heavy)[k]) for _, k in ranks]


def slow_allocate(counts, ratios, seed, fixed=()):
    """Greedy placement of blocks, one capture and one block at a time."""
    out = {}
    for capture in sorted({c for c, *_ in counts}):
        blocks, labels = {}, sorted({la for c, _, la, _ in counts if c == capture})
        for c, b, la, n in counts:
            if c == capture:
                blocks.setdefault(b, dict.fromkeys(labels, 0))[la] += n
        totals = {la: sum(x[la] for x in blocks.values()) for la in labels}
        goal = {p: {la: totals[la] * r for la in labels} for p, r in ratios.items()}
        have = {p: dict.fromkeys(labels, 0) for p in ratios}
        for (c, b), p in dict(fixed).items():
            if c == capture and b in blocks:
                have[p] = {la: have[p][la] + blocks[b][la] for la in labels}
                out[c, b] = (p, "inherited")

        def off(p, extra):
            new = {la: have[p][la] + extra[la] for la in labels}
            total, want = sum(new.values()), sum(goal[p].values())
            return ((total - want) / max(want, 1)) ** 2 + sum(((new[la] - goal[p][la]) / (goal[p][la] or 1)) ** 2 for la in labels)

        def rank(b):
            x = blocks[b]
            return (-max(x[la] / (totals[la] or 1) for la in labels), -sum(x.values()), hashlib.sha256(f"{seed}|{capture}|{b}".encode()).hexdigest()[:16], b)

        for b in sorted((b for b in blocks if (capture, b) not in out), key=rank):
            none = dict.fromkeys(labels, 0)
            best = min(ratios, key=lambda p: off(p, blocks[b]) - off(p, none))
            have[best] = {la: have[best][la] + blocks[b][la] for la in labels}
            out[capture, b] = (best, "allocated")
    return out


def test_allocator_equals_slow_version(spark):
    rng = np.random.default_rng(9)
    counts = [(f"c{c}", int(b), la, int(rng.integers(1, 50))) for c in range(3) for b in range(25) for la in ("benign", "dos", "bot") if rng.random() < 0.7]
    df = spark.createDataFrame(counts, "capture_id string, block long, label string, n long")
    ratios = {"train": 0.7, "validation": 0.1, "test": 0.2}
    got = {(r["capture_id"], r["block"]): (r["partition"], r["source"]) for r in splits.allocate(df, ratios, 3607).collect()}
    assert got == slow_allocate(counts, ratios, 3607)
    fixed = {k: p for k, (p, _) in got.items() if k[1] < 9}
    f = spark.createDataFrame([(*k, p) for k, p in fixed.items()], "capture_id string, block long, partition string")
    again = {(r["capture_id"], r["block"]): (r["partition"], r["source"]) for r in splits.allocate(df, ratios, 11, f).collect()}
    assert again == slow_allocate(counts, ratios, 11, fixed)


def test_shared_folder_is_the_applications(spark):
    path = new_path(spark, "x")
    assert spark.sparkContext.applicationId in path and path != new_path(spark, "x") and uuid.UUID(path.split("-")[-1])
