"""Label joins and evaluation on small hand-made tables."""

import numpy as np
from pyspark.sql import functions as F

from braidflow.operators import evaluate, evidence, harmonise, labels, quality

EDGE = "flow_id long, label_id long, required long, schedule_conflict boolean, role_conflict boolean"


def test_sweep(spark):
    e = spark.createDataFrame([(1, 10, 0, False, False), (2, 11, 0, False, False), (2, 12, 0, False, False), (4, 13, 0, True, False)], EDGE)
    n = lambda k: spark.createDataFrame([(k,)], "n long")
    r = labels.sweep(e, n(4), n(5), [0]).first()
    assert (r["matched"], r["flow_unmatched"], r["flow_ambiguous"], r["flow_conflict"]) == (1, 1, 1, 1)
    assert (r["label_unmatched"], r["label_ambiguous"], r["label_conflict"]) == (1, 2, 1)


def test_consensus(spark):
    e = [(1, 1), (2, 2), (2, 2), (2, 3), (3, 4), (3, 5), (6, 7), (7, 7), (8, 8)]
    rows = [(f, la, 0, False, False) for f, la in e] + [(4, 6, 0, True, False), (8, 9, 0, False, True)]
    names = {1: "BENIGN", 2: "DoS Hulk", 3: "DoS Hulk", 4: "Bot", 5: "DDoS", 6: "Web Attack", 7: "PortScan", 8: "BENIGN", 9: "Bot"}
    got = labels.consensus(
        spark.createDataFrame([(k,) for k in range(1, 9)], "flow_id long"), spark.createDataFrame(rows, EDGE), spark.createDataFrame(list(names.items()), "label_id long, label string"), 0
    )
    m = {r["flow_id"]: r["method"] for r in got.collect()}
    assert m == {1: "mutual_unique", 8: "mutual_unique", 2: "class_consensus", 6: "class_consensus", 7: "class_consensus", 3: "mixed_candidate_classes", 4: "audit_conflict", 5: "no_eligible_candidate"}


def test_edges_at_the_tolerance(spark):
    f = spark.createDataFrame([(1, "k", 100, 200)], "flow_id long, k string, start long, end long")
    la = spark.createDataFrame([(1, "k", 210, 220), (2, "k", 211, 220), (3, "k", 80, 91), (4, "k", 80, 90), (5, "k", 150, 151), (6, "x", 150, 151)], "label_id long, k string, lo long, hi long")
    got = {r["label_id"]: r["required"] for r in labels.candidate_edges(f, la, ["k"], 10, 16).collect()}
    assert got == {1: 10, 3: 10, 5: 0}


def test_covers_are_small_and_whole(spark):
    rng = np.random.default_rng(3)
    spans = [(0, 0), (-1, 0), (-7, 9), (5, 4), *[(int(a), int(a + n)) for a, n in zip(rng.integers(-500, 500, 60), rng.integers(0, 700, 60), strict=True)], (-3, 10**6)]
    df = spark.createDataFrame(spans, "a long, z long").select("a", "z", labels.cover(F.col("a"), F.col("z"), 22).alias("n"))
    for r in df.collect():
        held = [b for x in r["n"] for b in (range(x["node"] << x["level"], (x["node"] + 1) << x["level"]) if r["z"] - r["a"] < 2000 else ())]
        if r["z"] - r["a"] < 2000:
            assert sorted(held) == list(range(r["a"], r["z"] + 1))
        assert sum(1 << x["level"] for x in r["n"]) == max(r["z"] - r["a"] + 1, 0)
        assert len(r["n"]) <= 2 * max((r["z"] - r["a"] + 1), 1).bit_length()


def test_edges_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    f = [(k, "kl"[k % 2], int(a), int(a + n)) for k, (a, n) in enumerate(zip(rng.integers(-900, 900, 80), rng.integers(0, 60, 80), strict=True))]
    la = [(k, "kl"[k % 2], int(a), int(a + n)) for k, (a, n) in enumerate(zip(rng.integers(-900, 900, 60), rng.choice([1, 20, 300, 5000], 60), strict=True))]
    got = labels.candidate_edges(spark.createDataFrame(f, "flow_id long, k string, start long, end long"), spark.createDataFrame(la, "label_id long, k string, lo long, hi long"), ["k"], 10, 16)
    want = [(i, j, lo - e if e < lo else s - hi + 1 if hi <= s else 0) for i, a, s, e in f for j, b, lo, hi in la if a == b and e + 10 >= lo and hi + 10 > s]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    none = labels.candidate_edges(spark.createDataFrame(f, "flow_id long, k string, start long, end long"), spark.createDataFrame([], "label_id long, k string, lo long, hi long"), ["k"], 10, 16)
    assert none.count() == 0


def test_codes_by_first_appearance(spark):
    values = ["b", None, "a", "b", "nan", "c", "a"]
    df = spark.createDataFrame([(7 * k - 20, v) for k, v in enumerate(values)], "at long, v string")
    assert [r["code"] for r in harmonise.factorize(df, "v", "at").orderBy("at").collect()] == [0, 1, 2, 0, 1, 3, 2]
    assert harmonise.factorize(df.filter("false"), "v", "at").count() == 0


def test_differences_count_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x long")
    r = quality.differences(a, spark.createDataFrame([(1,), (3,)], "x long")).first()
    assert (r["left_only"], r["right_only"]) == (2, 1)


def test_curves(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, True), (0.7, False), (0.6, True), (0.1, False)], "s double, y boolean")
    r = evaluate.curve_areas(evaluate.score_groups(df, "s", F.col("y"))).first()
    assert abs(r["roc_auc"] - 5 / 6) < 1e-9


def test_higher_quantile(spark):
    df = spark.createDataFrame([(float(k),) for k in range(1, 5)], "v double")
    assert evaluate.higher_quantile(df, [], "v", 0.5).first()["threshold"] == 3.0


def test_segments(spark):
    a = spark.createDataFrame([("l", k, "dos") for k in (1, 5, 9, 30)], "log string, line long, candidate string")
    s = spark.createDataFrame([("l", 1, 2, 6, ["dos"]), ("l", 2, 8, 10, ["bot"])], "log string, segment long, from_line long, to_line long, allowed array<string>")
    got = {r["line"]: r["verdict"] for r in evidence.by_segment(a, s, "line", "candidate").collect()}
    assert got == {1: "uncovered", 5: "expected", 9: "unexpected", 30: "uncovered"}


def test_salted_join_equals_plain_join(spark):
    from braidflow.operators.skew import salted_join

    a = spark.createDataFrame([("hot" if k % 3 else f"k{k}", k % 2, k) for k in range(300)], "k string, b int, i long")
    b = spark.createDataFrame([("hot", 0, 1), ("hot", 1, 2), ("hot", 1, 2), ("k3", 1, 3), ("none", 0, 4)], "k string, b int, v long")
    want = sorted(map(tuple, a.join(b, ["k", "b"]).collect()))
    for least in (10, 10**6):
        got = salted_join(a, b, ["k", "b"], "i", least=least, salts=4)
        assert got.columns == ["k", "b", "i", "v"] and sorted(map(tuple, got.collect())) == want
