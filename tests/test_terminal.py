"""Features of closed flows on small captures with known values, and new rows of a rare class."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidflow.operators import evidence, features, flow_machine, models, windows

S = 10**9
SCHEMA = "cap string, flow long, place long, timestamp_ns long, direction string, protocol int, source_ip string, source_port int, destination_ip string, destination_port int, ttl long, tcp_flags int"


def vectors(spark, rows):
    p = spark.createDataFrame(rows, SCHEMA).withColumns({"wire_length": F.lit(60), "payload_length": F.lit(0), "header_length": F.lit(54), "tcp_window": F.lit(1000)})
    p = windows.with_flow_steps(windows.running_watermark(p, ["cap"], "place"), ["cap", "flow"], ["place"])
    v = features.terminal_vector(p, ["cap", "flow"], ["cap"], "place")
    assert v.columns == ["cap", "flow", *features.TERMINAL_NAMES] and len(features.TERMINAL_NAMES) == 70
    return {r["flow"]: [r[n] for n in features.TERMINAL_NAMES] for r in v.collect()}


# Packets and expected features of named cases.
def test_reset_and_timing(spark):
    a, b = ("c", 40000, "s", 21), ("s", 21, "c", 40000)
    v = vectors(spark, [("x", 1, 1, 1 * S, "forward", 6, *a, 64, 2), ("x", 1, 2, 2 * S, "reverse", 6, *b, 60, 16), ("x", 1, 3, 8 * S, "forward", 6, *a, 62, 20)])[1]
    assert (v[0], v[1], v[54], v[55], v[56]) == (7_000_000, 3, 6, 63, 60)
    assert (v[59], v[60], v[61], v[62], v[63], v[64], v[65], v[66]) == (500_000, 6_000_000, 1, 1, 1, 40000, 21, 1)
    assert sum(v[66:70]) == 1


def test_contexts_begin_anew_with_a_block(spark):
    rows = [("x", k, k, t * S, "forward", 17, "c", 50000 + k, "s", port, 64, None) for k, (t, port) in enumerate([(10, 80), (11, 80), (12, 81), (70, 80)], 1)]
    v = vectors(spark, rows)
    assert [tuple(v[k][61:64]) for k in (1, 2, 3, 4)] == [(1, 1, 1), (2, 2, 1), (1, 3, 2), (1, 1, 1)]
    assert all(v[k][54] == 17 and v[k][66:70] == [0, 0, 0, 1] for k in v)


def test_idle_boundary_is_strict(spark):
    rows = [("x", 1, 1, 1 * S, "forward", 6, "c", 1, "s", 22, 64, 2), ("x", 1, 2, 6 * S, "reverse", 6, "s", 22, "c", 1, 64, 16)]
    v = vectors(spark, rows)[1]
    assert (v[59], v[60]) == (5_000_000, 0) and v[66:70] == [0, 0, 1, 0]
    fins = [("x", 1, 1, S, "forward", 6, "c", 1, "s", 22, 64, 17), ("x", 1, 2, 2 * S, "reverse", 6, "s", 22, "c", 1, 64, 17)]
    assert vectors(spark, fins)[1][66:70] == [0, 1, 0, 0]


def test_simple_features(spark):
    rows = [
        ("x", "k", 1, 0, 2, 60, 100, "a", 443, 6, "1.1.1.1"), ("x", "k", 2, 2 * S, 16, 100, 200, "b", 5, 6, "9.9.9.9"), ("x", "k", 3, 2 * S, 24, 40, 300, "a", 443, 6, "1.1.1.1"), ("x", "k", 4, 3 * S, 17, 60, 1, "b", 5, 6, "9.9.9.9"),
        ("x", "k", 5, 4 * S, 16, 60, 1, "a", 443, 6, "1.1.1.1"), ("y", "k", 1, 0, 16, 60, 7, "a", 443, 6, "1.1.1.1"), ("y", "k", 2, S, None, 60, 7, "b", 443, 6, "1.1.1.1"), ("x", "dns", 1, 0, None, 60, 0, "a", 53, 17, "1.1.1.1"), ("x", "dns", 2, 1, None, 60, 0, "a", 53, 17, "1.1.1.1"),
    ]
    p = spark.createDataFrame(rows, "capture_id string, flow_key string, packet_index long, timestamp_ns long, tcp_flags int, wire_length long, tcp_window int, source string, destination_port int, protocol int, destination_ip string")
    got = {(r["capture_id"], r["flow_key"], r["flow"]): tuple(r)[3:] for r in flow_machine.simple_features(p).collect()}
    assert got == {
        ("x", "k", 1): (443.0, 3e6, 2.0, 100.0, 2.0, 160.0, 40.0, 65.0, 260 / 3, 1.0, 1.0, 1.0, 100.0, 1.5, 6.0, 0),
        ("y", "k", 1): (443.0, 1e6, 1.0, 60.0, 1.0, 60.0, 60.0, 60.0, 120.0, 0.0, 1.0, 0.0, 7.0, 1.0, 6.0, 0),
    }


def test_value_before_in_chunks(spark):
    rng = np.random.default_rng(4)
    rows = [(c, int(k), None if k % 5 == 0 else int(rng.integers(9))) for c in ("a", None) for k in sorted(rng.choice(100, 30, replace=False))]
    got = windows.value_before(spark.createDataFrame(rows, "c string, i long, v int"), ["c"], "i", "v", "b", chunk=7).collect()
    want = {(c, i): (rows[n - 1][2] if n and rows[n - 1][0] == c else None) for n, (c, i, _) in enumerate(rows)}
    assert {(r["c"], r["i"]): r["b"] for r in got} == want


def test_oversample_up_to_balance(spark):
    rng = np.random.default_rng(3)
    rare = [(float(x), float(y), 1) for x, y in rng.normal(0, 1, (40, 2))] + [(5.0, 5.0, 1)] * 3 + [(9.0, 9.0, 1)]
    rows = [(float(x), float(y), 0) for x, y in rng.normal(3, 1, (500, 2))] + rare
    df = spark.createDataFrame(rows, "a double, b double, y int")
    out = models.oversample(df, ["a", "b"], "y").collect()
    made = [(r["a"], r["b"]) for r in out if r["made"]]
    assert len(made) == 500 - len(rare) and sum(r["y"] for r in out) == 500
    points = np.array([r[:2] for r in rare])
    for p in made:  # each lies on a line between two rows of the class
        d = points[:, None] - points[None, :]
        t = np.clip(((points[:, None] - np.array(p)) * d).sum(-1) / np.maximum((d**2).sum(-1), 1e-300), 0, 1)
        assert np.abs(points[:, None] - t[..., None] * d - np.array(p)).sum(-1).min() < 1e-6
    assert models.oversample(df.filter("a < 4 and (y = 1 or a > 3.9)"), ["a", "b"], "y").filter("made").count() == 0


def test_near_neighbours_find_most_of_the_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (300, 2))
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "i long, a double, b double")
    got = {r["i"]: [n["other"] for n in r["near"]][:5] for r in models.near_neighbours(df, ["a", "b"], "i").collect()}
    z = x / x.std(axis=0)
    d = ((z[:, None] - z[None, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert len(got) == 300 and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(np.argsort(d[k])[:5]) & set(v)) / 5 for k, v in got.items()]) > 0.7


def test_segments_on_several_logs(spark):
    s = spark.createDataFrame([("a", "s1", 1, 10, ["x"]), ("a", "s2", 20, 30, ["y"])], "log string, segment string, from_line long, to_line long, allowed array<string>")
    a = spark.createDataFrame([("a", 5, "x"), ("a", 11, "x"), ("a", 20, "x"), ("a", 30, "y"), ("b", 5, "x")], "log string, line long, candidate string")
    got = {(r["log"], r["line"]): r["verdict"] for r in evidence.by_segment(a, s, "line", "candidate").collect()}
    assert got == {("a", 5): "expected", ("a", 11): "uncovered", ("a", 20): "unexpected", ("a", 30): "expected", ("b", 5): "uncovered"}


def test_sensor_runs_of_single_lines(spark):
    lines = [
        ("a", 1, '{"event_type": "nids_dpdk_live_ready"}'), ("a", 2, ""), ("a", 3, "broken {"), ("a", 4, '{"event_type": "nids_alert", "decision": "unknown"}'),
        ("a", 5, '{"event_type": "nids_dpdk_live_summary", "packets_seen": 9, "packets_parsed": 8, "parser_errors": 1, "stop_reason": "signal"}'),
        ("a", 6, '{"event_type": "nids_alert", "decision": "known_attack", "evidence": {"known_family": {"top_candidate": "dos", "confidence": 0.5}}}'),
        ("a", 7, '{"event_type": "nids_dpdk_live_summary", "packets_seen": 12}'), ("b", 1, None), ("b", 2, "[1]"),
    ]
    df = spark.createDataFrame(lines, "log string, line int, text string").repartition(3)
    runs = {r["log"]: tuple(r)[1:] for r in evidence.sensor_runs(df, "text", "log", "line").collect()}
    assert runs == {"a": (12, 0, 0, 2, True, None), "b": (0, 0, 0, 0, False, None)}
    assert sorted(tuple(r) for r in evidence.sensor_candidates(df, "text", "log", "line").collect()) == [("a", 4, None, None, "unknown"), ("a", 6, "dos", 0.5, "known_attack")]
    assert evidence.sensor_runs(df.filter("false"), "text", "log", "line").count() == 0
    none = spark.createDataFrame([("x", None, True)], "decision string, v double, passed boolean").filter("false")
    assert tuple(evidence.score_metrics(none, "decision", "passed", evidence.F.lit("x")).first()) == (0, 0, None, 0, None)
    assert tuple(evidence.distributions(none, ["v"]).first()) == ("v", 0, *[None] * 7)


@pytest.mark.parametrize("profile,size", [("A", 54), ("E", 70)])
def test_profiles(profile, size):
    assert len(features.profile_columns(profile, features.TERMINAL_NAMES)) == size
