"""The clock and the idle times of closed flows from the flows themselves: packets are grouped once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidflow.operators import features, windows

S = 10**9


@pytest.fixture(scope="module")
def packets(spark):
    rng = np.random.default_rng(6)
    rows = []
    for cap in ("x", "y"):
        for flow in range(60):
            t = int(rng.integers(0, 400)) * S
            for k in range(int(rng.integers(1, 9))):
                t += int(rng.integers(-4, 20)) * S
                ends = ("c", 1000 + flow, "s", int(rng.integers(3)))
                rows.append((cap, flow, flow * 100 + k + 1, t, "forward" if rng.random() < 0.6 else "reverse", 6, *ends, int(rng.integers(30, 60)), int(rng.integers(32)), int(rng.integers(60, 900))))
    p = spark.createDataFrame(rows, "cap string, flow long, place long, timestamp_ns long, direction string, protocol int, source_ip string, source_port int, destination_ip string, destination_port int, ttl long, tcp_flags int, wire_length long")
    return p.withColumns({"payload_length": F.lit(9), "header_length": F.lit(54), "tcp_window": F.lit(1000)})


def test_flows_that_follow_each_other_give_the_clock(packets):
    def vectors(p, contiguous):
        v = features.terminal_vector(windows.with_flow_steps(p, ["cap", "flow"], ["place"]), ["cap", "flow"], ["cap"], "place", contiguous=contiguous)
        return v, {(r["cap"], r["flow"]): tuple(r)[2:] for r in v.collect()}

    _, want = vectors(windows.running_watermark(packets, ["cap"], "place", chunk=700), False)
    plan, got = vectors(packets, True)
    assert len(got) == 120 and got == want
    names = features.TERMINAL_NAMES
    assert len({v[names.index("context_same_destination_endpoint_flow_count_60s")] for v in got.values()}) > 3
    # packets are joined and grouped once, and flows with all their features move once
    read = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "terminal-flows" in " ".join(plan.inputFiles()) and "tcp_flags" not in read


def test_idle_times_equal_those_of_segments(packets):
    p = windows.with_flow_steps(packets, ["cap", "flow"], ["place"])
    want = {(r["cap"], r["flow"]): (r["active_mean_us"], r["idle_mean_us"]) for r in windows.active_idle(p, ["cap", "flow"], ["ordinal"], "clock_ns", 5 * S).collect()}
    got = {k: v for k, v in ((((r["cap"], r["flow"])), (r["active_mean_us"], r["idle_mean_us"])) for r in features.terminal_vector(p.withColumn("watermark_ns", F.col("clock_ns")), ["cap", "flow"], ["cap"], "place", 5 * S).collect())}
    assert got == want and any(v[1] for v in got.values())


def test_clock_at_start_in_chunks(spark):
    rng = np.random.default_rng(2)
    rows = [(c, k * 10, int(rng.integers(100)), int(rng.integers(100, 200))) for c in ("a", "b") for k in range(40)]
    got = windows.watermark_at_start(spark.createDataFrame(rows, "c string, o long, first long, last long"), ["c"], "o", "first", "last", chunk=70).collect()
    want = {(c, o): max([f, *[z for d, q, _, z in rows if d == c and q < o]]) for c, o, f, _ in rows}
    assert {(r["c"], r["o"]): r["watermark_ns"] for r in got} == want
