"""Flow rules against named cases and a slow tracker that follows a capture packet by packet."""

import random

import pytest
from pyspark.sql import functions as F

from braidflow.operators import features, windows
from braidflow.operators.flow_machine import ACK, FIN, RST, SYN, FlowPolicy, resolve_passive, simple_flows, track

S = 10**9
PACKET = "capture_id string, flow_key string, packet_index long, timestamp_ns long, source string, is_tcp boolean, tcp_flags int, sequence_number long"


def slow(packets, policy):
    """Closed flows of a capture: every flow is looked at before every packet."""
    clock, flows, out = -(2**62), {}, []

    def close(key, reason):
        f = flows.pop(key)
        out.append((key, f["gen"], reason, f["n"], f["first"], f["last"]))

    for cap, key, i, ts, src, tcp, flags, seq in packets:
        clock = max(clock, ts)
        for k in list(flows):
            if clock >= flows[k]["last"] + policy.idle_ns:
                close(k, "idle_timeout")
        for k in list(flows):
            if clock >= flows[k]["first"] + policy.max_age_ns:
                close(k, "maximum_age")
        opening = tcp and flags & SYN and not flags & ACK
        f = flows.get(key)
        repeat = f and opening and f["open"] == (src, seq)
        if f and opening and not repeat:
            close(key, "tuple_reuse")
            f = None
        if not f:
            f = flows[key] = {"gen": i, "first": ts, "last": ts, "n": 0, "src": src, "open": (src, seq) if opening else None, "fin": set(), "second": None}
        elif not repeat:
            f["open"] = None
        side = src == f["src"]
        f["n"] += 1
        f["last"] = max(f["last"], ts)
        if tcp:
            done = len(f["fin"]) == 2 and flags & ACK and side != f["second"]
            if flags & FIN and side not in f["fin"]:
                f["fin"].add(side)
                if len(f["fin"]) == 2:
                    f["second"] = side
            if flags & RST:
                close(key, "tcp_reset")
            elif done:
                close(key, "tcp_fin_handshake")
    for k in list(flows):
        close(k, "end_of_input")
    return sorted(out)


def run(spark, packets, policy):
    df = windows.running_watermark(spark.createDataFrame(packets, PACKET), ["capture_id"], "packet_index", chunk=7)
    rows = track(df, policy)
    closes = resolve_passive(rows.filter("row = 'closed'").select("capture_id", "flow_key", "generation", "reason", "creation_ns", "last_event_ns", "packets"), df, policy, 10 * S)
    return sorted((r["flow_key"], r["generation"], r["reason"], r["packets"], r["creation_ns"], r["last_event_ns"]) for r in closes.collect()), rows


def udp(*times):
    return [("c", key, k, t * S, "a", False, 0, 0) for k, (key, t) in enumerate(times)]


def tcp(*steps):
    return [("c", "k", k, t * S, src, True, flags, seq) for k, (t, src, flags, seq) in enumerate(steps)]


@pytest.mark.parametrize(
    ("packets", "reasons"),
    [
        (udp(("k", 0), ("k", 60)), ["idle_timeout", "end_of_input"]),
        (udp(("x", 0), ("y", 0), ("z", 60)), ["idle_timeout", "idle_timeout", "end_of_input"]),
        (tcp((0, "a", SYN, 1), (1, "b", RST | ACK, 1)), ["tcp_reset"]),
        (tcp((0, "a", FIN | ACK, 1), (1, "b", FIN | ACK, 1), (2, "b", ACK, 1), (3, "a", ACK, 1)), ["tcp_fin_handshake"]),
        (tcp((0, "a", SYN, 10), (1, "a", SYN, 10), (2, "b", SYN | ACK, 1), (3, "a", SYN, 30)), ["tuple_reuse", "end_of_input"]),
        ([("c", "k", k, t * S, "a", False, 0, 0) for k, t in enumerate(range(0, 1900, 50))], ["maximum_age", "end_of_input"]),
    ],
)
def test_cases(spark, packets, reasons):
    got, _ = run(spark, packets, FlowPolicy())
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == reasons
    assert got == slow(packets, FlowPolicy())


def test_random_traces(spark):
    rng = random.Random(3)
    t, packets = 0, []
    for i in range(1500):
        t += rng.choice([0, 0, 1, 2, 5, -3, 20])
        packets.append(("c", rng.choice("klmno"), i, t * S, rng.choice("ab"), rng.random() < 0.8, rng.choice([SYN, ACK, SYN | ACK, FIN | ACK, RST, ACK, ACK, ACK]), rng.choice([1, 2])))
    policy = FlowPolicy(60 * S, 180 * S)
    got, rows = run(spark, packets, policy)
    want = slow(packets, policy)
    assert got == want
    assert {r[2] for r in want} >= {"idle_timeout", "tuple_reuse", "tcp_reset"}
    assert rows.filter("row = 'packet'").count() == len(packets)


def test_ends_only_and_read_once(spark):
    """The ends alone are those among all rows, and the tracker runs once for a table of resolved ends."""
    rng = random.Random(4)
    packets = [("c", rng.choice("kl"), i, i * 3 * S, rng.choice("ab"), True, rng.choice([SYN, FIN | ACK, RST, ACK, ACK]), 1) for i in range(300)]
    df = windows.running_watermark(spark.createDataFrame(packets, PACKET), ["capture_id"], "packet_index")
    policy, runs = FlowPolicy(60 * S, 180 * S), spark.sparkContext.accumulator(0)
    ends = track(df, policy, ends_only=True)
    want = track(df, policy).filter("row = 'closed'")
    assert sorted(map(str, ends.collect())) == sorted(map(str, want.collect()))

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    closes = ends.mapInArrow(counted, ends.schema).select("capture_id", "flow_key", "generation", "reason", "creation_ns", "last_event_ns", "packets")
    assert resolve_passive(closes, df, policy, 10 * S).count() == want.count() == runs.value


TCP = [
    (1000000000, "forward", 60, 0, 54, 64, 1000, SYN), (1001000000, "reverse", 74, 0, 54, 63, 2000, SYN | ACK), (1000500000, "forward", 100, 40, 60, 62, 1500, ACK), (1002000000, "forward", 120, 60, 60, 61, 2500, ACK | 8),
    (1003500000, "reverse", 80, 20, 54, 60, 3000, ACK), (1001500000, "forward", 140, 80, 60, 59, 3500, ACK | 8), (1005000000, "reverse", 90, 30, 60, 58, 4000, ACK), (1004500000, "reverse", 110, 50, 60, 57, 4500, ACK),
    (1008000000, "forward", 130, 70, 60, 56, 5000, FIN | ACK),
]
UDP = [(2000000000, "forward", 70, 28, 42, 128, None, None), (2000000000, "forward", 90, 48, 42, 128, None, None), (1999500000, "reverse", 80, 38, 42, 64, None, None)]
# Expected vectors at the third and ninth packet.
F3 = [1000.0, 3, 2, 1, 234, 160, 74, 60, 100, 78.0, 16.57307052620807, 80.0, 20.0, 74.0, 0.0, -500.0, 1000.0, 250.0, 750.0, 500.0, 0.0, 0.0, 0.0, 3000.0, 234000.0, 2.0, 2.1621621621621623, 2, 2, 2, 0, 0, 0, 1.0, 1000, 2000, 1500.0, 408.24829046386304, 62, 64, 63.0, 0.816496580927726, 1, 1, 0, 40, 40, 0, 0, 40, 13.333333333333334, 18.856180831641268, 56.0, 2.8284271247461903]
F9 = [8000.0, 9, 5, 4, 904, 550, 354, 60, 140, 100.44444444444444, 25.329434397822236, 110.0, 28.284271247461902, 88.5, 13.665650368716449, -2000.0, 3500.0, 1000.0, 1820.0274723201296, 2000.0, 2692.582403567252, 1166.6666666666667, 1247.219128924647, 1125.0, 113000.0, 1.25, 1.5536723163841808, 6, 2, 8, 1, 0, 2, 0.25, 1000, 2000, 3000.0, 1290.9944487358057, 56, 64, 60.0, 2.581988897471611, 7, 4, 3, 350, 250, 100, 0, 80, 38.888888888888886, 27.261875880856216, 58.0, 2.8284271247461903]
U3 = [0.0, 3, 2, 1, 240, 160, 80, 70, 90, 80.0, 8.16496580927726, 80.0, 10.0, 80.0, 0.0, -500.0, 0.0, -250.0, 250.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0, 2.0, 1, 0, 0, 0, 0, 0, 0.0, 0, 0, 0.0, 0.0, 64, 128, 106.66666666666667, 30.169889330626027, 3, 2, 1, 114, 76, 38, 28, 48, 38.0, 8.16496580927726, 42.0, 0.0]


def test_golden_vectors(spark):
    rows = [("t", k, *p) for k, p in enumerate(TCP)] + [("u", k, *p) for k, p in enumerate(UDP)]
    df = spark.createDataFrame(rows, "flow string, ord long, timestamp_ns long, direction string, wire_length long, payload_length long, header_length long, ttl int, tcp_window int, tcp_flags int")
    steps = windows.with_flow_steps(df, ["flow"], ["ord"])
    got = {(r["flow"], r["checkpoint"]): list(r)[2:] for r in features.flow_vector(windows.checkpoints(steps, ["flow"]), ["flow", "checkpoint"]).collect()}
    assert sorted(got) == [("t", 3), ("t", 5), ("t", 7), ("t", 9), ("u", 3)]
    for key, want in ((("t", 3), F3), (("t", 9), F9), (("u", 3), U3)):
        assert got[key] == pytest.approx(want, rel=1e-12, abs=1e-9)


def test_idle_generations_split_at_the_boundary(spark):
    df = spark.createDataFrame([("k", i, t * S) for i, t in enumerate((0, 59, 119, 178))], "k string, i long, t long")
    got = windows.idle_generations(df, ["k"], ["i"], "t", 60 * S).orderBy("i").select("generation").collect()
    assert [r[0] for r in got] == [1, 1, 2, 2]


def test_contexts(spark):
    rows = [(0, 10, "s", "d", 80), (0, 11, "s", "d", 80), (0, 12, "s", "d", 81), (1, 70, "s", "d", 80)]
    df = spark.createDataFrame(rows, "block int, t long, s string, d string, p int")
    got = windows.causal_contexts(df, ["block"], "t", "s", "d", "p").orderBy("t").select("same_endpoint", "same_pair", "distinct_ports").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1), (2, 2, 1), (1, 3, 2), (1, 1, 1)]


def test_simple_flows(spark):
    rows = [("k", i, t * S, f, 10, "a") for i, (t, f) in enumerate(((0, ACK), (1, FIN), (2, ACK), (3, ACK), (200, ACK)))]
    df = spark.createDataFrame(rows, "flow_key string, packet_index long, timestamp_ns long, tcp_flags int, wire_length long, source string")
    assert sorted(r["packets"] for r in simple_flows(df).collect()) == [2, 2]


def test_watermark_in_two_phases_equals_one(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("c", i, rng.randrange(1000)) for i in range(300)], "c string, i long, timestamp_ns long")
    from pyspark.sql import Window as W

    want = df.withColumn("w", F.max("timestamp_ns").over(W.partitionBy("c").orderBy("i")))
    got = windows.running_watermark(df, ["c"], "i", chunk=17)
    assert want.join(got, ["c", "i"]).filter("w <> watermark_ns").count() == 0
