"""Streams over files against batch results and slow versions."""

import hashlib
import random

from pyspark.sql import functions as F

from braidflow.operators import evidence, features, windows
from braidflow.operators.flow_machine import FlowPolicy, track
from braidflow.streaming import alerts, flows
from braidflow.streaming.flows import gate
from braidflow.streaming.totals import OWN_NAMES

S = 10**9
PACKET = "capture_id string, flow_key string, packet_index long, timestamp_ns long, source string, is_tcp boolean, tcp_flags int, sequence_number long"


def stream_of(spark, df, path, parts, schema, order):
    """A file stream that reads one part of the rows in each micro-batch."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def results(spark, stream, name, path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name)


def test_flow_stream_equals_batch(spark, tmp_path):
    rng = random.Random(7)
    t, rows = 0, []
    for i in range(240):
        t += rng.choice([1, 2, 3, 9])
        rows.append(("c", rng.choice("klm"), i, t * S, rng.choice("ab"), True, rng.choice([2, 16, 16, 16, 17, 4]), 1))
    # a last packet far ahead moves the watermark beyond every deadline
    rows.append(("c", "z", 240, (t + 7200) * S, "a", False, 0, 0))
    rows.append(("c", "z", 241, (t + 7300) * S, "a", False, 0, 0))
    df = spark.createDataFrame(rows, PACKET)
    policy = FlowPolicy(60 * S, 300 * S)
    own = windows.running_watermark(df, ["capture_id", "flow_key"], "packet_index")
    batch = track(own, policy).filter("row = 'closed' and flow_key <> 'z'")
    named = F.when(F.col("reason") != "passive", F.col("reason")).when(F.least(F.col("last_event_ns") + policy.idle_ns, F.col("creation_ns") + policy.max_age_ns) >= F.col("last_event_ns") + policy.idle_ns, "idle_timeout")
    want = sorted((r["flow_key"], r["generation"], r["reason"] or "maximum_age", r["packets"]) for r in batch.withColumn("reason", named).collect())
    out = results(spark, flows.track_stream(stream_of(spark, df, tmp_path / "in", 4, PACKET, "packet_index"), policy, "10 seconds"), "flow_events", tmp_path / "cp")
    got = sorted((r["flow_key"], r["generation"], r["reason"], r["packets"]) for r in out.filter("event = 'close' and flow_key <> 'z'").collect())
    assert got == want
    marks = {(r["flow_key"], r["generation"], r["ordinal"]) for r in out.filter("event = 'checkpoint'").collect()}
    have = track(own, policy).filter("row = 'packet' and ordinal in (3, 5, 7, 9)").select("flow_key", "generation", "ordinal").collect()
    assert marks == {tuple(r) for r in have}


def test_stream_features_equal_batch(spark, tmp_path):
    rng = random.Random(5)
    t, rows = 0, []
    schema = PACKET + ", wire_length long, payload_length long, header_length long, ttl long, tcp_window long, protocol int, source_port int, destination_port int, source_ip string, destination_ip string"
    for i in range(300):
        t += rng.choice([-1, 0, 1, 2, 7])
        k, side = rng.choice("klm"), rng.choice("ab")
        tcp = k != "m"
        rows.append((rng.choice("cd"), k, i, t * S + i, side, tcp, rng.choice([16, 24, 18]) if tcp else None, 1 if tcp else None, 60 + i % 40, i % 3 * 20, 40 + i % 5, 60 + i % 4, 1000 + i if tcp else None, 6 if tcp else 17, ord(side), ord("a") + ord("b") - ord(side), side, "x"))
    df = spark.createDataFrame(rows, schema)
    policy = FlowPolicy(10**6 * S, 10**7 * S)
    end = spark.createDataFrame([("z", "z", 300 + j, (10**8 + j * 10**4) * S, "a", False, None, None, 60, 0, 40, 64, None, 17, 1, 2, "a", "x") for j in (0, 1)], schema)
    out = results(spark, flows.track_stream(stream_of(spark, df.unionByName(end), tmp_path / "in", 5, schema, "packet_index"), policy, "100 seconds"), "feature_events", tmp_path / "cp")
    p = track(windows.running_watermark(df, ["capture_id", "flow_key"], "packet_index"), policy).filter("row = 'packet'").select("capture_id", "flow_key", "packet_index", "generation", "direction")
    p = windows.running_watermark(df.drop("direction").join(p, ["capture_id", "flow_key", "packet_index"]), ["capture_id"], "packet_index")
    keys = ["capture_id", "flow_key", "generation"]
    p = windows.with_flow_steps(p, keys, ["packet_index"])
    near = lambda a, b: all(abs(x - y) <= 1e-6 * max(1, abs(y)) for x, y in zip(a, b, strict=True))
    snaps = features.flow_vector(windows.checkpoints(p, keys), [*keys, "checkpoint"])
    want = {tuple(r[c] for c in (*keys, "checkpoint")): [r[n] for n in features.NAMES] for r in snaps.collect()}
    got = {tuple(r[c] for c in (*keys, "ordinal")): r["features"] for r in out.filter("event = 'checkpoint' and flow_key <> 'z'").collect()}
    assert set(got) == set(want) and all(near(got[k], want[k]) for k in want)
    closed = features.terminal_vector(p, keys, ["capture_id"], "packet_index")
    want = {tuple(r[c] for c in keys): [r[n] for n in OWN_NAMES] for r in closed.collect()}
    got = {tuple(r[c] for c in keys): r["features"] for r in out.filter("event = 'close' and flow_key <> 'z'").collect()}
    assert set(got) == set(want) and all(near(got[k], want[k]) for k in want)


def test_replay_bridge(spark):
    line = '{"event_type":"nids_alert","decision":"known_attack","packet_count":5,"flow":{"protocol":"tcp","source":{"ip":"1.2.3.4","port":9},"destination":{"ip":"5.6.7.8","port":80}},"evidence":{"flow_rf":{"attack_probability":0.12345678},"known_family":{"top_candidate":"DoS","confidence":0.5}}}'
    df = spark.createDataFrame([(line,), ("not json",), ('{"event_type":"ready"}',), (line.replace("nids_alert", "sensor_ready"),)], "value string")
    got = [tuple(r) for r in alerts.replay_bridge(df, F.lit("f9-dos-hulk"), F.lit("replay (F9)")).collect()]
    assert got == [("F9", "known_attack", "DoS", 0.123457, 0.5, "1.2.3.4:9", "5.6.7.8:80", "TCP", "replay (F9)", "dos-hulk", "f9-dos-hulk", 5)]


def test_digest_window_ends(spark, tmp_path):
    schema = "line long, decision string, model string, source string, destination string, candidate string, confidence double"
    rows = [(k, "attack", "m", "s", "d", "dos", 0.5) for k in range(4)]
    s = stream_of(spark, spark.createDataFrame(rows, schema), tmp_path / "in", 4, schema, "line")
    sent, times = [], [0, 0, 3600, 7300, 7400]
    q = alerts.digest_stream(s, str(tmp_path / "seen"), lambda df, epoch: sent.append((epoch, df.count())), str(tmp_path / "cp"), window_hours=2, now=lambda: times[len(sent)])
    q.awaitTermination(180)
    assert q.exception() is None and [n for _, n in sent] == [1, 0, 0, 1]


def test_digest_by_hand(spark):
    """Single lines worked out by hand: absent fields, words that are no alert, labels, protocols, families in turn."""
    schema = "line long, decision string, candidate string, model string, source string, src string, protocol string, confidence double, attack_score double, attack boolean"
    rows = [
        (1, "no_alert", "dos", "F9", "a", None, "TCP", 0.9, None, None), (2, "known_attack", "Normal", "F9", "a", None, "TCP", 0.9, None, None), (3, "", "dos", "F9", "a", None, "TCP", 0.9, None, None), (4, "known_attack", "dos", "F9", "a", None, "TCP", 0.9, None, False),
        (5, "known_attack", "dos", "F9", "a", None, "TCP", 0.1, None, None), (6, "known_attack", "dos", "F9", "a", None, "UDP", None, 0.7, True), (7, "known_attack", "dos", "F9", "a", None, "TCP", 0.99, None, None), (8, "unknown", None, None, None, "z", None, None, None, None),
        (9, "known_attack", "dos", "F9", "b", None, "TCP", 0.5, None, None), (10, "known_attack", "web", "F9", "b", None, "TCP", 0.5, None, None), (11, "known_attack", "scan", "F9", "b", None, "TCP", 0.5, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    told = [(r["line"], r["label"], r["severity"], r["confidence"], r["suppressed"]) for r in alerts.digest(df, None, 1, 3).collect()]
    assert told == [(5, "dos", "attack", 0.1, 2), (8, "unknown", "uncertain", None, 0), (11, "scan", "attack", 0.5, 0), (None, "web", None, None, 1)]
    assert [r["line"] for r in alerts.digest(df, None, 0, 99).collect()] == [5, 6, 8, 9, 10, 11]
    identity = {r["line"]: r["identity"] for r in alerts.alert_fields(df).collect()}
    assert identity[8] == hashlib.sha256(b"?|z|?||unknown").hexdigest() and identity[6] == hashlib.sha256(b"F9|a|?|UDP|dos").hexdigest()
    seen = spark.createDataFrame([(identity[5],)], "identity string")
    assert tuple(alerts.digest_counts(df, seen).first()) == (4, 1, 1)
    assert [r["line"] for r in alerts.digest(df, seen, 0, 99).collect()] == [6, 8, 9, 10, 11]


def test_terminal_lines_by_hand(spark):
    decision = '{"event_type":"nids_terminal_flow_decision","decision":"Benign ","scores":{"top_attack_candidate":{"class_name":"DoS"},"attack_gate":{"attack_score":0.25},"gated_decision":{"class_confidence":0.75}},"flow":{"protocol":"tcp","source":{"ip":"1.1.1.1","port":5}}}'
    alert = '{"event_type":"nids_terminal_flow_alert","decision":"PortScan","scores":{"attack_score":0.5,"class_confidence":0.625},"close_reason":"tcp_reset"}'
    df = spark.createDataFrame([("a", decision), ("a", alert), ("b", alert), ("b", "{"), ("b", '{"event_type":"nids_alert"}')], "log string, value string")
    rows = evidence.prefer_decisions(evidence.flatten_terminal(df, "value"), "log").orderBy("log").collect()
    got = [(r["log"], r["decision"], r["candidate"], r["terminal_class"], r["flow_rf_probability"], r["confidence"], r["source"], r["protocol"], r["close_reason"]) for r in rows]
    assert got == [("a", "benign", "DoS", "Benign ", 0.25, 0.75, "1.1.1.1:5", "TCP", None), ("b", "known_attack", "PortScan", "PortScan", 0.5, 0.625, "None:None", "?", "tcp_reset")]


def test_incidents(spark, tmp_path):
    schema = "flow_id long, line long, checkpoint long"
    df = spark.createDataFrame([(1, 0, 3), (1, 1, 5), (2, 2, 3), (1, 3, 5)], schema)
    out = results(spark, flows.incident_stream(stream_of(spark, df, tmp_path / "in", 2, schema, "line")), "incident_rows", tmp_path / "cp")
    got = {r["line"]: (r["state"], r["update_index"], r["out_of_order"]) for r in out.collect()}
    assert got == {0: ("created", 0, False), 1: ("updated", 1, False), 2: ("created", 0, False), 3: ("updated", 2, True)}


def test_gate(spark, tmp_path):
    schema = "site string, line long, at_s long, layer string, identity string, source string, destination string, score double, threshold double"
    rows = [
        ("s", 0, 0, "flow", "a", "x", "y", 0.9, 0.8), ("s", 1, 10, "flow", "a", "x", "y", 0.9, 0.8), ("s", 2, 20, "flow", "b", "q", "x", 0.9, 0.8), ("s", 3, 31, "flow", "a", "x", "y", 0.9, 0.8),
        ("s", 4, 400, "flow", "b", "q", "x", 0.9, 0.8), ("s", 5, 401, "flow", "c", "r", "t", 0.1, 0.8), ("s", 6, 402, "http", "b2", "w", "q", 0.9, 0.8),
        ("s", 7, 700, "http", "b3", "v", "q", 0.9, 0.8),  # "q" attacked exactly 300 seconds ago
    ]
    df = spark.createDataFrame(rows, schema)
    out = results(spark, flows.gate_stream(stream_of(spark, df, tmp_path / "in", 3, schema, "line")), "gate_rows", tmp_path / "cp")
    assert sorted(r["line"] for r in out.collect()) == [0, 3, 4, 7]
    assert gate([(k, r[2], *r[3:]) for k, r in enumerate(rows)], {}, {}) == [0, 3, 4, 7]


def test_session_counts_equal_window(spark, tmp_path):
    schema = "key string, line long, at_s long"
    df = spark.createDataFrame([("k" if i % 3 else "m", i, 7 * i) for i in range(60)], schema)
    out = results(spark, flows.session_count_stream(stream_of(spark, df, tmp_path / "in", 3, schema, "line")), "session_rows", tmp_path / "cp")
    want = {(r["key"], r["line"], r["recent"]) for r in windows.sliding_count(df, ["key"], "at_s", 60).collect()}
    assert {tuple(r) for r in out.collect()} == want


def test_blocks_dedupe_and_bridge(spark, tmp_path):
    schema = "at timestamp, k string, line long"
    base = 1_700_000_000
    df = spark.createDataFrame([(base + 20 * i, "a" if i % 2 else "b", i) for i in range(12)], "s long, k string, line long").select(F.timestamp_seconds("s").alias("at"), "k", "line")
    s = stream_of(spark, df, tmp_path / "in", 3, schema, "line")
    n = results(spark, alerts.block_counts(s, "at", ["k"]), "block_rows", tmp_path / "c1", "complete")
    assert n.agg(F.sum("n")).first()[0] == 12 and n.count() == df.select(F.window("at", "60 seconds"), "k").distinct().count()
    one = results(spark, alerts.distinct_alerts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["k"], "at", "1 hour"), "distinct_rows", tmp_path / "c2")
    assert one.count() == 2
    lines = tmp_path / "log"
    lines.mkdir()
    (lines / "a.jsonl").write_text('{"event_type":"nids_alert","decision":"known_attack","flow":{"source":{"ip":"1.2.3.4","port":9}},"evidence":{"flow_rf":{"attack_probability":0.5}}}\nnot json\n')
    flat = results(spark, alerts.bridge(spark.readStream.text(str(lines))), "bridge_rows", tmp_path / "c3").orderBy(F.desc("decision")).collect()
    assert [(r["decision"], r["source"], r["destination"], r["protocol"], r["flow_rf_probability"], r["confidence"]) for r in flat] == [("known_attack", "1.2.3.4:9", "None:None", "?", 0.5, None)]


def test_digest_remembers(spark, tmp_path):
    schema = "line long, decision string, model string, source string, destination string, candidate string, confidence double"
    rows = [(k, "attack" if k % 4 else "benign", "m", f"s{k % 3}", "d", "dos" if k % 2 else "web", k / 20) for k in range(16)]
    s = stream_of(spark, spark.createDataFrame(rows, schema), tmp_path / "in", 4, schema, "line")
    sent = []
    q = alerts.digest_stream(s, str(tmp_path / "seen"), lambda df, epoch: sent.extend(r["identity"] for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(180)
    assert q.exception() is None and len(sent) == len(set(sent)) == 6


def test_labels_appended_and_scored(spark, tmp_path):
    from braidflow.operators import models

    df = spark.createDataFrame([(float(k), float(k % 7), float(k > 50)) for k in range(100)], "a double, b double, y double")
    model = models.fit_forest(df, ["a", "b"], "y", trees=3, depth=3)
    out = alerts.score_stream(df.withColumn("votes", F.lit(0)), model, 0.5, "votes")
    assert out.filter("decision = 'known_attack'").count() in range(40, 60) and out.first()["line"].startswith('{"decision"')
    s = stream_of(spark, df, tmp_path / "in", 2, "a double, b double, y double", "a")
    alerts.append_labels(s, str(tmp_path / "train"), str(tmp_path / "cp")).awaitTermination(180)
    assert spark.read.parquet(str(tmp_path / "train")).count() == 100


def test_scores_on_a_stream_equal_batch(spark, tmp_path):
    from braidflow.operators import models

    df = spark.createDataFrame([(float(k), float(k % 7), float(k > 50)) for k in range(100)], "a double, b double, y double")
    model = models.fit_forest(df, ["a", "b"], "y", trees=3, depth=3)
    schema = "a double, b double, y double, votes int"
    rows = df.withColumn("votes", (F.col("a") % 3).cast("int"))
    out = results(spark, alerts.score_stream(stream_of(spark, rows, tmp_path / "in", 3, schema, "a"), model, 0.5, "votes"), "score_rows", tmp_path / "cp")
    want = {(r["a"], r["decision"], r["line"]) for r in alerts.score_stream(rows, model, 0.5, "votes").collect()}
    assert {(r["a"], r["decision"], r["line"]) for r in out.collect()} == want and len({d for _, d, _ in want}) > 1


def test_packets_later_than_the_delay_are_lost_to_the_stream(spark, tmp_path):
    rows = [("c", "k", i, (1000 + t) * S, "a", True, 16, 1) for i, t in enumerate([0, 5, 500, 505, 2, 506])]
    stream = stream_of(spark, spark.createDataFrame(rows, PACKET), tmp_path / "in", 6, PACKET, "packet_index")
    out = results(spark, flows.track_stream(stream, FlowPolicy(60 * S, 10**6 * S), "10 seconds"), "late_rows", tmp_path / "cp")
    ends = out.filter("event = 'close'").collect()
    assert [(r["generation"], r["reason"], r["packets"]) for r in ends] == [(0, "idle_timeout", 2)]
    assert [r["ordinal"] for r in out.filter("event = 'checkpoint'").collect()] == [3]  # packets 2, 3 and 5; packet 4 came 503 seconds late
