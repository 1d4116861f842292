"""Readers, writers and frame decoding on files and frames made here."""

import hashlib
import struct

from pyspark.sql import functions as F

from braidflow.operators import decode
from braidflow.operators.quality import schema_fingerprint
from braidflow.sources import readers, writers


def test_label_csv(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_bytes("id,Label,id\n1,Web Attack – XSS,2\n,,\n3,only two\n4,Bot,5\n".encode("cp1252"))
    good, bad = readers.read_label_csv(spark, str(p), ["id", "Label", "id"])
    assert good.columns == ["id", "Label", "id.2"]
    assert sorted(tuple(r) for r in good.collect()) == [("1", "Web Attack – XSS", "2"), ("4", "Bot", "5")]
    assert len(bad.collect()) == 1


def test_exact_json(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"a":1,"b":"x"}\n{"a":1}\n{"a":1,"b":"x","c":2}\nnope\n')
    good, bad = readers.read_exact_json(spark, str(tmp_path / "f.jsonl"), "a long, b string")
    assert [tuple(r) for r in good.collect()] == [(1, "x")] and bad.count() == 3


def test_zeek(spark, tmp_path):
    p = tmp_path / "conn.log"
    p.write_text("#separator \\x09\n#fields\tts\tid.orig_h\tservice\n1.5\t10.0.0.1\t-\n2.5\t10.0.0.2\n3.5\t(empty)\thttp\n")
    fields = readers.zeek_fields(spark, str(p))
    assert fields == ["ts", "id.orig_h", "service"]
    got = readers.zeek_rows(spark.read.text(str(p)), fields).collect()
    assert sorted(tuple(r) for r in got) == [("1.5", "10.0.0.1", None), ("3.5", None, "http")]


def test_log_lines_and_inventory(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"event_type":"ready","n":1}\n\nbroken\n{"event_type":"alert","n":2}\n')
    got = readers.read_log_lines(spark, str(tmp_path / "s.jsonl"), "event_type string, n long").orderBy("line").collect()
    assert [(r["line"], r["event_type"], r["bad"]) for r in got] == [(1, "ready", False), (3, None, True), (4, "alert", False)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("id, Label\n1,2\n")
    (tmp_path / "a" / "y.csv").write_text("id\n")
    inv = {r["name"]: r for r in readers.inventory(spark, str(tmp_path / "a"), ["id", "Label"]).collect()}
    assert inv["x.csv"]["complete"] and inv["x.csv"]["rows"] == 1 and not inv["y.csv"]["complete"]
    assert readers.read_dataset(spark, str(tmp_path / "a" / "x.csv"), "id int, Label int").first()["id"] == 1


def test_writers(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 2 * 2 + 3).cast("int").alias("checkpoint"), F.lit("c").alias("capture_id"), F.col("id").alias("flow_id"))
    writers.write_partitioned(df, str(tmp_path / "p"), ["checkpoint", "capture_id"], ["flow_id"])
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.filter("checkpoint = 3").count() == 50 and dict(back.dtypes)["checkpoint"] == "int"
    writers.write_sorted(df, str(tmp_path / "s"), ["capture_id", "flow_id"])
    writers.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 100
    _, first = writers.materialise(spark, df, str(tmp_path / "m"), str(tmp_path / "mk"))
    _, again = writers.materialise(spark, df, str(tmp_path / "m"), str(tmp_path / "mk"))
    assert (first, again) == (True, False)
    assert schema_fingerprint(df) == schema_fingerprint(df.limit(1))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = writers.append_json(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "log")).count() == 100


def ipv4(proto, body, flags=0, version=0x45, total=None, kind=0x0800, tag=None):
    head = struct.pack("!BBHHHBBHII", version, 0, 20 + len(body) if total is None else total, 0, flags, 64, proto, 0, 0x0A000001, 0x0A000002)
    vlan = b"" if tag is None else struct.pack("!HH", 0x8100, tag)
    return b"\0" * 12 + vlan + struct.pack("!H", kind) + head + body


def test_frames(spark):
    tcp = struct.pack("!HHIIHHHH", 1234, 80, 7, 0, 5 << 12 | 0x12, 500, 0, 0)
    udp = struct.pack("!HHHH", 53, 5353, 8 + 4, 0) + b"abcd"
    frames = {
        "tcp": ipv4(6, tcp + b"xyz"), "udp": ipv4(17, udp), "vlan": ipv4(6, tcp, tag=5), "short": b"\0" * 10, "arp": ipv4(6, tcp, kind=0x0806), "cut": ipv4(6, tcp)[:30], "v6": ipv4(6, tcp, version=0x65), "ihl": ipv4(6, tcp, version=0x44),
        "frag": ipv4(6, tcp, flags=0x2000), "icmp": ipv4(1, b"12345678"), "tcp_short": ipv4(6, tcp[:10]), "off": ipv4(6, tcp[:12] + b"\x10" + tcp[13:]), "udp_short": ipv4(17, udp[:6]), "udp_len": ipv4(17, struct.pack("!HHHH", 1, 2, 99, 0)),
        "total": ipv4(6, tcp, total=10), "long": ipv4(6, tcp, total=2000), "nested": b"\0" * 12 + struct.pack("!HHH", 0x8100, 1, 0x8100) + b"\0" * 30,
    }
    df = spark.createDataFrame([(n, k, bytearray(f)) for k, (n, f) in enumerate(frames.items())], "capture_id string, packet_index long, frame binary")
    got = {r["capture_id"]: r for r in decode.decode(df).collect()}
    errors = {n: r["error"] for n, r in got.items()}
    assert errors == {
        "tcp": None, "udp": None, "vlan": None, "short": "truncated_ethernet_header", "arp": "unsupported_ether_type", "cut": "truncated_ipv4_header", "v6": "invalid_ipv4_version", "ihl": "invalid_ipv4_header_length", "frag": "fragmented_ipv4", "icmp": "unsupported_transport_protocol",
        "tcp_short": "truncated_tcp_header", "off": "invalid_tcp_header_length", "udp_short": "truncated_udp_header", "udp_len": "invalid_udp_length", "total": "invalid_ipv4_total_length", "long": "truncated_ipv4_packet", "nested": "nested_vlan",
    }
    t = got["tcp"]
    assert (t["source_port"], t["destination_port"], t["sequence_number"], t["tcp_flags"], t["tcp_window"], t["payload_length"], t["payload_offset"], t["ttl"], t["source_ip"]) == (1234, 80, 7, 0x12, 500, 3, 54, 64, 0x0A000001)
    assert got["udp"]["payload_length"] == 4 and got["vlan"]["vlan_id"] == 5 and got["vlan"]["payload_offset"] == 58
    packets, bad = decode.packets_and_errors(df)
    assert packets.count() == 3 and bad.count() == 14
    layered = df.filter("capture_id in ('tcp', 'udp')").withColumns({"wire_length": F.when(F.col("capture_id") == "tcp", 10).otherwise(100), "link_layer": F.when(F.col("capture_id") == "udp", "raw").otherwise("ethernet")})
    assert {r["capture_id"]: r["error"] for r in decode.decode(layered).collect()} == {"tcp": "inconsistent_lengths", "udp": "unsupported_link_layer"}


def test_named_sinks(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = [(k, "c", k % 3 and "assigned" or "quarantine", "train" if k % 2 else "test", float(k)) for k in range(40)]
    flows = spark.createDataFrame(rows, "flow_id long, capture_id string, label_status string, partition string, x double").withColumn("partition", F.when(F.col("label_status") == "assigned", F.col("partition")))
    writers.write_terminal(flows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "assigned")).filter("partition = 'train'").count() == sum(k % 3 != 0 and k % 2 for k in range(40))
    assert spark.read.parquet(str(tmp_path / "t" / "quarantine")).count() == 14 and "partition" not in spark.read.parquet(str(tmp_path / "t" / "quarantine")).columns
    oof = spark.createDataFrame([("F3", "c", k, k % 5, "BENIGN", 0, 0.1, 0.2, 0, 0.3, 0.4, 1) for k in range(20)], "checkpoint string, capture_id string, flow_id long, fold int, assigned_class string, y_true int, hbos_raw_score double, hbos_normalized_score double, hbos_binary int, isolation_forest_raw_score double, isolation_forest_normalized_score double, isolation_forest_binary int")
    writers.write_out_of_fold(oof, str(tmp_path / "o"))
    back = spark.read.parquet(str(tmp_path / "o"))
    assert set(back.columns) == set(writers.OUT_OF_FOLD) and back.filter("fold = 2 and anomaly_count = 1").count() == 4
    scored = spark.createDataFrame([(7, "c", 0.25, 0.75, "DoS")], "flow_id long, capture_id string, p0 double, p1 double, decision string")
    writers.write_scores(scored, str(tmp_path / "s"), ["capture_id", "flow_id"], ["p0", "p1"], "decision")
    assert (tmp_path / "s").is_dir() and spark.read.json(str(tmp_path / "s")).first().asDict(True) == {"capture_id": "c", "flow_id": 7, "probabilities": {"p0": 0.25, "p1": 0.75}, "decision": "DoS"}
    many = spark.range(200_000).select(F.lit(3).alias("checkpoint"), F.lit("c").alias("capture_id"), F.col("id").alias("flow_id"))
    writers.write_partitioned(many, str(tmp_path / "g"), ["checkpoint", "capture_id"], ["flow_id"], files_per_partition=1)
    sizes = [pq.ParquetFile(f).metadata.row_group(g).num_rows for f in (tmp_path / "g").rglob("*.parquet") for g in range(pq.ParquetFile(f).num_row_groups)]
    assert max(sizes) <= 65_536 and sum(sizes) == 200_000


def test_stages_by_capture(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "capture_id string, x int")
    make = lambda capture: df.filter(F.col("capture_id") == capture)
    assert writers.materialise_each(spark, ["a", "b"], make, str(tmp_path / "m")) == ["a", "b"]
    assert writers.materialise_each(spark, ["a", "b", "c"], make, str(tmp_path / "m")) == ["c"]
    assert spark.read.parquet(str(tmp_path / "m") + "/part=a/data").count() == 2


def test_line_numbers_over_blocks(spark, tmp_path):
    (tmp_path / "l").mkdir()
    for name in "ab":
        (tmp_path / "l" / f"{name}.jsonl").write_text("".join(f'{{"n":{k}}}\n' if k % 7 else "\n" for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = readers.read_log_lines(spark, str(tmp_path / "l"), "n long").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 2 * sum(1 for k in range(3000) if k % 7) and all(r["line"] == r["n"] + 1 for r in got)


def test_raw_datasets(spark, tmp_path):
    (tmp_path / "fw.csv").write_text("Source Port,Destination Port,NAT Source Port,Action,Bytes,Packets,pkts_sent\n1,53,9,allow,94,2,1\n2,445,0,drop,70,1,1\n")
    fw = readers.read_firewall(spark, str(tmp_path / "fw.csv"))
    assert sorted(tuple(r) for r in fw.collect()) == [(53.0, 9.0, 94.0, 2.0, 1.0, 0), (445.0, 0.0, 70.0, 1.0, 1.0, 1)]
    (tmp_path / "UNSW_NB15_a.csv").write_text("id,dur,proto,service,state,spkts,label\n1,0.5,tcp,-,FIN,3,0\n2,1.5,udp,dns,CON,1,1\n")
    (tmp_path / "UNSW_NB15_b.csv").write_text("id,dur,proto,service,state,spkts,label\n1,2.5,udp,-,CON,4,1\n")
    u = readers.read_unsw(spark, [str(tmp_path / f"UNSW_NB15_{x}.csv") for x in "ab"], "id double, dur double, proto string, service string, state string, spkts double, label int")
    assert sorted((r["dur"], r["proto"], r["state"], r["y"]) for r in u.collect()) == [(0.5, 0, 0, 0), (1.5, 1, 1, 1), (2.5, 0, 0, 1)]
    (tmp_path / "cic.csv").write_text("Destination Port, Flow Duration,Idle Max,Attack Type\n80,5,1,Normal Traffic\n22,,2,DoS\n")
    c = readers.read_cic(spark, str(tmp_path / "cic.csv"), "`Destination Port` double, ` Flow Duration` double, `Idle Max` double, `Attack Type` string")
    assert sorted(tuple(r) for r in c.select("Destination Port", "Flow Duration", "y").collect()) == [(22.0, 0.0, 1), (80.0, 5.0, 0)] and "Idle Max" not in c.columns
    flows = spark.createDataFrame([(53, 17, 1.5, 100, 2, 0b010010, 250, 1, "DDoS"), (80, 6, 0.0, None, 1, None, 0, 0, "Benign")], "L4_DST_PORT int, PROTOCOL int, L7_PROTO double, IN_BYTES int, IN_PKTS int, TCP_FLAGS int, FLOW_DURATION_MILLISECONDS int, Label int, Attack string")
    flows.write.parquet(str(tmp_path / "bot"))
    b = readers.read_botiot(spark, str(tmp_path / "bot"))
    assert set(b.columns) == {"L4_DST_PORT", "PROTOCOL", "IN_BYTES", "IN_PKTS", "y", "fin_flag", "syn_flag", "psh_flag", "ack_flag", "flow_dur_us"}
    got = {r["L4_DST_PORT"]: r for r in b.collect()}
    assert [got[53][c] for c in ("fin_flag", "syn_flag", "psh_flag", "ack_flag", "flow_dur_us", "y")] == [0, 1, 0, 1, 250000.0, 1]
    assert [got[80][c] for c in ("fin_flag", "syn_flag", "ack_flag", "IN_BYTES", "y")] == [0, 0, 0, 0, 0]
    layer = {r["dst_port"]: r for r in readers.harmonise.botiot_layer2(b).collect()}
    assert layer[53.0]["flow_bytes_s"] == 400.0 and layer[53.0]["ack_flag"] == 1.0 and layer[80.0]["flow_bytes_s"] == 0.0


def test_hashes_of_files_of_any_length(spark, tmp_path):
    large = 2_200_000_000
    with open(tmp_path / "large file.bin", "wb") as f:
        f.write(b"begin")
        f.seek(large - 3)
        f.write(b"end")  # the rest is a hole, which takes no room on the disk
    (tmp_path / "empty").write_bytes(b"")
    want = hashlib.sha256(b"begin")
    for at in range(5, large - 3, 1 << 26):
        want.update(bytes(min(1 << 26, large - 3 - at)))
    want.update(b"end")
    files = spark.createDataFrame([(f"file:{tmp_path}/large file.bin",), (str(tmp_path / "empty"),), (None,)], "path string")
    got = {r["path"]: r["sha256"] for r in readers.hash_files(files).collect()}
    assert got == {f"file:{tmp_path}/large file.bin": want.hexdigest(), str(tmp_path / "empty"): hashlib.sha256(b"").hexdigest(), None: None}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x y.csv").write_text("id,Label\n1,2\n")
    row = readers.inventory(spark, str(tmp_path / "c"), ["id"]).first()
    assert row["sha256"] == hashlib.sha256(b"id,Label\n1,2\n").hexdigest() and row["rows"] == 1 and row["complete"]
