"""Single records worked out by hand: codes, request, query and connection features, datasets of different origin."""

import pytest
from pyspark.sql import functions as F

from braidflow.functions import numbers, records, text
from braidflow.operators import harmonise


def one(spark, **columns):
    return spark.range(1).select(*[(c if hasattr(c, "cast") else F.lit(c)).alias(n) for n, c in columns.items()]).first().asDict()


def test_http_features(spark):
    lit = lambda *xs: [F.lit(x) for x in xs]
    f = text.http_features(*lit("put", "/a?x=1 OR 1=1&y='<script>", "h.example", "aab", "-", "404", "-", "120"))
    r = one(spark, **f)
    assert list(f) == "uri_len uri_special_ratio uri_token_hits method_enc status_code req_body_len resp_body_len ua_len ua_entropy host_present referrer_present".split()
    assert r["uri_len"] == 25 and abs(r["uri_special_ratio"] - 7 / 25) < 1e-12 and r["uri_token_hits"] == 2
    assert (r["method_enc"], r["status_code"], r["req_body_len"], r["resp_body_len"], r["ua_len"], r["host_present"], r["referrer_present"]) == (2, 404.0, 0.0, 120.0, 3, 1.0, 0.0)
    assert abs(r["ua_entropy"] - 0.9182958340544896) < 1e-12
    absent = one(spark, **text.http_features(*[F.lit(None).cast("string")] * 8))
    assert (absent["uri_len"], absent["method_enc"], absent["host_present"]) == (1, 0, 0.0)


def test_dns_features(spark):
    f = text.dns_features(F.lit("ab.c-d.example"), F.lit("txt"), F.lit("NXDOMAIN"), F.lit("1.2.3.4,5.6.7.8"))
    r = one(spark, **f)
    assert list(f) == "query_len query_entropy subdomain_count qtype_enc rcode_enc answer_count resp_size query_special_ratio".split()
    assert (r["query_len"], r["subdomain_count"], r["qtype_enc"], r["rcode_enc"], r["answer_count"], r["resp_size"]) == (14, 3, 2, 1, 2, 15)
    assert abs(r["query_special_ratio"] - 3 / 14) < 1e-12
    absent = one(spark, **text.dns_features(*[F.lit("-")] * 4))
    assert tuple(absent.values()) == (0, 0.0, 0, 0, 0, 0, 0, 0.0)
    other = one(spark, q=text.query_type_code(F.lit("ANY")), r=text.response_code(F.lit("NOTIMP")), m=text.method_code(F.lit("PATCH")), s=text.conn_state_code(F.lit("sf")))
    assert tuple(other.values()) == (9, 4, 5, 12)


def test_conn_features(spark):
    f = text.conn_features(*map(F.lit, ("0.5", "1000", "-", "4", "(empty)", "REJ")), F.lit(3), F.lit(7))
    r = one(spark, **f)
    assert list(f) == [*harmonise.LAYER3, "src"]
    assert tuple(r.values()) == (500000.0, 1000.0, 0.0, 4.0, 0.0, 0.0, 0.0, 16000.0, 0.0, 2, 3, 7, 1)
    assert one(spark, **text.conn_features(*map(F.lit, ("-", "1", "1", "1", "1", "x")), F.lit(0), F.lit(0)))["sload"] == pytest.approx(8e9)


def test_payload_buckets(spark):
    want = {0: "0", 1: "1-15", 15: "1-15", 16: "16-31", 63: "32-63", 64: "64-127", 255: "128-255", 256: "256-511", 1023: "512-1023", 1499: "1024-1499", 1500: "1500-65535", 65535: "1500-65535", 65536: ">65535"}
    got = spark.createDataFrame([(n,) for n in want], "n long").select("n", numbers.payload_bucket(F.col("n")).alias("b")).collect()
    assert {r["n"]: r["b"] for r in got} == want


def test_family_of_an_unmapped_class_fails(spark):
    names = list(records.FAMILIES)
    assert len(names) == 14 and len(set(records.FAMILIES.values())) == 6
    df = spark.createDataFrame([(n,) for n in names], "c string").select("c", records.family_of(F.col("c")).alias("f"))
    assert {r["c"]: r["f"] for r in df.collect()} == records.FAMILIES
    for unknown in ("Heartbleed", None):
        with pytest.raises(Exception, match="class without a family"):
            spark.createDataFrame([(unknown,)], "c string").select(records.family_of(F.col("c"))).collect()


def test_layers_of_single_records(spark):
    cic = spark.createDataFrame([(80, 1000.0, 3, 90.0, float("inf"), 5.0, " Normal Traffic", 1.0), (22, None, 1, 40.0, 7.0, 6.0, "DoS", 2.0)], ["Destination Port", "Flow Duration", " Total Fwd Packets", "Total Length of Fwd Packets", "Flow Bytes/s", "Active Mean", "Attack Type", "Idle Max"])
    a = [tuple(r) for r in harmonise.cic_layer2(harmonise.clean_cic(cic)).collect()]
    assert a[0] == (80.0, 1000.0, 3.0, 90.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 5.0, 0.0, 0, 0)
    assert a[1][:2] == (22.0, 0.0) and a[1][-2:] == (1, 0)
    bot = spark.createDataFrame([(53, 2e6, 4, 2, 400, 100, 1, 0, 1, 17, 1), (1, 0.0, 0, 0, 0, 0, 0, 0, 0, 6, 0)], "L4_DST_PORT int, flow_dur_us double, IN_PKTS int, OUT_PKTS int, IN_BYTES int, OUT_BYTES int, psh_flag int, ack_flag int, fin_flag int, PROTOCOL int, y int")
    b = [tuple(r) for r in harmonise.botiot_layer2(bot).collect()]
    assert b[0] == (53.0, 2e6, 4.0, 400.0, 2.0, 100.0, 100.0, 500 / 6, 250.0, 1.0, 0.0, 1.0, 0.0, 0.0, 17.0, 1, 2)
    assert b[1][6:9] == (0.0, 0.0, 0.0)
    assert tuple(harmonise.botiot_layer3(bot).first()) == (2e6, 400.0, 100.0, 4.0, 2.0, 0.0, 0.0, 1600.0, 400.0, 0.0, 0.0, 0.0, 1, 2)
    unsw = spark.createDataFrame([(2, 0.5, "udp", "-", "CON", 10, 1), (1, 0.25, "tcp", "http", "FIN", 20, 0), (3, 1.0, "udp", "-", "FIN", 30, 1)], "id int, dur double, proto string, service string, state string, spkts int, label int")
    c = sorted(tuple(r) for r in harmonise.unsw_layer2(harmonise.clean_unsw(unsw, "id")).select("flow_dur_us", "fwd_pkts", "protocol_enc", "y", "src").collect())
    assert c == [(250000.0, 20.0, 0.0, 0, 1), (500000.0, 10.0, 1.0, 1, 1), (1000000.0, 30.0, 1.0, 1, 1)]


def test_first_share_is_what_stratified_marks_and_is_written_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from braidflow.operators import topk

    df = spark.range(5000).select(F.col("id").alias("row"), F.when(F.col("id") % 50 > 0, F.col("id") % 3).alias("y"))
    for share in (0.0, 0.2, 0.999, 1.0):
        want = sorted(r["row"] for r in topk.stratified(df, "y", "row", share).filter("chosen").collect())
        assert sorted(r["row"] for r in topk.first_share(df, "y", "row", share).collect()) == want
    labels = []
    monkeypatch.setattr(harmonise, "written", lambda rows, label: labels.append(label) or rows)
    cic = spark.createDataFrame([(k, float(k), k % 2) for k in range(100)], "row long, `Destination Port` double, y int")
    none = cic.limit(0)
    assert harmonise.layer2_training(cic, none, none, "row").count() == 20
    assert labels == ["layer2-chosen"]
