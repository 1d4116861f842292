"""Scalar functions, predicates and projections over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import net, numbers, records, text
from ..operators import harmonise
from .bindings import DAY, HOUR, PE, packets_e, rounded, table
from .registry import query

# Two made endpoints for each event: 10.0.x.x and 192.168.x.x
EP = "ep AS (SELECT event_id, 167772160 + user_id AS a_ip, CAST(event_id % 5 AS INT) AS a_port, 167772160 + event_id % 211 AS b_ip, CAST(80 + event_id % 3 AS INT) AS b_port FROM events)"


def endpoints(spark, d):
    e = table(spark, d, "events")
    return e.select(
        "event_id", (F.lit(167772160) + F.col("user_id")).alias("a_ip"), (F.col("event_id") % 5).cast("int").alias("a_port"),
        (F.lit(167772160) + F.col("event_id") % 211).alias("b_ip"), (F.lit(80) + F.col("event_id") % 3).cast("int").alias("b_port"),
    )


@query(
    "p01_canonical_key",
    f"WITH {EP} SELECT event_id, CASE WHEN (a_ip, a_port) <= (b_ip, b_port) THEN a_ip ELSE b_ip END AS low_ip, CASE WHEN (a_ip, a_port) <= (b_ip, b_port) THEN a_port ELSE b_port END AS low_port, "
    "CASE WHEN (a_ip, a_port) <= (b_ip, b_port) THEN b_ip ELSE a_ip END AS high_ip, CASE WHEN (a_ip, a_port) <= (b_ip, b_port) THEN b_port ELSE a_port END AS high_port FROM ep",
)
def p01(spark, d):
    return endpoints(spark, d).select("event_id", net.canonical_key(F.col("a_ip"), F.col("a_port"), F.col("b_ip"), F.col("b_port")).alias("k")).select("event_id", "k.*")


@query("p02_direction", f"WITH {PE} SELECT idx, CASE WHEN wire % 2 = first_value(wire % 2) OVER (PARTITION BY k ORDER BY idx) THEN 'forward' ELSE 'reverse' END AS direction FROM pe")
def p02(spark, d):
    from pyspark.sql import Window as W

    side = F.col("wire_length") % 2
    first = F.first(side).over(W.partitionBy("k").orderBy("idx"))
    return packets_e(spark, d).select("idx", F.when(side == first, "forward").otherwise("reverse").alias("direction"))


@query("p03_destination_port", f"WITH {EP} SELECT event_id, CASE WHEN (a_ip, a_port) = (b_ip, b_port) THEN a_port ELSE b_port END AS dst_port FROM ep")
def p03(spark, d):
    e = endpoints(spark, d)
    key = net.canonical_key(F.col("a_ip"), F.col("a_port"), F.col("b_ip"), F.col("b_port"))
    return e.select("event_id", net.destination_port(key, F.col("a_ip"), F.col("a_port")).alias("dst_port"))


@query(
    "p04_ipv4_text",
    f"WITH {EP} SELECT event_id, concat_ws('.', (a_ip >> 24) & 255, (a_ip >> 16) & 255, (a_ip >> 8) & 255, a_ip & 255) AS ip_text, a_ip AS ip_value FROM ep",
)
def p04(spark, d):
    e = endpoints(spark, d).withColumn("ip_text", net.long_to_ip(F.col("a_ip")))
    return e.select("event_id", "ip_text", net.ip_to_long(F.col("ip_text")).alias("ip_value"))


@query("p05_private_source", "SELECT event_id, (event_id * 9973 % 4294967296) BETWEEN 167772160 AND 184549375 OR (event_id * 9973 % 4294967296) BETWEEN 2886729728 AND 2887778303 OR (event_id * 9973 % 4294967296) BETWEEN 3232235520 AND 3232301055 OR (event_id * 9973 % 4294967296) BETWEEN 2130706432 AND 2147483647 AS is_private FROM events")
def p05(spark, d):
    return table(spark, d, "events").select("event_id", net.in_networks(F.col("event_id") * 9973 % 4294967296).alias("is_private"))


@query(
    "p06_drop_noise",
    "SELECT event_id FROM events WHERE NOT (event_id % 17 IN (3, 4)) AND NOT (event_id % 3 = 0 AND event_id % 7 IN (0, 1))",
)
def p06(spark, d):
    e = table(spark, d, "events")
    ip = F.when(F.col("event_id") % 17 == 3, "224.0.0.251").when(F.col("event_id") % 17 == 4, "239.1.1.1").otherwise("10.0.0.1")
    port = F.when(F.col("event_id") % 7 == 0, 53).when(F.col("event_id") % 7 == 1, 1900).otherwise(443)
    proto = F.when(F.col("event_id") % 3 == 0, 17).otherwise(6)
    return e.filter(~net.is_noise(ip, port, proto)).select("event_id")


@query("p07_scope_filter", f"WITH {EP} SELECT count(*) FILTER (a_ip < 167772235 AND b_ip < 167772270) AS in_scope, count(*) FILTER (NOT (a_ip < 167772235 AND b_ip < 167772270)) AS ambient FROM ep")
def p07(spark, d):
    inside = (F.col("a_ip") < 167772235) & (F.col("b_ip") < 167772270)
    return endpoints(spark, d).agg(F.count_if(inside).alias("in_scope"), F.count_if(~inside).alias("ambient"))


@query("p08_tcp_flags", "SELECT event_id, (event_id & 1) <> 0 AS fin, (event_id & 2) <> 0 AS syn, (event_id & 4) <> 0 AS rst, (event_id & 8) <> 0 AS psh, (event_id & 16) <> 0 AS ack FROM events")
def p08(spark, d):
    return table(spark, d, "events").select("event_id", *[net.has_flag(F.col("event_id"), n).alias(n.lower()) for n in ("FIN", "SYN", "RST", "PSH", "ACK")])


@query(
    "p09_local_time",
    "SELECT o_orderkey, epoch_us(o_orderdate + INTERVAL 9 HOUR + INTERVAL 5 MINUTE) * 1000 + 4 * 3600 * 1000000000::BIGINT AS start_ns FROM orders WHERE month(o_orderdate) IN (1, 2, 12)",
)
def p09(spark, d):
    o = table(spark, d, "orders").filter(F.month("o_orderdate").isin(1, 2, 12))
    written = F.concat_ws("/", F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate"))
    shown = F.concat(written, F.when(F.col("o_orderkey") % 2 == 0, " 9:05:00").otherwise(" 9:05"))
    return o.select("o_orderkey", records.parse_local_time(shown).alias("start_ns"))


@query(
    "p10_time_variants",
    f"WITH {PE}, h AS (SELECT idx, ts, (ts // 3600000000000) % 24 AS hour FROM pe) SELECT idx, 'as_written' AS variant, ts AS ns FROM h UNION ALL SELECT idx, 'plus_12h', ts + 43200000000000 FROM h WHERE hour BETWEEN 1 AND 11",
)
def p10(spark, d):
    h = F.floor(F.col("timestamp_ns") / HOUR).cast("long") % 24
    p = packets_e(spark, d).select("idx", F.explode(records.time_variants(F.col("timestamp_ns"), h)).alias("v"))
    return p.select("idx", "v.variant", "v.ns")


@query(
    "p11_label_bounds",
    f"WITH {PE} SELECT idx, ts AS start_min_ns, ts + (CASE WHEN idx % 2 = 0 THEN 1 ELSE 60 END)::BIGINT * 1000000000 AS start_max_ns, ts + wire * 1000 AS end_min_ns, ts + (CASE WHEN idx % 2 = 0 THEN 1 ELSE 60 END)::BIGINT * 1000000000 + wire * 1000 AS end_max_ns FROM pe",
)
def p11(spark, d):
    res = F.when(F.col("idx") % 2 == 0, 1).otherwise(60)
    return packets_e(spark, d).select("idx", *[c.alias(n) for n, c in records.label_bounds(F.col("timestamp_ns"), res, F.col("wire_length")).items()])


@query(
    "p12_audit_flags",
    f"""WITH {PE}, s AS (SELECT DISTINCT k % 7 AS case_id, ts // {DAY} * {DAY} + (k % 7) * {HOUR} AS s0, ts // {DAY} * {DAY} + (k % 7 + 3) * {HOUR} AS s1 FROM pe WHERE k < 20)
SELECT idx, NOT coalesce(bool_or(ts < s1 + 60000000000 AND ts + wire * 1000000 >= s0), FALSE) AS schedule_conflict, NOT (k % 3 = 0 OR k % 5 = 0) AS role_conflict FROM pe LEFT JOIN s ON s.case_id = pe.k % 7 GROUP BY idx, k""",
)
def p12(spark, d):
    from ..operators.labels import audit_flags

    p = packets_e(spark, d).withColumn("case_id", F.col("k") % 7)
    day = F.floor(F.col("timestamp_ns") / F.lit(DAY)).cast("long") * F.lit(DAY)
    s = p.filter("k < 20").select("case_id", (day + F.col("case_id") * F.lit(HOUR)).alias("start_ns"), (day + (F.col("case_id") + 3) * F.lit(HOUR)).alias("end_ns")).distinct()
    rows = p.select("idx", "case_id", F.col("timestamp_ns").alias("from_ns"), (F.col("timestamp_ns") + F.col("wire_length") * 1_000_000).alias("to_ns"), F.array(F.col("k") % 3, F.col("k") % 5 + 100).alias("hosts"))
    return audit_flags(rows, s, ["idx"], "case_id", F.array(F.lit(0), F.lit(100)).cast("array<bigint>"))


@query(
    "p13_strict_integers",
    "SELECT event_id, CASE WHEN regexp_full_match(s, '[0-9]+') AND TRY_CAST(s AS BIGINT) <= 5000 THEN TRY_CAST(s AS BIGINT) END AS n FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '-' || event_id ELSE event_id || '.0' END AS s FROM events)",
)
def p13(spark, d):
    s = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("-"), "event_id")).otherwise(F.concat("event_id", F.lit(".0")))
    return table(spark, d, "events").select("event_id", numbers.strict_long(s, 5000).alias("n"))


@query("p14_quarantine", "SELECT CASE WHEN event_id % 6 = 0 THEN 'unsupported_protocol' WHEN value < 5 THEN 'negative_duration' END AS reason, count(*) AS n FROM events GROUP BY 1")
def p14(spark, d):
    reason = records.quarantine_reason(F.when(F.col("event_id") % 6 == 0, 0).otherwise(6), F.when(F.col("value") < 5, -1).otherwise(1))
    return table(spark, d, "events").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("p15_safe_divide", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_tax > 0 THEN l_discount / l_tax ELSE 0 END, 6) AS ratio, round(CASE WHEN l_discount > 0 THEN l_quantity * 1e6 / l_discount ELSE 0 END, 2) AS per_second FROM lineitem")
def p15(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(numbers.safe_divide(F.col("l_discount"), F.col("l_tax")), 6).alias("ratio"), F.round(numbers.rate(F.col("l_quantity"), F.col("l_discount")), 2).alias("per_second"))


MAG = "CASE " + " ".join(f"WHEN abs(v) < {b} THEN '{n}'" for b, n in numbers.MAGNITUDES) + f" ELSE '{numbers.LARGEST}' END"


@query("p16_signed_bucket", f"SELECT CASE WHEN v = 0 THEN 'zero' WHEN v < 0 THEN 'negative:' || {MAG} ELSE 'positive:' || {MAG} END AS bucket, count(*) AS n FROM (SELECT (event_id % 41 - 20) * (event_id * event_id * event_id % 9999999967) AS v FROM events) GROUP BY 1")
def p16(spark, d):
    i, m = F.col("event_id"), 9999999967
    rest = (i % m).cast("decimal(11, 0)")  # the cube passes 64 bits
    square = (rest * rest % m).cast("decimal(11, 0)")
    return table(spark, d, "events").select(numbers.signed_bucket((i % 41 - 20) * (square * rest % m).cast("bigint")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query(
    "p17_buckets",
    f"WITH {PE} SELECT CASE WHEN v BETWEEN 0 AND 0 THEN '0' WHEN v BETWEEN 1 AND 15 THEN '1-15' WHEN v BETWEEN 16 AND 31 THEN '16-31' WHEN v BETWEEN 32 AND 63 THEN '32-63' WHEN v BETWEEN 64 AND 127 THEN '64-127' WHEN v BETWEEN 128 AND 255 THEN '128-255' "
    "WHEN v BETWEEN 256 AND 511 THEN '256-511' WHEN v BETWEEN 512 AND 1023 THEN '512-1023' WHEN v BETWEEN 1024 AND 1499 THEN '1024-1499' WHEN v BETWEEN 1500 AND 65535 THEN '1500-65535' ELSE '>65535' END AS payload, "
    "CASE WHEN k < 2 THEN '1' WHEN k < 3 THEN '2' WHEN k < 6 THEN '3-5' WHEN k < 11 THEN '6-10' WHEN k < 101 THEN '11-100' ELSE '>100' END AS candidates, count(*) AS n FROM (SELECT k, CASE WHEN idx % 7 = 0 THEN wire * 100 WHEN idx % 7 < 3 THEN wire % 40 ELSE wire END AS v FROM pe) GROUP BY 1, 2",
)
def p17(spark, d):
    i, wire = F.col("idx"), F.col("wire_length")
    p = packets_e(spark, d).withColumn("v", F.when(i % 7 == 0, wire * 100).when(i % 7 < 3, wire % 40).otherwise(wire))
    return p.groupBy(numbers.payload_bucket(F.col("v")).alias("payload"), numbers.candidate_bucket(F.col("k")).alias("candidates")).agg(F.count("*").alias("n"))


@query(
    "p18_entropy",
    "WITH c AS (SELECT page_id, unnest(string_split(url, '')) AS ch FROM pages), n AS (SELECT page_id, ch, count(*) AS n FROM c GROUP BY 1, 2), t AS (SELECT page_id, n, sum(n) OVER (PARTITION BY page_id) AS t FROM n) SELECT page_id, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM t GROUP BY page_id",
)
def p18(spark, d):
    return table(spark, d, "pages").select("page_id", F.round(text.entropy(F.col("url")), 6).alias("entropy"))


@query(
    "p19_ratios",
    """SELECT page_id, round((length(u) - length(translate(u, chr(39) || '";<>()%\\|&=', ''))) / length(u), 6) AS special_ratio, round(length(regexp_replace(u, '[A-Za-z0-9]', '', 'g')) / length(u), 6) AS non_alnum_ratio FROM (SELECT page_id, url || left(html, 200) AS u FROM pages)""",
)
def p19(spark, d):
    u = F.concat("url", F.left("html", F.lit(200)))
    return table(spark, d, "pages").select("page_id", F.round(text.special_ratio(u), 6).alias("special_ratio"), F.round(text.non_alnum_ratio(u), 6).alias("non_alnum_ratio"))


#: Requests with one sign of an attack each, chosen by page.
SIGNS = (
    "", "?q=1 UNION  select x", "?a=select b from c", "?x=1 or 1=1", "?c=1-- x", "/*a*/", "<ScRipt>", "?onerror =1", "?onload=1", "?alert(1)", "?javascript:x", "/../../x", "/etc/passwd", "/etc/shadow", "?a=1; wget x", "?exec(x)",
    "?system(x)", "?a|| ls", "?`id`", "?a=1;rm -rf", "?cmd.exe%27",
)
SIGNS_SQL = "['" + "', '".join(SIGNS) + "']"
SUSPECT = r"(?i)(?:union\s+select|select\s+.+from|or\s+1=1|--\s|/\*|<script|onerror\s*=|onload\s*=|alert\(|javascript:|\.\./|/etc/passwd|/etc/shadow|;\s*(?:rm|wget|curl|nc|bash|sh)\s|exec\(|system\(|\|\|\s*\w+|`[^`]+`)"


def request(i):
    return F.concat("url", F.get(F.array(*map(F.lit, SIGNS)), (i % len(SIGNS)).cast("int")))


REQUEST = f"url || {SIGNS_SQL}[page_id % {len(SIGNS)} + 1]"


@query("p20_suspicious_tokens", f"SELECT page_id, len(regexp_extract_all({REQUEST} || left(html, 2000), '{SUSPECT}'))::BIGINT AS n FROM pages")
def p20(spark, d):
    return table(spark, d, "pages").select("page_id", text.suspicious_count(F.concat(request(F.col("page_id")), F.left("html", F.lit(2000)))).alias("n"))


HOST = "regexp_extract(url, '://([^/?#]*)', 1)"


@query(
    "p21_dns_features",
    f"""WITH q AS (SELECT page_id, {HOST} AS q, CASE page_id % 12 WHEN 0 THEN 'A' WHEN 1 THEN 'AAAA' WHEN 2 THEN 'TXT' WHEN 3 THEN 'CNAME' WHEN 4 THEN 'MX' WHEN 5 THEN 'NS' WHEN 6 THEN 'SOA' WHEN 7 THEN 'PTR' WHEN 8 THEN 'SRV' WHEN 9 THEN 'ANY' WHEN 10 THEN '-' ELSE 'aaaa' END AS t,
CASE page_id % 7 WHEN 0 THEN 'NOERROR' WHEN 1 THEN 'NXDOMAIN' WHEN 2 THEN 'SERVFAIL' WHEN 3 THEN 'REFUSED' WHEN 4 THEN 'NOTIMP' WHEN 5 THEN '-' ELSE 'refused' END AS r, repeat('1.2.3.4,', (page_id % 4)::INT) AS a FROM pages),
c AS (SELECT page_id, unnest(string_split(q, '')) AS ch FROM q), n AS (SELECT page_id, ch, count(*) AS n FROM c GROUP BY 1, 2),
e AS (SELECT page_id, -sum(n / t * log2(n / t)) AS h FROM (SELECT page_id, n, sum(n) OVER (PARTITION BY page_id) AS t FROM n) GROUP BY 1)
SELECT page_id, length(q)::INT AS query_len, round(h, 4) AS query_entropy, (length(q) - length(replace(q, '.', '')) + 1)::INT AS subdomain_count,
(CASE upper(CASE t WHEN '-' THEN 'A' ELSE t END) WHEN 'A' THEN 0 WHEN 'AAAA' THEN 1 WHEN 'TXT' THEN 2 WHEN 'CNAME' THEN 3 WHEN 'MX' THEN 4 WHEN 'NS' THEN 5 WHEN 'SOA' THEN 6 WHEN 'PTR' THEN 7 WHEN 'SRV' THEN 8 ELSE 9 END)::INT AS qtype_enc,
(CASE upper(CASE r WHEN '-' THEN 'NOERROR' ELSE r END) WHEN 'NOERROR' THEN 0 WHEN 'NXDOMAIN' THEN 1 WHEN 'SERVFAIL' THEN 2 WHEN 'REFUSED' THEN 3 ELSE 4 END)::INT AS rcode_enc,
(CASE WHEN a = '' THEN 0 ELSE length(a) - length(replace(a, ',', '')) + 1 END)::INT AS answer_count, length(a)::INT AS resp_size, round(length(regexp_replace(q, '[A-Za-z0-9]', '', 'g')) / length(q), 4) AS query_special_ratio FROM q JOIN e USING (page_id)""",
)
def p21(spark, d):
    i = F.col("page_id")
    of = lambda names: F.get(F.array(*map(F.lit, names)), (i % len(names)).cast("int"))
    f = text.dns_features(
        F.regexp_extract("url", "://([^/?#]*)", 1), of(["A", "AAAA", "TXT", "CNAME", "MX", "NS", "SOA", "PTR", "SRV", "ANY", "-", "aaaa"]),
        of(["NOERROR", "NXDOMAIN", "SERVFAIL", "REFUSED", "NOTIMP", "-", "refused"]), F.repeat(F.lit("1.2.3.4,"), (i % 4).cast("int")),
    )
    return rounded(table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in f.items()]))


@query(
    "p22_http_features",
    f"""WITH q AS (SELECT page_id, {REQUEST} AS u, CASE WHEN page_id % 6 = 0 THEN '-' ELSE {HOST} END AS host, left(html, (page_id % 300)::INT) AS ua,
CASE page_id % 8 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'DELETE' WHEN 4 THEN 'HEAD' WHEN 5 THEN 'OPTIONS' WHEN 6 THEN '-' ELSE 'post' END AS m, length(html) AS hb FROM pages),
c AS (SELECT page_id, unnest(string_split(ua, '')) AS ch FROM q WHERE ua <> ''), n AS (SELECT page_id, ch, count(*) AS n FROM c GROUP BY 1, 2),
e AS (SELECT page_id, -sum(n / t * log2(n / t)) AS h FROM (SELECT page_id, n, sum(n) OVER (PARTITION BY page_id) AS t FROM n) GROUP BY 1)
SELECT page_id, length(u)::INT AS uri_len, round((length(u) - length(translate(u, chr(39) || '";<>()%\\|&=', ''))) / length(u), 4) AS uri_special_ratio, len(regexp_extract_all(u, '{SUSPECT}'))::BIGINT AS uri_token_hits,
(CASE upper(CASE m WHEN '-' THEN 'GET' ELSE m END) WHEN 'GET' THEN 0 WHEN 'POST' THEN 1 WHEN 'PUT' THEN 2 WHEN 'DELETE' THEN 3 WHEN 'HEAD' THEN 4 ELSE 5 END)::INT AS method_enc,
(CASE page_id % 5 WHEN 4 THEN 0 ELSE 200 + 100 * (page_id % 5) END)::DOUBLE AS status_code, page_id::DOUBLE AS req_body_len, hb::DOUBLE AS resp_body_len, length(ua)::INT AS ua_len, round(coalesce(h, 0) + 0.0, 4) AS ua_entropy,
(CASE WHEN host IN ('', '-') THEN 0 ELSE 1 END)::DOUBLE AS host_present, (CASE WHEN page_id % 5 = 0 THEN 0 ELSE 1 END)::DOUBLE AS referrer_present FROM q LEFT JOIN e USING (page_id)""",
)
def p22(spark, d):
    i = F.col("page_id")
    of = lambda names: F.get(F.array(*map(F.lit, names)), (i % len(names)).cast("int"))
    f = text.http_features(
        of(["GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "-", "post"]), request(i), F.when(i % 6 == 0, "-").otherwise(F.regexp_extract("url", "://([^/?#]*)", 1)), F.left("html", (i % 300).cast("int")),
        F.when(i % 5 != 0, "ref"), F.when(i % 5 == 4, "-").otherwise((F.lit(200) + 100 * (i % 5)).cast("string")), i.cast("string"), F.length("html").cast("string"),
    )
    return rounded(table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in f.items()]))


STATES = ("SF", "S0", "REJ", "S1", "S2", "S3", "RSTO", "RSTR", "RSTOS0", "RSTRH", "SH", "SHR", "OTH", "sf", "??")
STATE_SQL = "CASE event_id % 15 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(STATES)) + " END"
STATE_CODE = "CASE {0} WHEN 'SF' THEN 0 WHEN 'S0' THEN 1 WHEN 'REJ' THEN 2 WHEN 'S1' THEN 3 WHEN 'S2' THEN 4 WHEN 'S3' THEN 5 WHEN 'RSTO' THEN 6 WHEN 'RSTR' THEN 7 WHEN 'RSTOS0' THEN 8 WHEN 'RSTRH' THEN 9 WHEN 'SH' THEN 10 WHEN 'SHR' THEN 11 ELSE 12 END"


@query(
    "p23_conn_features",
    f"""WITH q AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE value END AS dur, user_id * 10.0::DOUBLE AS ob, CASE WHEN event_id % 8 = 0 THEN 0 ELSE event_id % 1000 END::DOUBLE AS rb, (user_id % 9)::DOUBLE AS op, (event_id % 7)::DOUBLE AS rp, {STATE_SQL} AS st, event_id % 11 AS cp, event_id % 13 AS cs FROM events)
SELECT event_id, round(dur * 1e6, 4) AS flow_dur_us, ob AS fwd_bytes, rb AS bwd_bytes, op AS fwd_pkts, rp AS bwd_pkts, 0.0::DOUBLE AS src_ttl, 0.0::DOUBLE AS dst_ttl, round(ob * 8 / greatest(dur, 1e-9), 4) AS sload, round(rb * 8 / greatest(dur, 1e-9), 4) AS dload,
({STATE_CODE.format("st")})::INT AS state_enc, cp AS ct_dst_sport_ltm, cs AS ct_srv_dst, 1::INT AS src FROM q""",
)
def p23(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    state = F.get(F.array(*map(F.lit, STATES)), (i % 15).cast("int"))
    s = lambda c: c.cast("string")
    f = text.conn_features(F.when(i % 9 == 0, "-").otherwise(s(F.col("value"))), s(u * 10), F.when(i % 8 == 0, "(empty)").otherwise(s(i % 1000)), s(u % 9), s(i % 7), state, i % 11, i % 13)
    return rounded(table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in f.items()]))


CODED = ("get", "POST", "PUT", "DELETE", "HEAD", "PATCH", "A", "aaaa", "TXT", "CNAME", "MX", "NS", "SOA", "PTR", "SRV", "ANY", "NOERROR", "nxdomain", "SERVFAIL", "REFUSED", "FORMERR", *STATES)


@query(
    "p24_code_maps",
    "WITH q AS (SELECT ['" + "', '".join(CODED) + f"""'][event_id % {len(CODED)} + 1] AS name FROM events) SELECT name,
(CASE upper(name) WHEN 'GET' THEN 0 WHEN 'POST' THEN 1 WHEN 'PUT' THEN 2 WHEN 'DELETE' THEN 3 WHEN 'HEAD' THEN 4 ELSE 5 END)::INT AS method,
(CASE upper(name) WHEN 'A' THEN 0 WHEN 'AAAA' THEN 1 WHEN 'TXT' THEN 2 WHEN 'CNAME' THEN 3 WHEN 'MX' THEN 4 WHEN 'NS' THEN 5 WHEN 'SOA' THEN 6 WHEN 'PTR' THEN 7 WHEN 'SRV' THEN 8 ELSE 9 END)::INT AS qtype,
(CASE upper(name) WHEN 'NOERROR' THEN 0 WHEN 'NXDOMAIN' THEN 1 WHEN 'SERVFAIL' THEN 2 WHEN 'REFUSED' THEN 3 ELSE 4 END)::INT AS rcode, ({STATE_CODE.format("name")})::INT AS state, count(*) AS n FROM q GROUP BY ALL""",
)
def p24(spark, d):
    name = F.get(F.array(*map(F.lit, CODED)), (F.col("event_id") % len(CODED)).cast("int"))
    n = F.col("name")
    codes = [text.method_code(n).alias("method"), text.query_type_code(n).alias("qtype"), text.response_code(n).alias("rcode"), text.conn_state_code(n).alias("state")]
    return table(spark, d, "events").select(name.alias("name")).groupBy("name", *codes).agg(F.count("*").alias("n"))


@query("p25_factorize", "WITH f AS (SELECT coalesce(event_type, 'nan') AS v, min(event_id) AS m FROM events GROUP BY 1), r AS (SELECT v, (row_number() OVER (ORDER BY m) - 1)::INT AS code FROM f) SELECT event_id, code FROM events JOIN r ON coalesce(event_type, 'nan') = v")
def p25(spark, d):
    return harmonise.factorize(table(spark, d, "events"), "event_type", "event_id").select("event_id", "code")


@query("p26_clean_numbers", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 ELSE value END AS x FROM events")
def p26(spark, d):
    i = F.col("event_id") % 4
    raw = F.when(i == 0, F.lit(float("nan"))).when(i == 1, F.lit(float("-inf"))).when(i == 3, F.col("value"))
    return table(spark, d, "events").select("event_id", numbers.finite_or_zero(raw).alias("x"))


@query("p27_binary_label", "SELECT event_id, (CASE WHEN lower(trim(event_type)) <> 'view' THEN 1 ELSE 0 END)::INT AS y FROM events")
def p27(spark, d):
    return table(spark, d, "events").select("event_id", records.binary_label(F.concat(F.lit(" "), F.upper("event_type")), "View").alias("y"))


# Raw datasets made of the given tables, under the datasets' own column names.


def cic_raw(spark, d, *more):
    li = table(spark, d, "lineitem")
    c = {
        " Destination Port": F.col("l_linenumber"), "Flow Duration": F.col("l_orderkey"), "Total Fwd Packets": F.col("l_quantity"), "Total Length of Fwd Packets": F.col("l_extendedprice"), "Min Packet Length": F.col("l_suppkey"),
        "Average Packet Size": F.col("l_partkey"), "Flow Bytes/s": F.when(F.col("l_linenumber") == 7, float("inf")).otherwise(F.col("l_extendedprice") * 2), "PSH Flag Count": (F.col("l_linestatus") == "O").cast("int"),
        "Init_Win_bytes_forward": F.when(F.col("l_returnflag") != "A", F.col("l_partkey")), "Active Mean": F.col("l_tax"), "Idle Max": F.col("l_discount"), "Attack Type": F.when(F.col("l_returnflag") == "N", "Normal Traffic ").otherwise("DoS"),
    }
    return li.select(*[x.alias(n) for n, x in c.items()], *more)


def unsw_raw(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    c = {
        "id": k, "dur": k % 97 / 10.0, "spkts": k % 11, "dpkts": k % 13, "sbytes": F.col("o_totalprice"), "dbytes": F.col("o_custkey"), "smean": k % 1400, "sload": F.when(k % 5 != 0, F.col("o_totalprice") * 8), "dload": F.col("o_custkey") * 8,
        "swin": k % 256, "sttl": k % 255, "dttl": k % 64, "proto": k % 4, "state": k % 3, "ct_dst_sport_ltm": k % 17, "ct_srv_dst": k % 19, "y": (F.col("o_orderstatus") == "F").cast("int"),
    }
    return o.select(*[x.alias(n) for n, x in c.items()])


def botiot_raw(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    c = {
        "L4_DST_PORT": F.col("user_id"), "flow_dur_us": F.when(i % 6 == 0, 0.0).otherwise(F.col("value") * 1000), "IN_PKTS": i % 5, "OUT_PKTS": i % 3, "IN_BYTES": i % 5 * 60, "OUT_BYTES": i % 3 * 40 + i % 2, "psh_flag": i % 2, "ack_flag": (i % 4 > 0).cast("int"),
        "fin_flag": (i % 9 == 0).cast("int"), "PROTOCOL": F.when(i % 2 == 0, 6).otherwise(17), "y": (F.col("event_type") == "error").cast("int"),
    }
    return e.select(*[x.alias(n) for n, x in c.items()])


UNSW_SQL = "unsw AS (SELECT o_orderkey AS k, o_totalprice::DOUBLE AS price, o_custkey AS cust, (o_orderstatus = 'F')::INT AS y FROM orders)"
BOT_SQL = """bot AS (SELECT user_id AS port, CASE WHEN event_id % 6 = 0 THEN 0.0 ELSE value * 1000 END AS dur, event_id % 5 AS ip, event_id % 3 AS op, event_id % 5 * 60 AS ib, event_id % 3 * 40 + event_id % 2 AS ob, event_id % 2 AS psh, (event_id % 4 > 0)::INT AS ack,
(event_id % 9 = 0)::INT AS fin, CASE WHEN event_id % 2 = 0 THEN 6 ELSE 17 END AS proto, (event_type = 'error')::INT AS y FROM events)"""


LAYER2_SQL = """SELECT l_linenumber::DOUBLE AS dst_port, l_orderkey::DOUBLE AS flow_dur_us, l_quantity::DOUBLE AS fwd_pkts, l_extendedprice::DOUBLE AS fwd_bytes, 0.0::DOUBLE AS bwd_pkts, 0.0::DOUBLE AS bwd_bytes, l_suppkey::DOUBLE AS pkt_len_min, l_partkey::DOUBLE AS pkt_len_avg,
  CASE WHEN l_linenumber = 7 THEN 0.0 ELSE (l_extendedprice::DOUBLE * 2) END AS flow_bytes_s, (l_linestatus = 'O')::INT::DOUBLE AS psh_flag, 0.0::DOUBLE AS ack_flag, 0.0::DOUBLE AS fin_flag, CASE WHEN l_returnflag <> 'A' THEN l_partkey ELSE 0 END::DOUBLE AS init_win_fwd,
  l_tax::DOUBLE AS active_mean, 0.0::DOUBLE AS protocol_enc, (l_returnflag <> 'N')::INT AS y, 0::INT AS src FROM lineitem
UNION ALL SELECT 0, (k % 97 / 10.0::DOUBLE * 1e6), k % 11, price, k % 13, cust, k % 1400, k % 1400, CASE WHEN k % 5 <> 0 THEN (price * 8) ELSE 0 END, 0, 0, 0, k % 256, 0, k % 4, y, 1 FROM unsw
UNION ALL SELECT port, dur, ip, ib, op, ob, (ib / (CASE ip WHEN 0 THEN 1 ELSE ip END)), ((ib + ob) / (CASE ip + op WHEN 0 THEN 1 ELSE ip + op END)), CASE WHEN dur = 0 THEN 0 ELSE ((ib + ob) / (dur / 1e6)) END, psh, ack, fin, 0, 0, proto, y, 2 FROM bot"""


@query("p28_layer2", f"WITH {UNSW_SQL}, {BOT_SQL}, m AS ({LAYER2_SQL}) SELECT {', '.join(f'round({c}, 4) AS {c}' for c in harmonise.LAYER2)}, y, src FROM m")
def p28(spark, d):
    return rounded(harmonise.layer2(harmonise.clean_cic(cic_raw(spark, d)), unsw_raw(spark, d), botiot_raw(spark, d)))


LINE_NAME = "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@query(
    "p28_layer2_training",
    f"WITH {UNSW_SQL}, {BOT_SQL}, li AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag <> 'N' ORDER BY sha256({LINE_NAME}), {LINE_NAME}) AS i, count(*) OVER (PARTITION BY l_returnflag <> 'N') AS n FROM lineitem) WHERE i <= floor(n * 0.2)), "
    f"m AS ({LAYER2_SQL.replace('FROM lineitem', 'FROM li')}), q AS (SELECT {', '.join(f'quantile_cont({c}, 0.999) AS {c}' for c in harmonise.LAYER2)} FROM m) SELECT {', '.join(f'round(least(m.{c}, q.{c}), 3) AS {c}' for c in harmonise.LAYER2)}, y, src FROM m, q",
)
def p28_training(spark, d):
    """The layer as it is trained on: a fifth of the CIC rows by class, features cut at their 0.999 quantile."""
    cic = harmonise.clean_cic(cic_raw(spark, d, F.expr(LINE_NAME).alias("row")))
    return rounded(harmonise.layer2_training(cic, unsw_raw(spark, d), botiot_raw(spark, d), "row"), 3)


@query(
    "p29_layer3",
    f"""WITH {UNSW_SQL}, {BOT_SQL}
SELECT round(k % 97 / 10.0::DOUBLE * 1e6, 4) AS flow_dur_us, round(price, 4) AS fwd_bytes, cust::DOUBLE AS bwd_bytes, (k % 11)::DOUBLE AS fwd_pkts, (k % 13)::DOUBLE AS bwd_pkts, (k % 255)::DOUBLE AS src_ttl, (k % 64)::DOUBLE AS dst_ttl, CASE WHEN k % 5 <> 0 THEN round(price * 8, 4) ELSE 0 END AS sload,
  (cust * 8)::DOUBLE AS dload, (k % 3)::DOUBLE AS state_enc, (k % 17)::DOUBLE AS ct_dst_sport_ltm, (k % 19)::DOUBLE AS ct_srv_dst, y, 1::INT AS src FROM unsw
UNION ALL SELECT round(dur, 4), ib, ob, ip, op, 0, 0, CASE WHEN dur = 0 THEN 0 ELSE round(ib * 8 / (dur / 1e6), 4) END, CASE WHEN dur = 0 THEN 0 ELSE round(ob * 8 / (dur / 1e6), 4) END, 0, 0, 0, y, 2 FROM bot""",
)
def p29(spark, d):
    return rounded(harmonise.layer3(unsw_raw(spark, d), botiot_raw(spark, d)))


@query("p30_layer1", "SELECT l_linenumber::DOUBLE AS dst_port, (l_orderkey % 65536)::DOUBLE AS nat_src_port, round(l_extendedprice::DOUBLE, 4) AS total_bytes, l_quantity::DOUBLE AS pkt_count, (l_partkey % 50)::DOUBLE AS pkts_sent, (l_returnflag <> 'N')::INT AS y, 0::INT AS src FROM lineitem")
def p30(spark, d):
    c = {
        "Source Port": F.col("l_suppkey"), "Destination Port ": F.col("l_linenumber"), "NAT Source Port": F.col("l_orderkey") % 65536, "Action": F.when(F.col("l_returnflag") == "N", " Allow").otherwise("deny"),
        "Bytes": F.col("l_extendedprice"), "Packets": F.col("l_quantity"), "pkts_sent": F.col("l_partkey") % 50,
    }
    raw = table(spark, d, "lineitem").select(*[x.alias(n) for n, x in c.items()])
    return rounded(harmonise.layer1(harmonise.clean_firewall(raw)))


CLASSES = ("BENIGN", "FTP-Patator", "SSH-Patator", "PortScan", "DDoS", "DoS GoldenEye", "DoS Hulk", "DoS Slowhttptest", "DoS slowloris", "Bot", "Infiltration", "Web Attack – Brute Force", "Web Attack – Sql Injection", "Web Attack – XSS")
CLASS_SQL = "['" + "', '".join(CLASSES) + "'][event_id % 14 + 1]"


@query(
    "p31_family_map",
    f"SELECT event_id, CASE c WHEN 'BENIGN' THEN 'Benign' WHEN 'FTP-Patator' THEN 'FTP-Bruteforce' WHEN 'SSH-Patator' THEN 'SSH-Bruteforce' WHEN 'PortScan' THEN 'PortScan' WHEN 'DDoS' THEN 'DoS' WHEN 'DoS GoldenEye' THEN 'DoS' WHEN 'DoS Hulk' THEN 'DoS' WHEN 'DoS Slowhttptest' THEN 'DoS' "
    f"WHEN 'DoS slowloris' THEN 'DoS' WHEN 'Bot' THEN 'Other' WHEN 'Infiltration' THEN 'Other' WHEN 'Web Attack – Brute Force' THEN 'Other' WHEN 'Web Attack – Sql Injection' THEN 'Other' WHEN 'Web Attack – XSS' THEN 'Other' END AS family FROM (SELECT event_id, {CLASS_SQL} AS c FROM events)",
)
def p31(spark, d):
    name = F.get(F.array(*map(F.lit, CLASSES)), (F.col("event_id") % 14).cast("int"))
    return table(spark, d, "events").select("event_id", records.family_of(name).alias("family"))


@query("p32_time_block", f"WITH {PE} SELECT idx, ts // {DAY} AS block, ts // {DAY} * {DAY} AS block_start_ns FROM pe")
def p32(spark, d):
    b = numbers.time_block(F.col("timestamp_ns"), DAY)
    return packets_e(spark, d).select("idx", b.alias("block"), (b * F.lit(DAY)).alias("block_start_ns"))


@query("p33_profiles", "SELECT CAST(l_quantity AS DOUBLE) AS f0, round(l_extendedprice, 4) AS f1, count(*) AS n FROM lineitem GROUP BY 1, 2")
def p33(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_quantity").alias("f0"), F.col("l_extendedprice").alias("f1"), F.col("l_discount").alias("f2"), F.col("l_tax").alias("f3"))
    cols = harmonise.prefix_profile(li.columns, {"A": 2, "B": 3, "C": 4}, "A")
    return rounded(li.select(*cols).groupBy(*cols).agg(F.count("*").alias("n")))


@query("p34_label_encodings", "SELECT event_id, (CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END)::INT AS y_binary, (CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END)::INT AS y_class, CASE WHEN event_type <> 'view' THEN (CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END)::INT END AS y_family FROM events")
def p34(spark, d):
    order = ["view", "click", "purchase", "signup", "error"]
    t = F.col("event_type")
    return table(spark, d, "events").select("event_id", records.binary_label(t, "view").alias("y_binary"), records.encode_label(t, order).alias("y_class"), F.when(t != "view", records.encode_label(t, order[1:])).alias("y_family"))


@query("p35_lifecycle", "SELECT lc AS lifecycle, count(*) AS n FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'udp' WHEN event_id % 7 = 0 THEN 'tcp_reset' WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'tcp_fin_handshake' ELSE 'tcp_other' END AS lc FROM events) GROUP BY 1")
def p35(spark, d):
    i = F.col("event_id")
    lc = net.lifecycle(F.when(i % 5 == 0, 17).otherwise(6), F.when(i % 7 == 0, 1).otherwise(0), i % 2 == 0, i % 3 == 0)
    return table(spark, d, "events").groupBy(lc.alias("lifecycle")).agg(F.count("*").alias("n"))


def made_flow(i, full):
    """Endpoints and protocol of a made alert line; parts are absent on some lines."""
    side = lambda ip, port: F.struct(ip.alias("ip"), port.alias("port"))
    protocol = F.when(i % 3 == 0, "tcp").when(i % 3 == 1, "")
    return F.when(full, F.struct(protocol.alias("protocol"), side(F.col("user_id").cast("string"), i % 100).alias("source"), side(F.when(i % 4 != 0, F.lit("10.0.0.1")), F.when(i % 8 != 0, F.lit(80))).alias("destination"))).alias("flow")


MADE_FLOW = """CASE WHEN event_id % 10 = 9 THEN 'None:None' ELSE user_id || ':' || (event_id % 100) END AS source, CASE WHEN event_id % 10 = 9 THEN 'None:None' ELSE CASE WHEN event_id % 4 <> 0 THEN '10.0.0.1' ELSE 'None' END || ':' || CASE WHEN event_id % 8 <> 0 THEN '80' ELSE 'None' END END AS destination,
  CASE WHEN event_id % 10 <> 9 AND event_id % 3 = 0 THEN 'TCP' ELSE '?' END AS protocol, event_id % 50 AS packet_count"""


@query("p36_alert_flatten", f"SELECT event_id, 'F9' AS model, CASE WHEN event_id % 7 <> 0 THEN event_type END AS decision, CASE WHEN event_id % 6 <> 0 THEN 'dos' END AS candidate, CASE WHEN event_id % 11 <> 0 THEN round(value / 1000, 6) END AS flow_rf_probability, CASE WHEN event_id % 6 <> 0 THEN round(value / 999, 6) END AS confidence, {MADE_FLOW} FROM events WHERE event_id % 5 <> 0")
def p36(spark, d):
    """Lines of a sensor, one in five of another event, some without a decision, scores, endpoints or protocol."""
    from ..operators.evidence import flatten_alerts

    i, v = F.col("event_id"), F.col("value")
    rf = F.when(i % 11 != 0, F.struct((v / 1000).alias("attack_probability"))).alias("flow_rf")
    family = F.when(i % 6 != 0, F.struct(F.lit("dos").alias("top_candidate"), (v / 999).alias("confidence"))).alias("known_family")
    line = F.struct(F.when(i % 5 == 0, "sensor_ready").otherwise("nids_alert").alias("event_type"), F.when(i % 7 != 0, F.col("event_type")).alias("decision"), (i % 50).alias("packet_count"), made_flow(i, i % 10 != 9), F.struct(rf, family).alias("evidence"))
    return flatten_alerts(table(spark, d, "events").select("event_id", F.to_json(line).alias("line")), "line")


@query(
    "p37_terminal_flatten",
    f"""SELECT event_id, 'terminal' AS model, CASE WHEN event_type = 'view' AND event_id % 7 <> 0 THEN 'benign' ELSE 'known_attack' END AS decision, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 6 <> 0 THEN 'web' END ELSE name END AS candidate, name AS terminal_class,
CASE WHEN event_id % 11 <> 0 THEN round(CASE WHEN event_id % 3 = 0 THEN value / 1000 ELSE value / 2000 END, 6) END AS flow_rf_probability, round(CASE WHEN event_id % 3 = 0 THEN value / 999 ELSE value / 1998 END, 6) AS confidence, {MADE_FLOW},
CASE WHEN event_id % 9 <> 0 THEN 'f9-' || user_id END AS attempt, 'idle_timeout' AS close_reason, event_id % 2 = 0 AS acceptance_eligible, CASE WHEN event_id % 3 = 0 THEN 'nids_terminal_flow_decision' ELSE 'nids_terminal_flow_alert' END AS source_event_type, event_id * 1000 AS timestamp_ns
FROM (SELECT *, CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_type = 'view' THEN ' Benign' ELSE event_type END END AS name FROM events) WHERE event_id % 3 < 2""",
)
def p37(spark, d):
    """Decisions, alerts and other lines of closed flows in turn."""
    from ..operators.evidence import flatten_terminal

    i, v = F.col("event_id"), F.col("value")
    score = F.when(i % 11 != 0, v / 1000)
    decided = F.struct(F.struct(F.when(i % 6 != 0, "web").alias("class_name")).alias("top_attack_candidate"), F.struct(score.alias("attack_score")).alias("attack_gate"), F.struct((v / 999).alias("class_confidence")).alias("gated_decision"))
    flat = F.struct((score / 2).alias("attack_score"), (v / 1998).alias("class_confidence"))
    event = F.when(i % 3 == 0, "nids_terminal_flow_decision").when(i % 3 == 1, "nids_terminal_flow_alert").otherwise("nids_alert")
    name = F.when(i % 7 != 0, F.when(F.col("event_type") == "view", " Benign").otherwise(F.col("event_type")))
    common = [event.alias("event_type"), name.alias("decision"), (i % 50).alias("packet_count"), made_flow(i, i % 10 != 9), F.when(i % 9 != 0, F.concat(F.lit("f9-"), "user_id")).alias("attempt_id"), F.lit("idle_timeout").alias("close_reason"), (i % 2 == 0).alias("acceptance_eligible"), (i * 1000).alias("last_event_timestamp_ns")]
    line = F.when(i % 3 == 0, F.to_json(F.struct(*common, decided.alias("scores")))).otherwise(F.to_json(F.struct(*common, flat.alias("scores"))))
    return flatten_terminal(table(spark, d, "events").select("event_id", line.alias("line")), "line")


RAW = "CASE event_id % 10 WHEN 0 THEN ' BENIGN' WHEN 1 THEN 'Uncertain' WHEN 2 THEN 'normal' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'no_alert' WHEN 6 THEN 'unknown' WHEN 7 THEN 'known_attack' WHEN 8 THEN 'none ' ELSE event_type END"
OTHER = "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Normal' ELSE 'dos' END"


def made_decision(i):
    """Decisions as logs have them: canonical names, classes, benign and uncertain words, empty and absent ones."""
    names = [" BENIGN", "Uncertain", "normal", "", None, "no_alert", "unknown", "known_attack", "none "]
    return F.coalesce(F.get(F.array(*[F.lit(n).cast("string") for n in names]), (i % 10).cast("int")), F.when(i % 10 == 9, F.col("event_type")))


def made_candidate(i):
    return F.get(F.array(*[F.lit(n).cast("string") for n in (None, "", "Normal", "dos")]), (i % 4).cast("int"))


@query(
    "p38_normal_decision",
    f"""WITH r AS (SELECT event_id, trim(coalesce({RAW}, '')) AS raw, nullif({OTHER}, '') AS cand, CASE WHEN event_id % 3 = 0 THEN 'PortScan' WHEN event_id % 3 = 1 THEN '' END AS tc FROM events)
SELECT event_id, CASE WHEN lower(raw) IN ('known_attack', 'unknown_candidate', 'uncertain', 'benign') THEN lower(raw) ELSE 'known_attack' END AS decision,
CASE WHEN lower(raw) IN ('known_attack', 'unknown_candidate', 'uncertain', 'benign') THEN coalesce(nullif(tc, ''), CASE WHEN lower(raw) = 'benign' THEN 'Benign' END, cand, raw) ELSE coalesce(nullif(raw, ''), cand, '?') END AS terminal_class FROM r""",
)
def p38(spark, d):
    i = F.col("event_id")
    given = F.when(i % 3 == 0, "PortScan").when(i % 3 == 1, "")
    return table(spark, d, "events").select("event_id", records.normal_decision(made_decision(i)).alias("decision"), records.normal_class(made_decision(i), made_candidate(i), given).alias("terminal_class"))


@query(
    "p39_is_attack",
    f"""WITH r AS (SELECT event_id, {RAW} AS raw, {OTHER} AS cand, CASE WHEN event_id % 6 = 0 THEN value END AS confidence, CASE WHEN event_id % 6 < 4 THEN value / 2 END AS score, value / 4 AS class_confidence FROM events),
l AS (SELECT *, coalesce(nullif(cand, ''), CASE WHEN event_id % 5 = 0 THEN 'web' END, nullif(raw, ''), 'unknown') AS label, lower(trim(coalesce(raw, ''))) AS d FROM r)
SELECT event_id, label, d <> '' AND d NOT IN ('benign', 'normal', 'no_alert', 'none') AND lower(trim(label)) NOT IN ('benign', 'normal', 'no_alert', 'none') AND event_id % 13 <> 0 AS is_alert,
CASE WHEN d IN ('uncertain', 'unknown_candidate', 'unknown') THEN 'uncertain' ELSE 'attack' END AS severity, round(coalesce(confidence, score, class_confidence), 6) AS confidence FROM l""",
)
def p39(spark, d):
    i, v, absent = F.col("event_id"), F.col("value"), F.lit(None).cast("string")
    label = records.alert_label(made_candidate(i), F.when(i % 5 == 0, "web"), absent, made_decision(i))
    confidence = records.alert_confidence(F.when(i % 6 == 0, v), F.when(i % 6 < 4, v / 2), v / 4)
    alert = records.is_alert(made_decision(i), label, F.when(i % 13 == 0, False))
    return table(spark, d, "events").select("event_id", label.alias("label"), alert.alias("is_alert"), records.severity(made_decision(i)).alias("severity"), F.round(confidence, 6).alias("confidence"))


@query("p40_alert_identity", "SELECT event_id, sha256(CASE WHEN event_id % 3 = 0 THEN 'F9' ELSE '?' END || '|' || CASE WHEN event_id % 5 <> 0 THEN user_id::VARCHAR ELSE '?' END || '|10.0.0.1|' || CASE WHEN event_id % 2 = 0 THEN 'TCP' ELSE '' END || '|' || event_type) AS identity FROM events")
def p40(spark, d):
    i = F.col("event_id")
    model = F.when(i % 3 == 0, "F9").when(i % 3 == 1, "")
    return table(spark, d, "events").select("event_id", records.alert_identity(model, F.when(i % 5 != 0, F.col("user_id")), F.lit("10.0.0.1"), F.when(i % 2 == 0, "TCP"), F.col("event_type")).alias("identity"))


@query("p41_family_slug", "SELECT event_type || '-scan' AS slug, count(*) AS n FROM events GROUP BY 1")
def p41(spark, d):
    name = F.concat(F.lit("f9-"), "event_type", F.lit("-scan-r"), (F.col("event_id") % 9).cast("string"), F.when(F.col("event_id") % 2 == 0, "t3").otherwise(""))
    return table(spark, d, "events").groupBy(records.family_slug(name).alias("slug")).agg(F.count("*").alias("n"))


@query("p42_attempt_outcome", "SELECT o AS outcome, count(*) AS n FROM (SELECT CASE WHEN event_id % 11 = 0 THEN 'sensor_not_ready' WHEN event_id % 4 = 1 THEN 'alert' WHEN event_id % 5 = 1 THEN 'foreign_flow' WHEN event_id % 13 = 0 THEN 'no_capture' WHEN event_id % 13 < 9 THEN 'short_capture' ELSE 'no_alert' END AS o FROM events) GROUP BY 1")
def p42(spark, d):
    i = F.col("event_id")
    o = records.attempt_outcome(i % 11 != 0, F.when(i % 4 == 1, 1).otherwise(0), F.when(i % 5 == 1, 1).otherwise(0), i % 13, 9)
    return table(spark, d, "events").groupBy(o.alias("outcome")).agg(F.count("*").alias("n"))


@query("p43_lab_subnet", f"WITH {EP} SELECT event_id, a_ip BETWEEN 167772160 AND 167772287 AND b_ip BETWEEN 167772160 AND 167772287 AS in_lab FROM ep")
def p43(spark, d):
    return endpoints(spark, d).select("event_id", net.same_network(F.col("a_ip"), F.col("b_ip"), "10.0.0.0/25").alias("in_lab"))


@query("p44_float32", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(value AS REAL)::DOUBLE END AS x FROM events")
def p44(spark, d):
    big = F.when(F.col("event_id") % 7 == 0, F.lit(1e300)).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", numbers.float32(big).cast("double").alias("x"))
