"""Logical inputs of the operators, built from the given tables, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

#: Order lines that one task joins and sorts, so that a task's memory does not grow with the table.
PART_ROWS = 500_000
MILLI, SECOND, HOUR, DAY = 10**6, 10**9, 3600 * 10**9, 86_400 * 10**9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ns(column: str):
    """Nanoseconds since the epoch of a timestamp without zone."""
    return F.unix_micros(F.to_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone())) * 1000


def packets_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets: key ``k``, order ``idx``."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit("E").alias("cap"), F.col("event_id").alias("idx"), ns("ts").alias("timestamp_ns"), F.col("user_id").alias("k"), F.round(F.col("value") * 100).cast("long").alias("wire_length"), F.col("event_type").alias("kind")
    )


PE = "pe AS (SELECT 'E' AS cap, event_id AS idx, epoch_us(ts) * 1000 AS ts, user_id AS k, CAST(round(value * 100) AS BIGINT) AS wire, event_type AS kind FROM events)"

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def packets_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as packets of the order's flow, in line order; a day counts as a millisecond, and times may go backwards."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    parts = -(-li.count() // PART_ROWS)  # the files' own counts
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        li, o = li.repartition(parts, "l_orderkey"), o.repartition(parts, "o_orderkey")  # windows and groups by flow stay in these parts
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    w = W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    side = F.pmod(F.col("l_suppkey"), F.lit(2))
    j = j.withColumn("ord", F.row_number().over(w).cast("long")).withColumn("_first", F.first(side).over(w))
    flags = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "R", 17).otherwise(16) + F.when(F.col("l_linestatus") == "O", 8).otherwise(0)
    return j.select(
        F.col("o_orderpriority").alias("cap"), F.col("l_orderkey").alias("flow"), "ord", (F.floor(ns("l_shipdate") / DAY) * MILLI).cast("long").alias("timestamp_ns"),
        F.when(side == F.col("_first"), "forward").otherwise("reverse").alias("direction"),
        F.round("l_extendedprice").cast("long").alias("wire_length"), F.col("l_quantity").cast("long").alias("payload_length"),
        (F.round("l_extendedprice").cast("long") - F.col("l_quantity").cast("long")).alias("header_length"), F.col("l_linenumber").cast("long").alias("ttl"),
        (F.col("l_partkey") % 1000).alias("tcp_window"), flags.alias("tcp_flags"), F.col("o_custkey").alias("cust"), F.col("l_suppkey").alias("supp"), F.col("l_partkey").alias("part"),
    )


PL = f"""pl0 AS (SELECT o_orderpriority AS cap, l_orderkey AS flow, o_custkey AS cust, l_suppkey AS supp, l_partkey AS part, epoch_us(l_shipdate) // 86400000000 * 1000000 AS ts,
  CAST(round(l_extendedprice) AS BIGINT) AS wire, CAST(l_quantity AS BIGINT) AS pay, CAST(l_linenumber AS BIGINT) AS ttl, l_partkey % 1000 AS win,
  CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 17 ELSE 16 END + CASE l_linestatus WHEN 'O' THEN 8 ELSE 0 END AS flags,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
pl AS (SELECT *, wire - pay AS hdr, CASE WHEN supp % 2 = first_value(supp % 2) OVER (PARTITION BY flow ORDER BY ord) THEN 'forward' ELSE 'reverse' END AS dir FROM pl0)"""

#: Steps of each flow's packets, as :func:`braidflow.operators.windows.with_flow_steps` has them.
PLS = (
    PL
    + """, pls AS (SELECT *, ts - lag(ts) OVER f AS iat, ts - lag(ts) OVER d AS diat, CASE WHEN lag(dir) OVER f <> dir THEN 1 ELSE 0 END AS turn,
  max(ts) OVER (PARTITION BY flow ORDER BY ord ROWS UNBOUNDED PRECEDING) AS clock FROM pl WINDOW f AS (PARTITION BY flow ORDER BY ord), d AS (PARTITION BY flow, dir ORDER BY ord))"""
)


def vector_sql(source: str, by: str) -> str:
    """The 54 features of ``source`` grouped by ``by``."""
    q = {
        "flow_age_us": "(max(ts) - min_by(ts, ord)) / 1000", "packet_count": "count(*)", "wire_byte_count": "sum(wire)", "packet_length_min": "min(wire)", "packet_length_max": "max(wire)",
        "flow_iat_min_us": "min(iat) / 1000", "flow_iat_max_us": "max(iat) / 1000", "direction_change_count": "sum(turn)", "ttl_min": "min(ttl)", "ttl_max": "max(ttl)",
        "payload_packet_count": "count(*) FILTER (pay > 0)", "payload_byte_count": "sum(pay)", "payload_length_min": "min(pay)", "payload_length_max": "max(pay)",
    }
    for s in ("forward", "reverse"):
        q |= {
            f"{s}_packet_count": f"count(*) FILTER (dir = '{s}')", f"{s}_wire_byte_count": f"sum(wire) FILTER (dir = '{s}')", f"{s}_payload_packet_count": f"count(*) FILTER (dir = '{s}' AND pay > 0)",
            f"{s}_payload_byte_count": f"sum(pay) FILTER (dir = '{s}')", f"tcp_initial_{s}_window": f"min_by(win, ord) FILTER (dir = '{s}')",
            f"{s}_packet_length_mean": f"avg(wire) FILTER (dir = '{s}')", f"{s}_packet_length_std": f"stddev_pop(wire) FILTER (dir = '{s}')",
            f"{s}_iat_mean_us": f"avg(diat) FILTER (dir = '{s}') / 1000", f"{s}_iat_std_us": f"stddev_pop(diat) FILTER (dir = '{s}') / 1000",
        }
    for n, c in {"packet_length": "wire", "tcp_window": "win", "ttl": "ttl", "payload_length": "pay", "header_length": "hdr"}.items():
        q |= {f"{n}_mean": f"avg({c})", f"{n}_std": f"stddev_pop({c})"}
    q |= {"flow_iat_mean_us": "avg(iat) / 1000", "flow_iat_std_us": "stddev_pop(iat) / 1000"}
    for f, b in {"syn": 2, "ack": 16, "fin": 1, "rst": 4, "psh": 8}.items():
        q[f"tcp_{f}_count"] = f"count(*) FILTER ((flags & {b}) <> 0)"
    inner = ", ".join(f"coalesce({x}, 0)::DOUBLE AS {n}" for n, x in q.items())
    div = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE {a} / {b} END"
    outer = {
        "packet_rate_per_second": "CASE WHEN flow_age_us > 0 THEN packet_count * 1e6 / flow_age_us ELSE 0 END", "wire_byte_rate_per_second": "CASE WHEN flow_age_us > 0 THEN wire_byte_count * 1e6 / flow_age_us ELSE 0 END",
        "forward_reverse_packet_ratio": div("forward_packet_count", "reverse_packet_count"), "forward_reverse_wire_byte_ratio": div("forward_wire_byte_count", "reverse_wire_byte_count"),
        "tcp_syn_ack_ratio": div("tcp_syn_count", "tcp_ack_count"),
    }
    every = ", ".join(f"round(({outer.get(n, n)})::DOUBLE, 4) AS {n}" for n in [*q, *outer])
    return f"SELECT {by}, {every} FROM (SELECT {by}, {inner} FROM {source} GROUP BY {by})"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def narrowed(df: DataFrame, name: str) -> DataFrame:
    """A small result whose decimal ``name`` is a 64-bit number, as in SQL, if all its values fit. If not, SQL has an error instead of a result, and it stays a decimal."""
    df = written(df, "totals")
    lo, hi = df.agg(F.min(name), F.max(name)).first()
    return df.withColumn(name, F.col(name).cast("bigint")) if lo is None or -(2**63) <= lo and hi < 2**63 else df


def fixed(name: str, digits: int):
    """A double to so many digits, by the same arithmetic as ``FIXED`` in SQL: rounding functions differ where a value lies between two results."""
    return (F.floor(F.col(name) * 10**digits + 0.5) / float(10**digits)).alias(name)


FIXED = lambda value, digits: f"floor(({value}) * {10**digits} + 0.5) / {10**digits}.0::DOUBLE"
