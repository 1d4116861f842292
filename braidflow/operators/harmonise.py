"""Datasets of different origin brought to one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite_or_zero
from ..functions.records import binary_label
from ..sources.shared import written
from .profile import clip_at
from .topk import first_share
from .windows import hinted, running_sum


#: Ranges that the order of first appearances is cut into.
RANGES = 1024


def factorize(df: DataFrame, column: str, order: str, name: str = "code") -> DataFrame:
    """Integer codes by first appearance; null is the text ``nan``. ``order`` is a whole number without ties between values.

    Distinct values are counted by range of their first appearance, and numbered within each range from there, so no task
    sees more than a range. Codes are broadcast if they are few.
    """
    v = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    firsts = df.groupBy(v.alias("_v")).agg(F.min(order).alias("_m")).withColumn("_one", F.lit(1).cast("long"))
    lo, hi = firsts.agg(F.min("_m"), F.max("_m")).first()
    codes = running_sum(firsts, "_m", "_one", max(((hi or 0) - (lo or 0)) // RANGES + 1, 1))
    codes = codes.select("_v", (F.col("_upto") - 1).cast("int").alias(name))
    return df.withColumn("_v", v).join(hinted(codes), "_v").drop("_v")


#: The features of each layer, in their order.
LAYER1 = "dst_port nat_src_port total_bytes pkt_count pkts_sent".split()
LAYER2 = "dst_port flow_dur_us fwd_pkts fwd_bytes bwd_pkts bwd_bytes pkt_len_min pkt_len_avg flow_bytes_s psh_flag ack_flag fin_flag init_win_fwd active_mean protocol_enc".split()
LAYER3 = "flow_dur_us fwd_bytes bwd_bytes fwd_pkts bwd_pkts src_ttl dst_ttl sload dload state_enc ct_dst_sport_ltm ct_srv_dst".split()
#: Names of a firewall log's columns for the first layer.
FIREWALL = {"dst_port": "Destination Port", "nat_src_port": "NAT Source Port", "total_bytes": "Bytes", "pkt_count": "Packets", "pkts_sent": "pkts_sent"}
#: Columns of the raw datasets that say nothing new.
CIC_REDUNDANT = (
    "Subflow Fwd Bytes", "Fwd IAT Total", "Packet Length Mean", "Idle Max", "Idle Min", "Flow IAT Max", "Bwd IAT Total", "Fwd Packets/s", "Bwd IAT Max", "Bwd IAT Mean", "Fwd IAT Mean", "Max Packet Length",
    "Packet Length Variance", "act_data_pkt_fwd", "min_seg_size_forward", "Fwd Header Length", "Bwd Header Length", "Flow Packets/s",
)
UNSW_REDUNDANT = "ct_ftp_cmd dloss sloss dwin dpkts trans_depth ackdat id stcpb dtcpb Stime Ltime srcip dstip sport dsport attack_cat".split()


def trimmed_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def _zeroed(df: DataFrame) -> DataFrame:
    """Infinite, undefined and missing numbers as 0."""
    return df.select(*[finite_or_zero(F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.coalesce(F.col(f"`{c}`"), F.lit(0).cast(t)).alias(c) if t in ("int", "bigint", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes])


def clean_firewall(raw: DataFrame) -> DataFrame:
    """The first layer's columns of a firewall log, with ``y``: every action but ``allow`` is an attack."""
    r = trimmed_names(raw)
    return r.select(*[F.col(f"`{c}`").alias(n) for n, c in FIREWALL.items()], binary_label(F.col("Action"), "allow").alias("y"))


def clean_cic(raw: DataFrame) -> DataFrame:
    """A CIC table without redundant columns, with ``y``: every type but normal traffic is an attack."""
    r = trimmed_names(raw)
    y = (F.trim("Attack Type") != "Normal Traffic").cast("int")
    return _zeroed(r.withColumn("y", F.coalesce(y, F.lit(1))).drop(*CIC_REDUNDANT, "Attack Type"))


def clean_unsw(raw: DataFrame, order: str) -> DataFrame:
    """A UNSW file: its label as ``y``, texts as codes by first appearance in ``order``, without redundant columns."""
    r = trimmed_names(raw)
    r = r.withColumnRenamed("label", "y") if "label" in r.columns else r.withColumnRenamed("Label", "y")
    for c in ("proto", "service", "state"):
        if c in r.columns:
            r = factorize(r.withColumn(c, F.trim(F.col(c).cast("string"))), c, order, "_code").drop(c).withColumnRenamed("_code", c)
    return _zeroed(r.withColumn("y", F.col("y").cast("int"))).drop(*[c for c in UNSW_REDUNDANT if c != order])


#: Columns of a NetFlow table that say nothing new, and its flags by their bits.
BOTIOT_REDUNDANT = ("Attack", "L7_PROTO")
BOTIOT_FLAGS = {"fin_flag": 0, "syn_flag": 1, "psh_flag": 3, "ack_flag": 4}


def clean_botiot(raw: DataFrame) -> DataFrame:
    """A NetFlow table with its label as ``y``, four flags out of the mask, and the duration in microseconds; absent columns stay absent."""
    r = trimmed_names(raw).withColumnRenamed("Label", "y").drop(*BOTIOT_REDUNDANT)
    if "TCP_FLAGS" in r.columns:
        mask = F.coalesce(F.col("TCP_FLAGS").cast("int"), F.lit(0))
        r = r.withColumns({n: F.shiftright(mask, bit).bitwiseAND(1).cast("tinyint") for n, bit in BOTIOT_FLAGS.items()}).drop("TCP_FLAGS")
    if "FLOW_DURATION_MILLISECONDS" in r.columns:
        r = r.withColumn("flow_dur_us", F.col("FLOW_DURATION_MILLISECONDS").cast("double") * 1000).drop("FLOW_DURATION_MILLISECONDS")
    return _zeroed(r.withColumn("y", F.col("y").cast("int")))


def mapped(df: DataFrame, names: list[str], columns: dict[str, Column], source: int) -> DataFrame:
    """``names`` as doubles (0 where ``columns`` has none, or its value is no finite number), label ``y`` and origin ``src``."""
    value = lambda n: finite_or_zero(columns[n].cast("double")) if n in columns else F.lit(0.0)
    return df.select(*[value(n).alias(n) for n in names], F.col("y").cast("int").alias("y"), F.lit(source).alias("src"))


def _columns(df: DataFrame, names: dict[str, str]) -> dict[str, Column]:
    """The columns that the dataset has, by feature."""
    return {n: F.col(f"`{c}`") for n, c in names.items() if c in df.columns}


def layer1(firewall: DataFrame) -> DataFrame:
    """First layer: a cleaned firewall log, origin 0."""
    return mapped(firewall, LAYER1, {n: F.col(n) for n in LAYER1}, 0)


def cic_layer2(df: DataFrame) -> DataFrame:
    """Second layer from CIC rows, origin 0; reverse counts and the protocol are not there."""
    names = {
        "dst_port": "Destination Port", "flow_dur_us": "Flow Duration", "fwd_pkts": "Total Fwd Packets", "fwd_bytes": "Total Length of Fwd Packets", "pkt_len_min": "Min Packet Length", "pkt_len_avg": "Average Packet Size",
        "flow_bytes_s": "Flow Bytes/s", "psh_flag": "PSH Flag Count", "ack_flag": "ACK Flag Count", "fin_flag": "FIN Flag Count", "init_win_fwd": "Init_Win_bytes_forward", "active_mean": "Active Mean",
    }
    return mapped(df, LAYER2, _columns(df, names), 0)


def unsw_layer2(df: DataFrame) -> DataFrame:
    """Second layer from UNSW rows, origin 1; seconds become microseconds, the mean size stands for the least too."""
    names = {"fwd_pkts": "spkts", "fwd_bytes": "sbytes", "bwd_pkts": "dpkts", "bwd_bytes": "dbytes", "pkt_len_min": "smean", "pkt_len_avg": "smean", "flow_bytes_s": "sload", "init_win_fwd": "swin", "protocol_enc": "proto"}
    c = _columns(df, names)
    return mapped(df, LAYER2, c | ({"flow_dur_us": F.col("dur").cast("double") * 1e6} if "dur" in df.columns else {}), 1)


def _flow(df: DataFrame) -> tuple[Column, Column, Column, Column, Column]:
    """Bytes and packets of a NetFlow row in and out, and its seconds (null for none)."""
    had = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(0.0)
    seconds = had("flow_dur_us") / 1e6
    return had("IN_BYTES"), had("OUT_BYTES"), had("IN_PKTS"), had("OUT_PKTS"), F.when(seconds != 0, seconds)


def botiot_layer2(df: DataFrame) -> DataFrame:
    """Second layer from NetFlow rows, origin 2; sizes and rates are worked out from bytes, packets and time."""
    names = {"dst_port": "L4_DST_PORT", "flow_dur_us": "flow_dur_us", "fwd_pkts": "IN_PKTS", "fwd_bytes": "IN_BYTES", "bwd_pkts": "OUT_PKTS", "bwd_bytes": "OUT_BYTES", "psh_flag": "psh_flag", "ack_flag": "ack_flag", "fin_flag": "fin_flag", "protocol_enc": "PROTOCOL"}
    b_in, b_out, p_in, p_out, seconds = _flow(df)
    some = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return mapped(df, LAYER2, _columns(df, names) | {"pkt_len_min": b_in / some(p_in), "pkt_len_avg": (b_in + b_out) / some(p_in + p_out), "flow_bytes_s": (b_in + b_out) / seconds}, 2)


def layer2(cic: DataFrame, unsw: DataFrame, botiot: DataFrame) -> DataFrame:
    """The second layer of all three datasets."""
    return cic_layer2(cic).unionByName(unsw_layer2(unsw)).unionByName(botiot_layer2(botiot))


def layer2_training(cic: DataFrame, unsw: DataFrame, botiot: DataFrame, key: str, share: float = 0.2, top: float = 0.999) -> DataFrame:
    """The second layer to train on: of the CIC rows a share of each class, and every feature cut at its own upper quantile.

    Rows are the first of their class in hash order of ``key``, a column of ``cic`` that names a row; quantiles are exact
    ones of the whole mixture.
    """
    some = first_share(cic, "y", key, share)
    chosen = written(cic_layer2(some), "layer2-chosen")  # every pass of the quantiles reads it
    return clip_at(chosen.unionByName(unsw_layer2(unsw)).unionByName(botiot_layer2(botiot)), LAYER2, top)


def unsw_layer3(df: DataFrame) -> DataFrame:
    """Third layer from UNSW rows, origin 1."""
    names = {"fwd_bytes": "sbytes", "bwd_bytes": "dbytes", "fwd_pkts": "spkts", "bwd_pkts": "dpkts", "src_ttl": "sttl", "dst_ttl": "dttl", "sload": "sload", "dload": "dload", "state_enc": "state", "ct_dst_sport_ltm": "ct_dst_sport_ltm", "ct_srv_dst": "ct_srv_dst"}
    return mapped(df, LAYER3, _columns(df, names) | ({"flow_dur_us": F.col("dur").cast("double") * 1e6} if "dur" in df.columns else {}), 1)


def botiot_layer3(df: DataFrame) -> DataFrame:
    """Third layer from NetFlow rows, origin 2; times to live, state and counts are not there."""
    b_in, b_out, _, _, seconds = _flow(df)
    names = {"flow_dur_us": "flow_dur_us", "fwd_bytes": "IN_BYTES", "bwd_bytes": "OUT_BYTES", "fwd_pkts": "IN_PKTS", "bwd_pkts": "OUT_PKTS"}
    return mapped(df, LAYER3, _columns(df, names) | {"sload": b_in * 8 / seconds, "dload": b_out * 8 / seconds}, 2)


def layer3(unsw: DataFrame, botiot: DataFrame) -> DataFrame:
    """The third layer of both datasets."""
    return unsw_layer3(unsw).unionByName(botiot_layer3(botiot))


def prefix_profile(columns: list[str], sizes: dict[str, int], profile: str) -> list[str]:
    return columns[: sizes[profile]]
