"""Feature vectors of flows: 54 columns at a checkpoint, 70 at the close. One grouped aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import rate, safe_divide
from ..sources.shared import written
from .windows import active_idle_means, causal_contexts, watermark_at_start

#: The features in their order.
NAMES = tuple(
    """flow_age_us packet_count forward_packet_count reverse_packet_count wire_byte_count forward_wire_byte_count reverse_wire_byte_count
    packet_length_min packet_length_max packet_length_mean packet_length_std forward_packet_length_mean forward_packet_length_std
    reverse_packet_length_mean reverse_packet_length_std flow_iat_min_us flow_iat_max_us flow_iat_mean_us flow_iat_std_us forward_iat_mean_us
    forward_iat_std_us reverse_iat_mean_us reverse_iat_std_us packet_rate_per_second wire_byte_rate_per_second forward_reverse_packet_ratio
    forward_reverse_wire_byte_ratio direction_change_count tcp_syn_count tcp_ack_count tcp_fin_count tcp_rst_count tcp_psh_count tcp_syn_ack_ratio
    tcp_initial_forward_window tcp_initial_reverse_window tcp_window_mean tcp_window_std ttl_min ttl_max ttl_mean ttl_std payload_packet_count
    forward_payload_packet_count reverse_payload_packet_count payload_byte_count forward_payload_byte_count reverse_payload_byte_count
    payload_length_min payload_length_max payload_length_mean payload_length_std header_length_mean header_length_std""".split()
)
#: What a closed flow has besides, in its order.
TERMINAL_NAMES = (
    *NAMES,
    *"""protocol_number forward_ttl_mean reverse_ttl_mean forward_wire_bit_rate_per_second reverse_wire_bit_rate_per_second active_mean_us idle_mean_us
    context_same_destination_endpoint_flow_count_60s context_same_source_destination_flow_count_60s context_source_destination_distinct_destination_port_count_60s
    first_observed_source_port first_observed_destination_port lifecycle_tcp_reset lifecycle_tcp_fin_handshake lifecycle_tcp_other lifecycle_udp""".split(),
)
TCP, UDP = 6, 17
IDLE_GAP_NS = 5 * 10**9
CONTEXT_BLOCK_NS = 60 * 10**9
FLAG_BITS = {"syn": 2, "ack": 16, "fin": 1, "rst": 4, "psh": 8}
PROFILES = {"A": 54, "B": 61, "C": 64, "D": 66, "E": 70}


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("double")


def flow_vector(packets: DataFrame, by: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """``by``, the 54 features and ``extra`` aggregates.

    ``packets`` has the columns of :func:`~.windows.with_flow_steps` and ``timestamp_ns, direction`` (forward or
    reverse), ``wire_length, payload_length, header_length, ttl, tcp_window, tcp_flags`` (null for UDP). Deviations are
    those of the population; empty groups give 0.
    """
    fw, rv = F.col("direction") == "forward", F.col("direction") == "reverse"
    wire, pay = F.col("wire_length"), F.col("payload_length")
    a: dict[str, Column] = {
        "flow_age_us": (F.max("timestamp_ns") - F.min_by("timestamp_ns", "ordinal")) / 1000,
        "packet_count": F.count("*"),
        "wire_byte_count": F.sum(wire),
        "packet_length_min": F.min(wire),
        "packet_length_max": F.max(wire),
        "flow_iat_min_us": F.min("iat_ns") / 1000,
        "flow_iat_max_us": F.max("iat_ns") / 1000,
        "direction_change_count": F.sum("turn"),
        "ttl_min": F.min("ttl"),
        "ttl_max": F.max("ttl"),
        "payload_packet_count": F.count_if(pay > 0),
        "payload_byte_count": F.sum(pay),
        "payload_length_min": F.min(pay),
        "payload_length_max": F.max(pay),
    }
    for side, on in (("forward", fw), ("reverse", rv)):
        a |= {
            f"{side}_packet_count": F.count_if(on),
            f"{side}_wire_byte_count": F.sum(F.when(on, wire)),
            f"{side}_payload_packet_count": F.count_if(on & (pay > 0)),
            f"{side}_payload_byte_count": F.sum(F.when(on, pay)),
            f"tcp_initial_{side}_window": F.min_by(F.when(on, F.col("tcp_window")), F.when(on & F.col("tcp_window").isNotNull(), F.col("ordinal"))),
        }
    means = {"packet_length": wire, "tcp_window": F.col("tcp_window"), "ttl": F.col("ttl"), "payload_length": pay, "header_length": F.col("header_length")}
    means |= {"forward_packet_length": F.when(fw, wire), "reverse_packet_length": F.when(rv, wire)}
    for name, c in means.items():
        a |= {f"{name}_mean": F.avg(c), f"{name}_std": F.stddev_pop(c)}
    for name, c in {"flow_iat": F.col("iat_ns"), "forward_iat": F.when(fw, F.col("dir_iat_ns")), "reverse_iat": F.when(rv, F.col("dir_iat_ns"))}.items():
        a |= {f"{name}_mean_us": F.avg(c) / 1000, f"{name}_std_us": F.stddev_pop(c) / 1000}
    for flag, bit in FLAG_BITS.items():
        a[f"tcp_{flag}_count"] = F.count_if(F.col("tcp_flags").bitwiseAND(bit) != 0)
    g = packets.groupBy(*by).agg(*[c.alias(n) for n, c in a.items()], *[c.alias(n) for n, c in (extra or {}).items()])
    g = g.withColumns({n: _or0(F.col(n)) for n in a})
    g = g.withColumns(
        {
            "packet_rate_per_second": rate(F.col("packet_count"), F.col("flow_age_us")),
            "wire_byte_rate_per_second": rate(F.col("wire_byte_count"), F.col("flow_age_us")),
            "forward_reverse_packet_ratio": safe_divide(F.col("forward_packet_count"), F.col("reverse_packet_count")),
            "forward_reverse_wire_byte_ratio": safe_divide(F.col("forward_wire_byte_count"), F.col("reverse_wire_byte_count")),
            "tcp_syn_ack_ratio": safe_divide(F.col("tcp_syn_count"), F.col("tcp_ack_count")),
        }
    )
    return g.select(*by, *NAMES, *(extra or {}))


def terminal_vector(packets: DataFrame, by: list[str], capture: list[str], order: str, gap_ns: int = IDLE_GAP_NS, block_ns: int = CONTEXT_BLOCK_NS, contiguous: bool = False) -> DataFrame:
    """``by`` and the 70 features of closed flows.

    ``packets`` has what :func:`flow_vector` needs, ``order`` (the packet's place in its capture), ``watermark_ns`` (the
    capture's clock), ``protocol`` (6 or 17), ``source_ip, source_port, destination_ip, destination_port``; ``capture``
    names the columns of ``by`` that tell captures apart. Active and idle times follow the flow's own clock; a flow's
    contexts count the flows that began up to it in its block of the capture's clock. If the packets of every flow follow
    each other in the capture (``contiguous``), the flows give the clock, and packets need no ``watermark_ns``. Packets are
    grouped once; flows are written, and their contexts found on a few of the columns.
    """
    clock = "timestamp_ns" if contiguous else "watermark_ns"
    fw, rv = F.col("direction") == "forward", F.col("direction") == "reverse"
    has = lambda bit: F.coalesce(F.col("tcp_flags").bitwiseAND(bit) != 0, F.lit(False))
    first = {c: F.min_by(c, "ordinal") for c in ("protocol", "source_ip", "source_port", "destination_ip", "destination_port", clock, order)}
    extra = {f"_{n}": c for n, c in first.items()} | {
        "forward_ttl_mean": F.avg(F.when(fw, F.col("ttl"))), "reverse_ttl_mean": F.coalesce(F.avg(F.when(rv, F.col("ttl"))), F.lit(0.0)),
        "_fin_forward": F.bool_or(fw & has(FLAG_BITS["fin"])), "_fin_reverse": F.bool_or(rv & has(FLAG_BITS["fin"])),
    }
    extra |= active_idle_means("clock_ns", "_gap") | {"_last": F.max("timestamp_ns")}
    step = F.col("clock_ns") - F.lag("clock_ns").over(W.partitionBy(*by).orderBy("ordinal"))
    v = written(flow_vector(packets.withColumn("_gap", F.when(step > gap_ns, step)), by, extra), "terminal-flows")
    at = v.select(*by, f"_{order}", f"_{clock}", "_last", "_source_ip", "_destination_ip", "_destination_port")
    if contiguous:
        at = watermark_at_start(at, capture, f"_{order}", f"_{clock}", "_last", name="_watermark_ns")
    at = at.withColumn("_block", F.floor(F.col("_watermark_ns") / F.lit(block_ns)).cast("long"))
    at = causal_contexts(at, [*capture, "_block"], f"_{order}", "_source_ip", "_destination_ip", "_destination_port")
    v = v.join(at.select(*by, "same_endpoint", "same_pair", "distinct_ports"), by)
    tcp = F.col("_protocol") == TCP
    reset = tcp & (F.col("tcp_rst_count") > 0)
    fin = tcp & ~reset & F.col("_fin_forward") & F.col("_fin_reverse")
    more = {
        "protocol_number": F.col("_protocol"), "forward_ttl_mean": F.col("forward_ttl_mean"), "reverse_ttl_mean": F.col("reverse_ttl_mean"),
        "forward_wire_bit_rate_per_second": rate(F.col("forward_wire_byte_count") * 8, F.col("flow_age_us")), "reverse_wire_bit_rate_per_second": rate(F.col("reverse_wire_byte_count") * 8, F.col("flow_age_us")),
        "active_mean_us": F.col("active_mean_us"), "idle_mean_us": F.col("idle_mean_us"), "context_same_destination_endpoint_flow_count_60s": F.col("same_endpoint"), "context_same_source_destination_flow_count_60s": F.col("same_pair"),
        "context_source_destination_distinct_destination_port_count_60s": F.col("distinct_ports"), "first_observed_source_port": F.col("_source_port"), "first_observed_destination_port": F.col("_destination_port"),
        "lifecycle_tcp_reset": reset, "lifecycle_tcp_fin_handshake": fin, "lifecycle_tcp_other": tcp & ~reset & ~fin, "lifecycle_udp": ~tcp,
    }
    return v.select(*by, *NAMES, *[c.cast("double").alias(n) for n, c in more.items()])


def profile_columns(profile: str, names: tuple[str, ...]) -> list[str]:
    """The leading features that a profile may see."""
    return list(names[: PROFILES[profile]])
