"""Frames to packets with binary column expressions: Ethernet II, at most one VLAN tag, IPv4 without fragments, TCP or UDP."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Types that announce a VLAN tag.
VLAN_TYPES = (0x8100, 0x88A8, 0x9100)


def _byte(frame: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(frame, at + 1, F.lit(1))), 16, 10).cast("long")


def _number(frame: Column, at: Column, size: int) -> Column:
    return F.conv(F.hex(F.substring(frame, at + 1, F.lit(size))), 16, 10).cast("long")


def decode(frames: DataFrame) -> DataFrame:
    """``frames`` with header fields and ``error`` (null for a packet); the first rule that fails names the error.

    Fields of frames that fail are null from the failing layer on. ``wire_length`` (not below what was captured) and
    ``link_layer`` (``ethernet``) are checked where the frames have them.
    """
    has = lambda name, value: value if name in frames.columns else F.lit(False)
    fr = F.col("frame")
    lit = F.lit
    n = F.length(fr).cast("long")
    tagged = _number(fr, lit(12), 2).isin(*VLAN_TYPES)
    f = frames.withColumns({"_n": n, "_tag": (n >= 14) & F.coalesce(tagged, lit(False))})
    f = f.withColumns({"_eth": F.when(F.col("_tag"), 18).otherwise(14)})
    f = f.withColumns(
        {
            "ether_type": F.when(F.col("_n") >= F.col("_eth"), _number(fr, F.col("_eth") - 2, 2)),
            "vlan_id": F.when(F.col("_tag") & (F.col("_n") >= 18), _number(fr, lit(14), 2).bitwiseAND(0xFFF)),
            "_v": F.when(F.col("_n") > F.col("_eth"), _byte(fr, F.col("_eth"))),
        }
    )
    ip = F.col("_eth")
    f = f.withColumns(
        {
            "_ihl": F.col("_v").bitwiseAND(15) * 4,
            "_len": F.when(F.col("_n") >= ip + 20, _number(fr, ip + 2, 2)),
            "_frag": F.when(F.col("_n") >= ip + 20, _number(fr, ip + 6, 2)),
            "ttl": F.when(F.col("_n") >= ip + 20, _byte(fr, ip + 8)),
            "protocol": F.when(F.col("_n") >= ip + 20, _byte(fr, ip + 9)),
            "source_ip": F.when(F.col("_n") >= ip + 20, _number(fr, ip + 12, 4)),
            "destination_ip": F.when(F.col("_n") >= ip + 20, _number(fr, ip + 16, 4)),
        }
    )
    at = ip + F.col("_ihl")
    end = ip + F.col("_len")
    tcp = F.col("protocol") == 6
    f = f.withColumns(
        {
            "_at": at,
            "_end": end,
            "source_port": F.when(F.col("_n") >= at + 4, _number(fr, at, 2)),
            "destination_port": F.when(F.col("_n") >= at + 4, _number(fr, at + 2, 2)),
            "_off": F.when(tcp & (F.col("_n") >= at + 20), F.shiftright(_byte(fr, at + 12), 4) * 4),
            "sequence_number": F.when(tcp & (F.col("_n") >= at + 20), _number(fr, at + 4, 4)),
            "tcp_flags": F.when(tcp & (F.col("_n") >= at + 20), _number(fr, at + 12, 2).bitwiseAND(0x1FF)),
            "tcp_window": F.when(tcp & (F.col("_n") >= at + 20), _number(fr, at + 14, 2)),
            "_udp": F.when((F.col("protocol") == 17) & (F.col("_n") >= at + 8), _number(fr, at + 4, 2)),
        }
    )
    c = F.col
    error = (
        F.when(has("wire_length", c("wire_length") < c("_n")), "inconsistent_lengths")
        .when(has("link_layer", c("link_layer") != "ethernet"), "unsupported_link_layer")
        .when(c("_n") < 14, "truncated_ethernet_header")
        .when(c("_tag") & (c("_n") < 18), "truncated_vlan_header")
        .when(c("_tag") & c("ether_type").isin(*VLAN_TYPES), "nested_vlan")
        .when(c("ether_type") != 0x0800, "unsupported_ether_type")
        .when(c("_n") < ip + 20, "truncated_ipv4_header")
        .when(F.shiftright(c("_v"), 4) != 4, "invalid_ipv4_version")
        .when(c("_ihl") < 20, "invalid_ipv4_header_length")
        .when(c("_n") < at, "truncated_ipv4_header")
        .when(c("_len") < c("_ihl"), "invalid_ipv4_total_length")
        .when(c("_n") < end, "truncated_ipv4_packet")
        .when(c("_frag").bitwiseAND(0x3FFF) != 0, "fragmented_ipv4")
        .when(~c("protocol").isin(6, 17), "unsupported_transport_protocol")
        .when(tcp & (end < at + 20), "truncated_tcp_header")
        .when(tcp & (c("_off") < 20), "invalid_tcp_header_length")
        .when(tcp & (end < at + c("_off")), "invalid_tcp_header_length")
        .when(~tcp & (end < at + 8), "truncated_udp_header")
        .when(~tcp & ((c("_udp") < 8) | (at + c("_udp") > end)), "invalid_udp_length")
    )
    start = at + F.when(tcp, c("_off")).otherwise(8)
    f = f.withColumn("error", error)
    f = f.withColumns({"payload_offset": F.when(c("error").isNull(), start), "payload_length": F.when(c("error").isNull(), F.when(tcp, end).otherwise(at + c("_udp")) - start)})
    return f.drop("_n", "_tag", "_eth", "_v", "_ihl", "_len", "_frag", "_at", "_end", "_off", "_udp")


def packets_and_errors(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    d = decode(frames)
    return d.filter("error is null").drop("error", "frame"), d.filter("error is not null").select("capture_id", "packet_index", "error")
