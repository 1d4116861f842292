"""The rules by which packets of one endpoint pair become flow generations; shared by batch and streaming jobs.

A generation ends passively (idle or maximum age, judged by the capture's clock), by reuse of the tuple (a new SYN), by
a reset, or by a FIN handshake. The machine looks at one packet at a time and keeps a fixed-size state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

FIN, SYN, RST, ACK = 1, 2, 4, 16
PASSIVE = "passive"


@dataclass(frozen=True)
class FlowPolicy:
    idle_ns: int = 60 * 10**9
    max_age_ns: int = 1800 * 10**9


@dataclass(slots=True)
class Flow:
    """One open generation; ``generation`` is the capture index of its first packet."""

    generation: int
    creation_ns: int
    last_event_ns: int
    source: str
    packets: int = 0
    syn_open: bool = False
    syn_seq: int = -1
    fin_forward: bool = False
    fin_reverse: bool = False
    second_fin: str = ""

    def deadlines(self, policy: FlowPolicy) -> tuple[int, int]:
        return self.last_event_ns + policy.idle_ns, self.creation_ns + policy.max_age_ns

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def load(text: str) -> Flow:
        return Flow(**json.loads(text))


class Closed(NamedTuple):
    generation: int
    creation_ns: int
    last_event_ns: int
    packets: int
    reason: str
    source: str


def closed(f: Flow, reason: str) -> Closed:
    return Closed(f.generation, f.creation_ns, f.last_event_ns, f.packets, reason, f.source)


def step(flow: Flow | None, index: int, ts: int, clock: int, source: str, tcp: bool, flags: int, seq: int, policy: FlowPolicy) -> tuple[Flow | None, Flow, str, list[Closed]]:
    """Takes one packet: the flow that is open afterwards, the flow that the packet belongs to, its direction, what was closed."""
    out: list[Closed] = []
    if flow is not None and (clock >= flow.last_event_ns + policy.idle_ns or clock >= flow.creation_ns + policy.max_age_ns):
        out.append(closed(flow, PASSIVE))
        flow = None
    opening = tcp and flags & SYN and not flags & ACK
    repeat = flow is not None and opening and flow.syn_open and flow.source == source and flow.syn_seq == seq
    if flow is not None and opening and not repeat:
        out.append(closed(flow, "tuple_reuse"))
        flow = None
    if flow is None:
        flow = Flow(index, ts, ts, source, syn_open=bool(opening), syn_seq=seq if opening else -1)
    elif not repeat:
        flow.syn_open = False
    direction = "forward" if source == flow.source else "reverse"
    flow.packets += 1
    flow.last_event_ns = max(flow.last_event_ns, ts)
    mine, end = flow, ""
    if tcp:
        final = flow.fin_forward and flow.fin_reverse and flags & ACK and direction != flow.second_fin
        if flags & FIN:
            before = flow.fin_forward and flow.fin_reverse
            if direction == "forward":
                flow.fin_forward = True
            else:
                flow.fin_reverse = True
            if not before and flow.fin_forward and flow.fin_reverse:
                flow.second_fin = direction
        end = "tcp_reset" if flags & RST else "tcp_fin_handshake" if final else ""
    if end:
        out.append(closed(flow, end))
        return None, mine, direction, out
    return flow, mine, direction, out


SCHEMA = "capture_id string, flow_key string, row string, generation bigint, packet_index bigint, direction string, ordinal bigint, reason string, creation_ns bigint, last_event_ns bigint, packets bigint"
FIELDS = [x.split() for x in SCHEMA.split(", ")]
ARROW = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in FIELDS])


def values_of(column: pa.Array) -> list:
    """As ``to_pylist``, which makes an Arrow object of every value: whole numbers without nulls by numpy, texts once for each different one."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy().tolist()
    if pa.types.is_string(column.type) and not column.null_count:
        d = column.dictionary_encode()
        return list(map(d.dictionary.to_pylist().__getitem__, d.indices.to_numpy().tolist()))
    return column.to_pylist()


def track(packets: DataFrame, policy: FlowPolicy = FlowPolicy(), ends_only: bool = False) -> DataFrame:
    """Rows ``packet`` (its generation, direction and ordinal; none if ``ends_only``) and ``closed`` (a generation's end) of every key.

    ``packets``: ``capture_id, flow_key`` (strings), ``packet_index, timestamp_ns, watermark_ns, source, is_tcp, tcp_flags,
    sequence_number``. Keys are dealt by hash and sorted within tasks, so a task walks its rows once with one open flow.
    """
    cols = ["capture_id", "flow_key", "packet_index", "timestamp_ns", "watermark_ns", "source", "is_tcp", "tcp_flags", "sequence_number"]
    dealt = packets.select(*cols).repartition("capture_id", "flow_key").sortWithinPartitions("capture_id", "flow_key", "packet_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, flow = None, None

        def end_row(c: Closed) -> tuple:
            return (*key, "closed", c.generation, None, None, None, c.reason, c.creation_ns, c.last_event_ns, c.packets)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

        for batch in batches:
            rows: list[tuple] = []
            for cap, k, index, ts, clock, source, tcp, flags, seq in zip(*map(values_of, batch.columns), strict=True):
                if (cap, k) != key:
                    if flow is not None:
                        rows.append(end_row(closed(flow, PASSIVE)))
                    key, flow = (cap, k), None
                flow, mine, direction, ended = step(flow, index, ts, clock, source, tcp, flags or 0, seq if seq is not None else -1, policy)
                if ends_only:
                    rows += [end_row(c) for c in ended]
                    continue
                rows += [end_row(c) for c in ended if c.generation != mine.generation]
                rows.append((cap, k, "packet", mine.generation, index, direction, mine.packets, None, None, None, None))
                rows += [end_row(c) for c in ended if c.generation == mine.generation]
            if rows:
                yield batch_of(rows)
        if flow is not None:
            yield batch_of([end_row(closed(flow, PASSIVE))])

    return dealt.mapInArrow(run, SCHEMA)


def resolve_passive(closes: DataFrame, packets: DataFrame, policy: FlowPolicy = FlowPolicy(), bin_ns: int = 60 * 10**9) -> DataFrame:
    """Passive ends as idle_timeout, maximum_age or end_of_input.

    The first clock value of the capture at or over the earlier deadline decides: idle if it also passes the idle
    deadline. Deadlines and distinct clock values lie in one order, in bins of time: a window runs through each bin from
    its end, and where a bin has no later clock, the next bin's first one is taken (a window over the capture's bins).
    Nothing is joined but one row for each bin. ``closes`` are written first, as several steps read them.
    """
    closes = written(closes, "closes")
    bin_of = lambda c: F.floor(c / F.lit(bin_ns)).cast("long")
    idle, age = F.col("last_event_ns") + policy.idle_ns, F.col("creation_ns") + policy.max_age_ns
    due = F.when(F.col("reason") == PASSIVE, F.least(idle, age))
    asked = closes.withColumns({"_v": due, "_clock": F.lit(None).cast("long")}).withColumn("_b", bin_of(F.col("_v")))
    clock = packets.select("capture_id", F.col("watermark_ns").alias("_v")).distinct().withColumns({"_clock": F.col("_v"), "_b": bin_of(F.col("_v"))})
    bins = clock.groupBy("capture_id", "_b").agg(F.min("_v").alias("_first")).unionByName(asked.filter("_v is not null").select("capture_id", "_b").distinct(), allowMissingColumns=True)
    bins = bins.groupBy("capture_id", "_b").agg(F.min("_first").alias("_first"))
    later = F.last("_first", ignorenulls=True).over(W.partitionBy("capture_id").orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1))
    bins = bins.select(F.col("capture_id").alias("_cap"), F.col("_b").alias("_bin"), later.alias("_next"))
    back = W.partitionBy("capture_id", "_b").orderBy(F.desc("_v"), F.col("_clock").isNull()).rowsBetween(W.unboundedPreceding, 0)
    placed = asked.filter("_v is not null").unionByName(clock, allowMissingColumns=True).withColumn("_in", F.last("_clock", ignorenulls=True).over(back)).filter("_clock is null")
    j = placed.join(bins, F.col("capture_id").eqNullSafe(F.col("_cap")) & (F.col("_b") == F.col("_bin")), "left").withColumn("_at", F.coalesce("_in", "_next"))
    named: Column = F.when(F.col("_at").isNull(), "end_of_input").when(F.col("_at") >= idle, "idle_timeout").otherwise("maximum_age")
    done = j.withColumn("reason", named).select(*closes.columns)
    return done.unionByName(closes.filter(F.col("reason") != PASSIVE))


#: Destinations and ports of background traffic, which is no flow of the second definition.
MULTICAST = ("224.", "239.")
BACKGROUND_PORTS = (53, 67, 68, 123, 1900, 5353)


def is_background(destination_ip: Column, protocol: Column, destination_port: Column) -> Column:
    many = F.startswith(destination_ip, F.lit(MULTICAST[0])) | F.startswith(destination_ip, F.lit(MULTICAST[1]))
    return F.coalesce(many, F.lit(False)) | ((protocol == 17) & destination_port.isin(*BACKGROUND_PORTS))


def simple_flows(packets: DataFrame, idle_ns: int = 120 * 10**9) -> DataFrame:
    """The second flow definition: FIN or RST ends a flow with that packet, 120 s of silence before the next; flows of one packet are dropped.

    Only differences to the packet before matter, so it is windows: a packet starts a flow if it is the key's first,
    comes after the pause, or follows an ending packet. Keys are those of one capture if there is a ``capture_id``.
    """
    keys = [c for c in ("capture_id", "flow_key") if c in packets.columns]
    f = _numbered(packets, keys, idle_ns).groupBy(*keys, "flow").agg(
        F.count("*").alias("packets"), F.min("timestamp_ns").alias("start_ns"), F.max("timestamp_ns").alias("end_ns"), F.sum("wire_length").alias("bytes"), F.min_by("source", "packet_index").alias("forward_source")
    )
    return f.filter("packets >= 2")


def _numbered(packets: DataFrame, keys: list[str], idle_ns: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("packet_index")
    ends = F.lag(F.coalesce(F.col("tcp_flags").bitwiseAND(FIN | RST) != 0, F.lit(False))).over(w)
    late = F.col("timestamp_ns") - F.lag("timestamp_ns").over(w) > idle_ns
    return packets.withColumn("_new", F.coalesce(late | ends, F.lit(True)).cast("int")).withColumn("flow", F.sum("_new").over(w))


def simple_features(packets: DataFrame, idle_ns: int = 120 * 10**9) -> DataFrame:
    """Keys, ``flow`` and the 15 features (with origin ``src``) of every flow of :func:`simple_flows`, without background traffic.

    ``packets`` has ``destination_ip, destination_port, protocol, tcp_window`` besides. The forward side is that of the
    flow's first packet; ``active_mean`` is the mean of the positive gaps, in seconds.
    """
    keys = [c for c in ("capture_id", "flow_key") if c in packets.columns]
    quiet = packets.filter(~is_background(F.col("destination_ip"), F.col("protocol"), F.col("destination_port")))
    p = _numbered(quiet, keys, idle_ns)
    w = W.partitionBy(*keys, "flow").orderBy("packet_index")
    gap = F.col("timestamp_ns") - F.lag("timestamp_ns").over(w)
    p = p.withColumns({"_gap": F.when(gap > 0, gap), "_fw": F.col("source") == F.first("source").over(w)})
    at, size = F.col("packet_index"), F.col("wire_length")
    side = lambda on, x: F.sum(F.when(on, x).otherwise(0))
    flag = lambda bit: F.max(F.coalesce(F.col("tcp_flags").bitwiseAND(bit) != 0, F.lit(False)).cast("int"))
    dur = F.max_by("timestamp_ns", at) - F.min_by("timestamp_ns", at)  # whole numbers, divided once
    f = p.groupBy(*keys, "flow").agg(
        F.count("*").alias("_n"), F.min_by("destination_port", at).alias("dst_port"), (dur / 1000).alias("flow_dur_us"), side(F.col("_fw"), 1).alias("fwd_pkts"), side(F.col("_fw"), size).alias("fwd_bytes"),
        side(~F.col("_fw"), 1).alias("bwd_pkts"), side(~F.col("_fw"), size).alias("bwd_bytes"), F.min(size).alias("pkt_len_min"), F.avg(size).alias("pkt_len_avg"), (F.sum(size) * 1e9 / F.greatest(dur, F.lit(1))).alias("flow_bytes_s"),
        flag(8).alias("psh_flag"), flag(ACK).alias("ack_flag"), flag(FIN).alias("fin_flag"), F.coalesce(F.min_by("tcp_window", at), F.lit(0)).alias("init_win_fwd"), F.coalesce(F.avg("_gap") / 1e9, F.lit(0.0)).alias("active_mean"),
        F.min_by(F.when(F.col("protocol").isin(6, 17), F.col("protocol")).otherwise(0), at).alias("protocol_enc"),
    )
    names = [c for c in f.columns if c not in (*keys, "flow", "_n")]
    return f.filter("_n >= 2").select(*keys, "flow", *[F.col(c).cast("double").alias(c) for c in names], F.lit(0).alias("src"))
