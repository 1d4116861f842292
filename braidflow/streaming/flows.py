"""Flow tracking, incidents, alert gates and session counts on streams.

Every operator keeps a small state for each key and names the reference rules only through the batch modules, so that a
stream and a batch over the same rows give the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.flow_machine import PASSIVE, Flow, FlowPolicy, closed, step
from .totals import Totals

FLOW_EVENTS = (
    "capture_id string, flow_key string, event string, generation bigint, ordinal bigint, at_ns bigint, reason string, creation_ns bigint, last_event_ns bigint, packets bigint, features array<double>"
)
COLUMNS = [x.split()[0] for x in FLOW_EVENTS.split(", ")]
CHECKPOINTS = (3, 5, 7, 9)
#: What a packet brings for the features; without these columns a stream gives events alone.
MEASURED = ("wire_length", "payload_length", "header_length", "ttl", "tcp_window", "protocol", "source_port", "destination_port")


def _int(x, absent: int | None = 0) -> int | None:
    """A column's integer; pandas has NaN for null."""
    return absent if pd.isna(x) else int(x)


class FlowProcessor(StatefulProcessor):
    """Checkpoint and close events of one capture's key. Gaps inside a batch are judged while its rows are read; a timer closes what falls silent."""

    def __init__(self, policy: FlowPolicy = FlowPolicy(), measured: bool = False):
        self.policy, self.measured = policy, measured

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("flow", "flow string, clock bigint, totals string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        flow, clock, totals = None, 0, None
        if self.state.exists():
            text, clock, kept = self.state.get()
            flow, totals = Flow.load(text) if text else None, Totals.load(kept) if kept else None
        out = []
        for r in pd.concat(list(rows)).sort_values("packet_index", kind="stable").itertuples(index=False):
            ts = int(r.timestamp_ns)
            clock = max(clock, ts)
            flow, mine, direction, ended = step(flow, int(r.packet_index), ts, clock, r.source, bool(r.is_tcp), _int(r.tcp_flags), _int(r.sequence_number, -1), self.policy)
            out += [self.end(key, c, totals, clock) for c in ended if c.generation != mine.generation]
            if self.measured:
                totals = totals if totals is not None and mine.packets > 1 else Totals()
                window = _int(r.tcp_window, None) if bool(r.is_tcp) else None
                totals.add(ts, direction, *(_int(getattr(r, c)) for c in MEASURED[:4]), window, _int(r.tcp_flags, None), *(_int(getattr(r, c)) for c in MEASURED[5:]))
            if mine.packets in CHECKPOINTS:
                out.append((*key, "checkpoint", mine.generation, mine.packets, ts, None, None, None, None, totals.snapshot() if totals else None))
            out += [self.end(key, c, totals, clock) for c in ended if c.generation == mine.generation]
        self.keep(flow, clock, totals)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        text, clock, kept = self.state.get()
        flow, totals = Flow.load(text) if text else None, Totals.load(kept) if kept else None
        now = timerValues.getCurrentWatermarkInMs()
        if flow is None or min(flow.deadlines(self.policy)) // 1_000_000 > now:
            self.keep(flow, clock, totals)
            return
        yield pd.DataFrame([self.end(key, closed(flow, PASSIVE), totals, min(flow.deadlines(self.policy)))], columns=COLUMNS)
        self.state.clear()

    def end(self, key, c, totals: Totals | None, clock: int) -> tuple:
        """A close; a passive one is idle where the clock that ended it had passed the idle deadline, else it is of age.

        The stream's clock is that of the key and the watermark's; the batch job judges by the whole capture's.
        """
        reason = c.reason
        if reason == PASSIVE:
            reason = "idle_timeout" if clock >= c.last_event_ns + self.policy.idle_ns else "maximum_age"
        return *key, "close", c.generation, None, None, reason, c.creation_ns, c.last_event_ns, c.packets, totals.terminal() if totals else None

    def keep(self, flow: Flow | None, clock: int, totals: Totals | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if flow is None:
            self.state.clear()
            return
        self.state.update((flow.dump(), clock, totals.dump() if totals else None))
        self.handle.registerTimer(min(flow.deadlines(self.policy)) // 1_000_000 + 1)

    def close(self) -> None:
        pass


def track_stream(packets: DataFrame, policy: FlowPolicy = FlowPolicy(), delay: str = "1 hour") -> DataFrame:
    """Events of flows from a stream of packets with the columns of :func:`..operators.flow_machine.track` but the clock.

    If the packets have the columns of :data:`MEASURED`, a checkpoint carries its 54 ``features`` and a close those of
    :data:`.totals.OWN_NAMES`. ``delay`` bounds the state that waits for late packets; packets later than that are lost
    to the stream (the batch job has them), so choose more than the worst regression of the source.
    """
    p = packets.withColumn("at", F.timestamp_micros(F.floor(F.col("timestamp_ns") / 1000).cast("long"))).withWatermark("at", delay)
    processor = FlowProcessor(policy, all(c in packets.columns for c in MEASURED))
    return p.groupBy("capture_id", "flow_key").transformWithStateInPandas(processor, outputStructType=FLOW_EVENTS, outputMode="Append", timeMode="EventTime")


class IncidentProcessor(StatefulProcessor):
    """First alert of a flow is ``created``, later ones ``updated``; a checkpoint that does not grow is marked.

    An incident without alerts for ``ttl_ms`` (of the cluster's clock) is forgotten, so that state does not grow for ever.
    """

    def __init__(self, ttl_ms: int = 24 * 3600 * 1000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("incident", "n bigint, checkpoint bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.state.get() if self.state.exists() else (0, -1)
        out = []
        for r in pd.concat(list(rows)).sort_values("line", kind="stable").itertuples(index=False):
            out.append((key[0], int(r.line), "updated" if n else "created", n, bool(n and r.checkpoint <= last)))
            n, last = n + 1, int(r.checkpoint)
        self.state.update((n, last))
        yield pd.DataFrame(out, columns=["flow_id", "line", "state", "update_index", "out_of_order"])

    def close(self) -> None:
        pass


def incident_stream(alerts: DataFrame, ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    return alerts.groupBy("flow_id").transformWithStateInPandas(
        IncidentProcessor(ttl_ms), outputStructType="flow_id bigint, line bigint, state string, update_index bigint, out_of_order boolean", outputMode="Append", timeMode="ProcessingTime"
    )


#: Seconds for which a layer's equal alerts are held back, and for which an attacker is remembered.
COOLDOWN = {"packet": 15, "flow": 30, "session": 600, "http": 30, "dns": 60}
ATTACKER_MEMORY = 300


def gate(events: list[tuple], last: dict[str, int], attackers: dict[str, int]) -> list[int]:
    """Places of the events that pass: (place, time, layer, identity, source, destination, score, threshold), in order of time.

    A destination that was an attacker lately is not a target: its event is dropped before the cooldown is looked at,
    and dropped events change nothing.
    """
    out = []
    for place, at, layer, identity, source, destination, score, threshold in events:
        if score < threshold or at - attackers.get(destination, -(10**18)) < ATTACKER_MEMORY:
            continue
        if at - last.get(identity, -(10**18)) < COOLDOWN[layer]:
            continue
        last[identity] = attackers[source] = at
        out.append(place)
    return out


class GateProcessor(StatefulProcessor):
    """A map of last alerts and one of attackers for each site: a batch reads and writes only the entries that it names.

    Times are those of events. Whenever the site's clock has moved on by the longest memory, what is older is removed, so
    an entry is walked over once in that time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last, self.attackers = (handle.getMapState(name, "name string", "at bigint") for name in ("last", "attackers"))
        self.swept = handle.getValueState("swept", "at bigint")

    def sweep(self, now: int) -> None:
        """Removes what no rule looks at any more."""
        memory = max(ATTACKER_MEMORY, *COOLDOWN.values())
        if not self.swept.exists():
            self.swept.update((now,))
        elif now - self.swept.get()[0] >= memory:
            for state in (self.last, self.attackers):
                for k in [k for k, (t,) in state.iterator() if now - t >= memory]:
                    state.removeKey(k)
            self.swept.update((now,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["at_s", "line"], kind="stable").reset_index(drop=True)
        held = []
        for state, names in ((self.last, pdf["identity"]), (self.attackers, pdf["destination"])):
            held.append({k: int(state.getValue((k,))[0]) for k in names.dropna().unique() if state.containsKey((k,))})
        last, attackers = ({**h} for h in held)
        items = [(k, int(r.at_s), r.layer, r.identity, r.source, r.destination, float(r.score), float(r.threshold)) for k, r in enumerate(pdf.itertuples(index=False))]
        passed = gate(items, last, attackers)
        for state, now, before in ((self.last, last, held[0]), (self.attackers, attackers, held[1])):
            for k, t in now.items():
                if k is not None and before.get(k) != t:
                    state.updateValue((k,), (t,))
        self.sweep(int(pdf["at_s"].max()))
        yield pdf.iloc[passed][["site", "line", "layer", "identity"]]

    def close(self) -> None:
        pass


def gate_stream(events: DataFrame) -> DataFrame:
    """Alerts of each monitored site that pass thresholds, attacker suppression and cooldown; one ordered state for each site."""
    return events.groupBy("site").transformWithStateInPandas(GateProcessor(), outputStructType="site string, line bigint, layer string, identity string", outputMode="Append", timeMode="None")


class SessionCounter(StatefulProcessor):
    """Records of a key in the last 60 seconds before each one, both ends included, in order of arrival."""

    def __init__(self, width: int = 60):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("times", "t bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = [t[0] for t in self.seen.get()] if self.seen.exists() else []
        out = []
        for r in pd.concat(list(rows)).sort_values("line", kind="stable").itertuples(index=False):
            times = [t for t in times if t >= r.at_s - self.width] + [int(r.at_s)]
            out.append((key[0], int(r.line), len(times)))
        self.seen.put([(t,) for t in times])
        yield pd.DataFrame(out, columns=["key", "line", "recent"])

    def close(self) -> None:
        pass


def session_count_stream(records: DataFrame, width: int = 60) -> DataFrame:
    return records.groupBy("key").transformWithStateInPandas(SessionCounter(width), outputStructType="key string, line bigint, recent bigint", outputMode="Append", timeMode="None")
