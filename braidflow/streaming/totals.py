"""What a stream keeps of one open flow: running moments, from which its features follow at any packet.

The batch job has the same features as one grouped aggregation; a stream sees a flow's packets over many micro-batches,
so it carries counts, sums and moments of fixed size.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from ..operators.features import FLAG_BITS, IDLE_GAP_NS, NAMES, TERMINAL_NAMES

GROUPS = (
    "packet_length", "forward_packet_length", "reverse_packet_length", "flow_iat", "forward_iat", "reverse_iat", "tcp_window", "ttl", "payload_length", "header_length", "forward_ttl", "reverse_ttl", "active", "idle",
)
#: The features of a closed flow that one key's packets tell; contexts of other flows are not among them.
OWN_NAMES = tuple(n for n in TERMINAL_NAMES if not n.startswith("context_"))


@dataclass
class Totals:
    first_ns: int = 0
    last_ns: int = 0
    clock_ns: int = 0
    began_ns: int = 0
    side: str = ""
    turns: int = 0
    protocol: int = 0
    source_port: int = 0
    destination_port: int = 0
    packets: dict[str, int] = field(default_factory=dict)
    wire: dict[str, int] = field(default_factory=dict)
    full: dict[str, int] = field(default_factory=dict)
    payload: dict[str, int] = field(default_factory=dict)
    window: dict[str, int] = field(default_factory=dict)
    side_ns: dict[str, int] = field(default_factory=dict)
    flags: dict[str, int] = field(default_factory=dict)
    fins: dict[str, int] = field(default_factory=dict)
    moments: dict[str, list[float]] = field(default_factory=dict)

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def load(text: str) -> Totals:
        return Totals(**json.loads(text))

    def _seen(self, group: str, x: float) -> None:
        """Count, mean, squared deviations, least and greatest value of a group."""
        n, mean, m2, lo, hi = self.moments.get(group, (0, 0.0, 0.0, math.inf, -math.inf))
        d = x - mean
        mean += d / (n + 1)
        self.moments[group] = [n + 1, mean, m2 + d * (x - mean), min(lo, x), max(hi, x)]

    def add(self, ts: int, side: str, wire: int, payload: int, header: int, ttl: int, window: int | None, flags: int | None, protocol: int, source_port: int, destination_port: int, gap_ns: int = IDLE_GAP_NS) -> None:
        first = not self.packets
        if first:
            self.first_ns = self.clock_ns = self.began_ns = ts
            self.protocol, self.source_port, self.destination_port = protocol, source_port, destination_port
        else:
            self.turns += side != self.side
            self._seen("flow_iat", (ts - self.last_ns) / 1000)
            step = max(ts - self.clock_ns, 0)
            if step > gap_ns:
                self._seen("active", (self.clock_ns - self.began_ns) / 1000)
                self._seen("idle", step / 1000)
                self.began_ns = self.clock_ns + step
            self.clock_ns += step
        if side in self.side_ns:
            self._seen(f"{side}_iat", (ts - self.side_ns[side]) / 1000)
        self.last_ns, self.side, self.side_ns[side] = ts, side, ts
        for into, n in ((self.packets, 1), (self.wire, wire), (self.full, payload > 0), (self.payload, payload)):
            into[side] = into.get(side, 0) + int(n)
        for group, x in (("packet_length", wire), (f"{side}_packet_length", wire), ("payload_length", payload), ("header_length", header), ("ttl", ttl), (f"{side}_ttl", ttl)):
            self._seen(group, x)
        if window is not None:
            self.window.setdefault(side, window)
            self._seen("tcp_window", window)
        for name, bit in FLAG_BITS.items():
            self.flags[name] = self.flags.get(name, 0) + int(bool((flags or 0) & bit))
        self.fins[side] = self.fins.get(side, 0) + int(bool((flags or 0) & FLAG_BITS["fin"]))

    def features(self) -> dict[str, float]:
        """All features by name; those of a closed flow hold if no more packets come."""
        stat = {g: self.moments.get(g, [0, 0.0, 0.0, 0.0, 0.0]) for g in GROUPS}
        out: dict[str, float] = {}
        for g in GROUPS[:10]:
            unit = "_us" if g.endswith("iat") else ""
            out[f"{g}_mean{unit}"], out[f"{g}_std{unit}"] = stat[g][1], math.sqrt(stat[g][2] / stat[g][0]) if stat[g][0] else 0.0
        for g, unit in (("packet_length", ""), ("flow_iat", "_us"), ("ttl", ""), ("payload_length", "")):
            out[f"{g}_min{unit}"], out[f"{g}_max{unit}"] = stat[g][3:]
        age = (max(self.first_ns, self.latest()) - self.first_ns) / 1000
        both = lambda d: sum(d.values())
        per = lambda a, b: a / b if b else 0.0
        rate = lambda n: n * 1e6 / age if age > 0 else 0.0
        out |= {"flow_age_us": age, "packet_count": both(self.packets), "wire_byte_count": both(self.wire), "payload_packet_count": both(self.full), "payload_byte_count": both(self.payload), "direction_change_count": self.turns}
        for s in ("forward", "reverse"):
            out |= {f"{s}_packet_count": self.packets.get(s, 0), f"{s}_wire_byte_count": self.wire.get(s, 0), f"{s}_payload_packet_count": self.full.get(s, 0), f"{s}_payload_byte_count": self.payload.get(s, 0), f"tcp_initial_{s}_window": self.window.get(s, 0)}
            out |= {f"{s}_ttl_mean": stat[f"{s}_ttl"][1], f"{s}_wire_bit_rate_per_second": rate(8 * self.wire.get(s, 0))}
        out |= {f"tcp_{n}_count": c for n, c in self.flags.items()}
        out |= {"packet_rate_per_second": rate(out["packet_count"]), "wire_byte_rate_per_second": rate(out["wire_byte_count"]), "tcp_syn_ack_ratio": per(self.flags.get("syn", 0), self.flags.get("ack", 0))}
        out |= {"forward_reverse_packet_ratio": per(out["forward_packet_count"], out["reverse_packet_count"]), "forward_reverse_wire_byte_ratio": per(out["forward_wire_byte_count"], out["reverse_wire_byte_count"])}
        n, mean = stat["active"][:2]
        tcp, reset = self.protocol == 6, self.flags.get("rst", 0) > 0
        fin = tcp and not reset and self.fins.get("forward", 0) > 0 and self.fins.get("reverse", 0) > 0
        out |= {
            "active_mean_us": (mean * n + (self.clock_ns - self.began_ns) / 1000) / (n + 1), "idle_mean_us": stat["idle"][1], "protocol_number": self.protocol, "first_observed_source_port": self.source_port,
            "first_observed_destination_port": self.destination_port, "lifecycle_tcp_reset": tcp and reset, "lifecycle_tcp_fin_handshake": fin, "lifecycle_tcp_other": tcp and not reset and not fin, "lifecycle_udp": not tcp,
        }
        return {k: float(v) for k, v in out.items()}

    def latest(self) -> int:
        return self.clock_ns

    def snapshot(self) -> list[float]:
        f = self.features()
        return [f[n] for n in NAMES]

    def terminal(self) -> list[float]:
        f = self.features()
        return [f[n] for n in OWN_NAMES]
