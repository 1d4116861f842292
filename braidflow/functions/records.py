"""Column functions on label rows, alerts and attempts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000
#: Decisions and labels that are no alert; decisions that are uncertain; decisions that keep their name.
BENIGN_NAMES = ("benign", "normal", "no_alert", "none")
UNCERTAIN_NAMES = ("uncertain", "unknown_candidate", "unknown")
CANONICAL = ("known_attack", "unknown_candidate", "uncertain", "benign")
#: Family of every class that a flow may be assigned.
FAMILIES = {
    "BENIGN": "Benign", "FTP-Patator": "FTP-Bruteforce", "SSH-Patator": "SSH-Bruteforce", "PortScan": "PortScan", "DDoS": "DoS", "DoS GoldenEye": "DoS", "DoS Hulk": "DoS",
    "DoS Slowhttptest": "DoS", "DoS slowloris": "DoS", "Bot": "Other", "Infiltration": "Other", "Web Attack – Brute Force": "Other", "Web Attack – Sql Injection": "Other", "Web Attack – XSS": "Other",
}


def parse_local_time(text: Column, zone: str = "America/Moncton") -> Column:
    """Nanoseconds since the epoch of a day-month-year time with or without seconds, in a local zone."""
    at = F.coalesce(F.try_to_timestamp(text, F.lit("d/M/yyyy H:m:s")), F.try_to_timestamp(text, F.lit("d/M/yyyy H:m")))
    return F.unix_micros(F.to_utc_timestamp(at, zone)) * 1000


def time_variants(ns: Column, hour: Column) -> Column:
    """Hours 1 to 11 without a half-day mark may also mean the afternoon: array of variant and time."""
    as_written = F.struct(F.lit("as_written").alias("variant"), ns.alias("ns"))
    later = F.struct(F.lit("plus_12h").alias("variant"), (ns + 12 * 3600 * NS).alias("ns"))
    return F.when(hour.between(1, 11), F.array(as_written, later)).otherwise(F.array(as_written))


def label_bounds(start_ns: Column, resolution_s: Column, duration_us: Column) -> dict[str, Column]:
    """A start known to a resolution, and an end after a duration, give bounds of both."""
    start_max = start_ns + resolution_s.cast("long") * F.lit(NS)
    return {"start_min_ns": start_ns, "start_max_ns": start_max, "end_min_ns": start_ns + duration_us * 1000, "end_max_ns": start_max + duration_us * 1000}


def quarantine_reason(protocol: Column, duration: Column) -> Column:
    return F.when(protocol == 0, "unsupported_protocol").when(duration < 0, "negative_duration")


def binary_label(value: Column, benign: str) -> Column:
    return (F.lower(F.trim(value)) != benign.lower()).cast("int")


def family_of(label: Column, families: dict[str, str] = FAMILIES) -> Column:
    """Family of a class; a class that no family names fails the job."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for item in families.items() for x in item]), label)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("class without a family: "), F.coalesce(label, F.lit("null")))).cast("string"))


def first_text(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


def alert_label(candidate: Column, terminal_class: Column, classification: Column, decision: Column) -> Column:
    """The attack family that an alert names; ``unknown`` without any."""
    return F.coalesce(first_text(candidate, terminal_class, classification, decision), F.lit("unknown"))


def alert_confidence(confidence: Column, attack_score: Column, class_confidence: Column) -> Column:
    return F.coalesce(confidence, attack_score, class_confidence)


def is_alert(decision: Column, label: Column, attack_flag: Column) -> Column:
    """A decision that is present, with neither it nor the label benign; a false attack flag overrides both."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (plain(decision) != "") & ~plain(decision).isin(*BENIGN_NAMES) & ~plain(label).isin(*BENIGN_NAMES) & F.coalesce(attack_flag, F.lit(True))


def severity(decision: Column) -> Column:
    return F.when(F.lower(F.trim(F.coalesce(decision, F.lit("")))).isin(*UNCERTAIN_NAMES), "uncertain").otherwise("attack")


def normal_decision(decision: Column) -> Column:
    """A terminal event's decision: one of the four canonical names, or an attack."""
    d = F.lower(F.trim(F.coalesce(decision, F.lit(""))))
    return F.when(d.isin(*CANONICAL), d).otherwise("known_attack")


def normal_class(decision: Column, candidate: Column, terminal_class: Column) -> Column:
    """A terminal event's class beside :func:`normal_decision`: where the decision is a class name, that; else the given class, ``Benign`` or the candidate."""
    raw = F.trim(F.coalesce(decision, F.lit("")))
    d = F.lower(raw)
    named = F.coalesce(first_text(terminal_class), F.when(d == "benign", "Benign"), first_text(candidate), raw)
    return F.when(d.isin(*CANONICAL), named).otherwise(F.coalesce(first_text(raw, candidate), F.lit("?")))


def alert_identity(model: Column, source: Column, destination: Column, protocol: Column, label: Column) -> Column:
    """Tells alerts apart: model, endpoints (``?`` if absent), protocol (empty if absent) and label."""
    known = lambda c: F.coalesce(first_text(c.cast("string")), F.lit("?"))
    return F.sha2(F.concat_ws("|", known(model), known(source), known(destination), F.coalesce(protocol.cast("string"), F.lit("")), label), 256)


def family_slug(attempt: Column) -> Column:
    """Case name of an attempt: without its prefix and run suffix."""
    return F.regexp_replace(F.regexp_replace(attempt, "^f9-", ""), "-r[0-9]+(t[0-9]+)?$", "")


def attempt_outcome(ready: Column, alerts: Column, foreign: Column, packets: Column, needed: int) -> Column:
    return (
        F.when(~ready, "sensor_not_ready")
        .when(alerts > 0, "alert")
        .when(foreign > 0, "foreign_flow")
        .when(packets == 0, "no_capture")
        .when(packets < needed, "short_capture")
        .otherwise("no_alert")
    )


def encode_label(label: Column, order: list[str]) -> Column:
    """Index of a class in ``order``; -1 if absent."""
    return F.array_position(F.array(*map(F.lit, order)), label).cast("int") - 1


def fused_decision(probability: Column, threshold: float, votes: Column) -> Column:
    """Known attack by probability, else by the number of anomaly votes."""
    return F.when(probability >= threshold, "known_attack").when(votes >= 2, "unknown_candidate").when(votes == 1, "uncertain").otherwise("benign")


def gated_class(probabilities: Column, names: list[str], threshold: float) -> Column:
    """Best attack class where the attack score ``1 - p[0]`` reaches the threshold; else the first name."""
    attack = F.slice(probabilities, 2, len(names) - 1)
    best = F.array_position(attack, F.array_max(attack)).cast("int")
    return F.when(1 - F.get(probabilities, F.lit(0)) >= threshold, F.element_at(F.array(*map(F.lit, names)), best + 1)).otherwise(names[0])
