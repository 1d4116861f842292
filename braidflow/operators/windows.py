"""Flow construction from packets with window functions.

Packets are ordered by their place in the capture, never by time. A window is always partitioned; where an operator
ranges over a whole capture, it works in two phases over chunks of the order, so that no capture lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import exact_sum

CHUNK = 1_000_000
BROADCAST_CHUNKS = 100_000


def hinted(df: DataFrame, rows: int = BROADCAST_CHUNKS) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``rows`` rows (counted); else as it is, for a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _prefix(packets: DataFrame, by: list[str], order: str, agg, combine, start, chunk: int, name: str) -> DataFrame:
    """Running value over each ``by`` group in two phases: chunk totals, a window over the few totals, a window inside chunks."""
    p = packets.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)).cast("long"))
    totals = p.groupBy(*by, "_chunk").agg(agg.alias("_total"))
    before = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*by, "_chunk", combine(F.col("_total")).over(before).alias("_before"))
    here = totals.select(*[F.col(c).alias(f"_of_{n}") for n, c in enumerate([*by, "_chunk"])], "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{n}")) for n, c in enumerate([*by, "_chunk"])]
    p = p.join(hinted(here), same).drop(*[f"_of_{n}" for n in range(len(same))])
    inside = W.partitionBy(*by, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return p.withColumn(name, start(F.col("_before"), agg, inside)).drop("_chunk", "_before")


def running_watermark(packets: DataFrame, by: list[str], order: str, ts: str = "timestamp_ns", chunk: int = CHUNK, name: str = "watermark_ns") -> DataFrame:
    """Non-decreasing clock of a capture: the greatest time so far in capture order."""
    return _prefix(packets, by, order, F.max(ts), F.max, lambda b, agg, w: F.greatest(b, agg.over(w)), chunk, name)


def running_max(df: DataFrame, by: list[str], order: str, value: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """Greatest ``value`` up to each row of a capture; nulls do not count."""
    return _prefix(df, by, order, F.max(value), F.max, lambda b, agg, w: F.greatest(b, agg.over(w)), chunk, name)


def watermark_at_start(flows: DataFrame, by: list[str], order: str, first: str, last: str, chunk: int = CHUNK, name: str = "watermark_ns") -> DataFrame:
    """The capture's clock at each flow's first packet, from the flows' ``first`` and greatest times, where the packets of a flow follow each other in the capture."""
    clock = lambda b, agg, w: F.greatest(b, agg.over(w.rowsBetween(W.unboundedPreceding, -1)), F.col(first))
    return _prefix(flows, by, order, F.max(last), F.max, clock, chunk, name)


def creation_numbers(packets: DataFrame, by: list[str], order: str, starts: Column, chunk: int = CHUNK, name: str = "generation") -> DataFrame:
    """Number of the generation starts so far in a capture."""
    n = F.sum(starts.cast("long"))
    return _prefix(packets, by, order, n, F.sum, lambda b, agg, w: F.coalesce(b, F.lit(0).cast("long")) + agg.over(w), chunk, name)


def running_sum(df: DataFrame, order: str, value: str, chunk: int = CHUNK, name: str = "_upto") -> DataFrame:
    """Sum of ``value`` up to each row of the whole table, in the order of a numeric column without ties."""
    return _prefix(df, [], order, F.sum(value), F.sum, lambda b, agg, w: F.coalesce(b, F.lit(0).cast("long")) + agg.over(w), chunk, name)


def idle_generations(packets: DataFrame, by: list[str], order: list[str], clock: str, idle_ns: int, name: str = "generation") -> DataFrame:
    """Numbers a key's generations: a packet whose clock is at least ``idle_ns`` after the last packet's begins one."""
    w = W.partitionBy(*by).orderBy(*order)
    last = F.lag(F.col(clock)).over(w)
    p = packets.withColumn("_new", F.when(last.isNull() | (F.col(clock) >= last + F.lit(idle_ns)), 1).otherwise(0))
    return p.withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("_new")


def with_flow_steps(packets: DataFrame, by: list[str], order: list[str], ts: str = "timestamp_ns", direction: str = "direction") -> DataFrame:
    """Adds ``ordinal`` (from 1), ``iat_ns``, ``dir_iat_ns`` (same direction), ``turn`` (direction changed), ``clock_ns`` (running maximum of time)."""
    w = W.partitionBy(*by).orderBy(*order)
    same = W.partitionBy(*by, direction).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    return packets.withColumns(
        {
            "ordinal": F.row_number().over(w).cast("long"),
            "iat_ns": F.col(ts) - F.lag(ts).over(w),
            "dir_iat_ns": F.col(ts) - F.lag(ts).over(same),
            "turn": F.coalesce((F.lag(direction).over(w) != F.col(direction)).cast("long"), F.lit(0).cast("long")),
            "clock_ns": F.max(ts).over(upto),
        }
    )


def checkpoints(packets: DataFrame, by: list[str], at=(3, 5, 7, 9)) -> DataFrame:
    """The packets up to each checkpoint that a flow reaches: one copy for each, with column ``checkpoint``."""
    size = F.max("ordinal").over(W.partitionBy(*by))
    marks = F.filter(F.array(*[F.lit(k) for k in at]), lambda k: (k >= F.col("ordinal")) & (k <= F.col("_size")))
    return packets.withColumn("_size", size).withColumn("checkpoint", F.explode(marks)).drop("_size")


def active_idle(packets: DataFrame, by: list[str], order: list[str], clock: str, gap_ns: int) -> DataFrame:
    """Mean duration (microseconds) of active segments and of the gaps, strictly over ``gap_ns``, between them."""
    w = W.partitionBy(*by).orderBy(*order)
    step = F.col(clock) - F.lag(clock).over(w)
    p = packets.withColumn("_gap", F.when(step > gap_ns, step)).withColumn("_island", F.count("_gap").over(w.rowsBetween(W.unboundedPreceding, 0)))
    segments = p.groupBy(*by, "_island").agg((F.max(clock) - F.min(clock)).alias("_active"), F.max("_gap").alias("_idle"))
    return segments.groupBy(*by).agg((F.avg("_active") / 1000).alias("active_mean_us"), F.coalesce(F.avg("_idle") / 1000, F.lit(0.0)).alias("idle_mean_us"))


def active_idle_means(clock: str, gap: str) -> dict[str, Column]:
    """As :func:`active_idle`, in the aggregation of a flow's packets, where the clock never goes back: ``gap`` is a packet's step if that is over the limit, so what is not a gap is active."""
    active = F.max(clock) - F.min(clock) - F.coalesce(F.sum(gap), F.lit(0).cast("long"))
    return {"active_mean_us": active / (F.count(gap) + 1) / 1000, "idle_mean_us": F.coalesce(F.avg(gap) / 1000, F.lit(0.0))}


def causal_contexts(flows: DataFrame, block: list[str], order: str, source: str, destination: str, port: str) -> DataFrame:
    """Counts of a block's flows up to the current one: same destination endpoint, same host pair, distinct ports of the pair."""
    upto = lambda *by: W.partitionBy(*block, *by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    first = F.row_number().over(W.partitionBy(*block, source, destination, port).orderBy(order)) == 1
    f = flows.withColumn("_first", first.cast("long"))
    return f.withColumns(
        {
            "same_endpoint": F.count("*").over(upto(destination, port)),
            "same_pair": F.count("*").over(upto(source, destination)),
            "distinct_ports": F.sum("_first").over(upto(source, destination)),
        }
    ).drop("_first")


def sliding_count(events: DataFrame, by: list[str], time: str, width: int, name: str = "recent") -> DataFrame:
    """Events of the key within ``width`` before the current one, both ends included."""
    return events.withColumn(name, F.count("*").over(W.partitionBy(*by).orderBy(time).rangeBetween(-width, 0)))


def timeout_survey(packets: DataFrame, by: list[str], order: list[str], clock: str, timeouts: list[int]) -> DataFrame:
    """Sessions and their durations for every candidate timeout, in one pass over the packets; ``total`` is a decimal, as it may pass 64 bits."""
    w = W.partitionBy(*by).orderBy(*order)
    gap = packets.select(*by, *order, clock, (F.col(clock) - F.lag(clock).over(w)).alias("_gap"))
    each = gap.withColumn("timeout", F.explode(F.array(*[F.lit(t).cast("long") for t in timeouts])))
    seen = W.partitionBy("timeout", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    s = each.withColumn("_s", F.sum(F.when(F.col("_gap").isNull() | (F.col("_gap") >= F.col("timeout")), 1).otherwise(0)).over(seen))
    sessions = s.groupBy("timeout", *by, "_s").agg((F.max(clock) - F.min(clock)).alias("duration"))
    return sessions.groupBy("timeout").agg(F.count("*").alias("sessions"), exact_sum(F.col("duration")).alias("total"), F.min("duration").alias("shortest"), F.max("duration").alias("longest"))


def peak_concurrency(flows: DataFrame, start: str, end: str, by: list[str], bucket_ns: int) -> DataFrame:
    """Greatest number of flows open at once and the first time it is reached; a flow is open from start to end inclusive.

    Changes are summed by time, then by coarse bucket; a window runs over the buckets' totals and one inside each bucket.
    """
    on = flows.select(*by, F.col(start).alias("at"), F.lit(1).cast("long").alias("d"))
    off = flows.select(*by, (F.col(end) + 1).alias("at"), F.lit(-1).cast("long").alias("d"))
    steps = on.unionByName(off).groupBy(*by, "at").agg(F.sum("d").alias("d")).withColumn("b", F.floor(F.col("at") / F.lit(bucket_ns)).cast("long"))
    totals = steps.groupBy(*by, "b").agg(F.sum("d").alias("t"))
    totals = totals.withColumn("base", F.coalesce(F.sum("t").over(W.partitionBy(*by).orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("t")
    open_ = F.col("base") + F.sum("d").over(W.partitionBy(*by, "b").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    levels = steps.join(totals, [*by, "b"]).withColumn("open", open_)
    top = levels.groupBy(*by).agg(F.max(F.struct(F.col("open"), -F.col("at"))).alias("m"))
    return top.select(*by, F.col("m.open").alias("peak"), (-F.col("m.col2")).alias("peak_at"))


def value_before(df: DataFrame, by: list[str], order: str, value: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """The value of the row before in the order of a whole capture (null for its first row), in two phases as in :func:`running_watermark`."""
    p = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)).cast("long"))
    ends = p.groupBy(*by, "_chunk").agg(F.max_by(F.struct(value), order).alias("_last"))
    ends = ends.select(*[F.col(c).alias(f"_of_{n}") for n, c in enumerate([*by, "_chunk"])], F.lag("_last").over(W.partitionBy(*by).orderBy("_chunk")).alias("_last"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{n}")) for n, c in enumerate([*by, "_chunk"])]
    p = p.join(hinted(ends), same).drop(*[f"_of_{n}" for n in range(len(same))])
    w = W.partitionBy(*by, "_chunk").orderBy(order)
    first = F.row_number().over(w) == 1
    return p.withColumn(name, F.when(first, F.col(f"_last.{value}")).otherwise(F.lag(value).over(w))).drop("_chunk", "_last")


def time_regressions(packets: DataFrame, by: list[str], order: str, ts: str) -> DataFrame:
    """Equal and decreasing neighbours in capture order."""
    d = value_before(packets.select(*by, order, ts), by, order, ts, "_before").select(*by, (F.col(ts) - F.col("_before")).alias("d"))
    return d.groupBy(*by).agg(F.count_if(F.col("d") == 0).alias("duplicates"), F.count_if(F.col("d") < 0).alias("regressions"))


def epochs(lines: DataFrame, by: list[str], order: str, ready: Column, name: str = "epoch") -> DataFrame:
    """Number of ready events so far: a sensor's runtime."""
    return creation_numbers(lines, by, order, ready, name=name)


def incidents(alerts: DataFrame, by: list[str], order: str, checkpoint: str) -> DataFrame:
    """First alert of a flow ``created``, later ones ``updated`` with a running index; a checkpoint that does not grow is an error."""
    w = W.partitionBy(*by).orderBy(order)
    n = F.row_number().over(w)
    return alerts.withColumns(
        {"state": F.when(n == 1, "created").otherwise("updated"), "update_index": (n - 1).cast("long"), "out_of_order": F.coalesce(F.col(checkpoint) <= F.lag(checkpoint).over(w), F.lit(False))}
    )


def packet_sequences(packets: DataFrame, by: list[str], most: int = 9) -> DataFrame:
    """The first packets of each flow as one ordered array; its length is bounded by ``most``."""
    first = packets.filter(F.col("ordinal") <= most)
    item = F.struct("ordinal", F.coalesce("iat_ns", F.lit(0).cast("long")).alias("delta_ns"), "direction", "wire_length", "payload_length")
    return first.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("packets"))
