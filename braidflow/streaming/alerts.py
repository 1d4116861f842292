"""Alert streams: scoring, flattening, dedupe, block counters, digests and the label queue."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.records import alert_confidence, alert_identity, alert_label, first_text, fused_decision, is_alert, severity
from ..operators.evidence import flatten_alerts
from ..operators.topk import round_robin


def score_stream(flows: DataFrame, model: PipelineModel, threshold: float, votes: str) -> DataFrame:
    """Probability, fused decision and the alert as a JSON line of every row; a batch DataFrame works as well."""
    p = model.transform(flows).withColumn("p", F.get(vector_to_array("probability"), F.lit(1))).drop("x", "rawPrediction", "probability")
    p = p.withColumn("decision", fused_decision(F.col("p"), threshold, F.col(votes)))
    return p.withColumn("line", F.to_json(F.struct("decision", F.struct(F.col("p").alias("probability")).alias("evidence"))))


def bridge(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tail of an alert log as flat rows."""
    return flatten_alerts(lines, column)


def replay_bridge(lines: DataFrame, attempt: Column, run_label: Column, model: str = "F9", column: str = "value") -> DataFrame:
    """Alert lines as flat dashboard rows with their replay: family and run follow from ``attempt`` (such as ``f9-dos-hulk``).

    Works on streams and batches. Lines that are no JSON or no alert are left out.
    """
    flat = flatten_alerts(lines, column, model)
    return flat.select(*flat.columns[:-1], run_label.alias("run"), F.regexp_replace(attempt, "^f9-", "").alias("replay_family"), attempt.alias("replay_run"), "packet_count")


def distinct_alerts(alerts: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First alert of each key within the delay; the state of older keys is dropped."""
    return alerts.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def block_counts(packets: DataFrame, time: str, keys: list[str], width: str = "60 seconds", delay: str = "60 seconds") -> DataFrame:
    """Counters that begin anew with every block."""
    return packets.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def alert_fields(alerts: DataFrame) -> DataFrame:
    """``alerts`` with ``label, confidence, severity, alert, identity``; fields that it does not have count as absent."""
    field = lambda c, kind="string": F.col(c).cast(kind) if c in alerts.columns else F.lit(None).cast(kind)
    label = alert_label(field("candidate"), field("terminal_class"), field("classification"), field("decision"))
    confidence = alert_confidence(*[field(c, "double") for c in ("confidence", "attack_score", "class_confidence")])
    ends = [first_text(field(a), field(b)) for a, b in (("source", "src"), ("destination", "dst"))]
    identity = alert_identity(field("model"), *ends, field("protocol"), label)
    attack = is_alert(field("decision"), label, field("attack", "boolean"))
    return alerts.withColumns({"label": label, "confidence": confidence, "severity": severity(field("decision")), "alert": attack, "identity": identity})


def digest(alerts: DataFrame, seen: DataFrame | None, cap: int, total: int) -> DataFrame:
    """New alerts worth telling, in the order of their lines: no benign ones, the first of each identity, none that was sent lately, and of those the families in turn.

    A family's alerts come in the order of their lines. ``suppressed`` says how many of a family are not told; a family of
    which none is told has one row, without a line.
    """
    a = alert_fields(alerts).filter("alert").drop("alert")
    a = a.groupBy("identity").agg(F.min_by(F.struct(*[c for c in a.columns if c != "identity"]), "line").alias("a")).select("identity", "a.*")
    if seen is not None:
        a = a.join(seen.select("identity").distinct(), "identity", "left_anti")
    return round_robin(a, "label", [F.asc("line")], cap, total).orderBy(F.asc_nulls_last("line"), "label")


def digest_counts(alerts: DataFrame, seen: DataFrame | None) -> DataFrame:
    """One row: lines that are benign, that repeat an identity, and whose identity was sent lately."""
    a = alert_fields(alerts)
    each = a.filter("alert").groupBy("identity").agg(F.count("*").alias("n"))
    late = each.filter("false") if seen is None else each.join(seen.select("identity").distinct(), "identity", "left_semi")
    parts = [a.select(F.count_if(~F.col("alert")).alias("n"), F.lit("skipped_benign").alias("what")), each.select((F.sum("n") - F.count("*")).alias("n"), F.lit("skipped_duplicate").alias("what")), late.select(F.count("*").alias("n"), F.lit("skipped_recent").alias("what"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy().pivot("what", ["skipped_benign", "skipped_duplicate", "skipped_recent"]).agg(F.coalesce(F.first("n"), F.lit(0)))


def digest_stream(alerts: DataFrame, seen_path: str, send: Callable[[DataFrame, int], None], checkpoint: str, cap: int = 3, total: int = 20, window_hours: float = 24.0, now: Callable[[], float] = time.time) -> StreamingQuery:
    """Sends a digest of every micro-batch and remembers the sent identities in a Parquet table, one folder for each batch (written again after a failure).

    An identity that was sent less than ``window_hours`` ago is not told again; after that it is news. 0 remembers nothing.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            seen = spark.read.schema("identity string, sent_at double, epoch bigint").parquet(seen_path).filter((F.col("epoch") < epoch) & (F.col("sent_at") > now() - window_hours * 3600))
        except Exception as e:  # noqa: BLE001  no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            seen = None
        best = digest(batch, seen, cap, total).persist()
        try:
            send(best, epoch)
            best.filter("identity is not null").select("identity", F.lit(now()).alias("sent_at")).write.mode("overwrite").parquet(f"{seen_path}/epoch={epoch}")
        finally:
            best.unpersist()

    return alerts.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_labels(labelled: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Labelled flows appended to the training table; models are fitted anew from it in batch."""
    return labelled.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
