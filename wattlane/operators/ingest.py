"""From valid messages to stored tables: dedup, status history, events, metrics rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import natural_id
from ..settings import Settings
from .ordered import first_arrival
from .policy import mark_triggering, storage_decision
from .rules import HIT_COLUMNS, to_events


def dedup_readings(readings: DataFrame) -> DataFrame:
    """First arrival per (time, device_id) with the number of copies seen."""
    return first_arrival(readings, ["time", "device_id"], "offset", "copies")


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows to append: first arrival per key that the target does not hold yet."""
    if order is not None:
        rows = first_arrival(rows, list(keys), order)
    return rows.join(target.select(*keys), list(keys), "left_anti").select(*rows.columns)


def stored_readings(readings: DataFrame, hits: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Deduplicated readings with the storage decision.

    Rules and policy see every copy; the first copy that the policy keeps is stored, and
    the first arrival stands for a reading of which none is kept. ``kept`` and ``copies``
    count the copies that passed the policy and all of them.
    """
    copies = storage_decision(mark_triggering(readings, hits), settings)
    keys = ["time", "device_id"]
    order = F.when(F.col("store_raw"), F.col("offset"))
    chosen = copies.groupBy(*keys).agg(
        F.coalesce(F.min(order), F.min("offset")).alias("offset"), F.count("*").alias("copies"),
        F.count_if("store_raw").alias("kept"),
    ).select(F.col("time").alias("_t"), F.col("device_id").alias("_d"), F.col("offset").alias("_o"), "copies", "kept")
    same = (F.col("offset") == F.col("_o")) & F.col("time").eqNullSafe(F.col("_t")) & F.col("device_id").eqNullSafe(F.col("_d"))
    return copies.join(chosen, same).select(*copies.columns, "copies", "kept")


def status_history(status: DataFrame) -> DataFrame:
    """Status messages as history rows; a reason becomes metadata JSON."""
    return status.select(
        natural_id("device_id", "time", "offset").alias("id"),
        "time", "device_id", "status", "firmware_version", "ip_address", "rssi_dbm",
        F.when(F.col("reason").isNotNull() & (F.col("reason") != ""), F.to_json(F.struct("reason"))).alias("metadata"),
    )


def _event(rows: DataFrame, event_type, severity, rule: str, message, metadata) -> DataFrame:
    return rows.select(
        natural_id("device_id", "time", F.lit(rule), "offset").alias("event_id"),
        "time", "device_id", event_type.alias("event_type"), severity.alias("severity"),
        F.lit(rule).alias("rule_name"), message.alias("message"),
        F.lit(None).cast("timestamp").alias("reading_time"), F.lit(None).cast("double").alias("event_value"),
        F.lit(None).cast("double").alias("threshold_value"), metadata.alias("metadata"),
        F.lit(False).alias("acknowledged"), "offset",
    )


def offline_events(status: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Reported offline -> CRITICAL event; none in baseline mode."""
    down = status.where(F.col("status") == "offline")
    if settings.processing_mode != "proposed":
        down = down.where(F.lit(False))
    return _event(
        down, F.lit("DEVICE_FAILURE"), F.lit("CRITICAL"), "device_offline_status",
        F.concat(F.lit("Device "), F.col("device_id"), F.lit(" reported offline")),
        F.to_json(F.struct("reason"), {"ignoreNullFields": "false"}),
    )


def reported_events(device_events: DataFrame) -> DataFrame:
    """Device-originated events as event rows."""
    return _event(
        device_events, F.col("event_type"), F.col("severity"), "device_event", F.col("message"),
        F.lit('{"source":"device"}'),
    )


def merge_hits(rule_hits: DataFrame, model_hits: DataFrame, mode: str) -> DataFrame:
    """Events of rules only, model only, or both."""
    if mode == "rules":
        return to_events(rule_hits)
    if mode == "ml":
        return to_events(model_hits.select(*HIT_COLUMNS))
    if mode != "hybrid":
        raise ValueError(f"unknown detection mode {mode!r}")
    return to_events(rule_hits.unionByName(model_hits.select(*HIT_COLUMNS)))


def metric_rows(counters: DataFrame, latencies: DataFrame, at: str) -> DataFrame:
    """Counters and latency statistics in the long metrics form with JSON labels."""
    time = F.lit(at).cast("timestamp")
    counts = counters.select(
        time.alias("time"), F.concat(F.lit("counter."), F.col("name")).alias("metric_name"),
        F.col("value").cast("double").alias("metric_value"),
        F.to_json(F.struct(F.lit("counter").alias("kind"), F.col("name").alias("name"))).alias("labels"),
    )
    stats = ("avg_ms", "p50_ms", "p95_ms", "p99_ms")
    long = latencies.where("count > 0").unpivot(["operation"], list(stats), "stat", "metric_value")
    lats = long.select(
        time.alias("time"), F.concat_ws(".", F.lit("latency"), "operation", "stat").alias("metric_name"),
        "metric_value",
        F.to_json(F.struct(F.lit("latency").alias("kind"), "operation", "stat")).alias("labels"),
    )
    return counts.unionByName(lats)

