"""Series, lookups, latest values, top-k and list queries."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import decimal_round, iso, seconds_between
from .aggregates import in_range
from .ordered import HOUR_US, neighbour


def filter_events(events: DataFrame, *, device=None, event_type=None, severity=None, start=None, end=None) -> DataFrame:
    """Conjunction of the given filters."""
    for name, value in (("device_id", device), ("event_type", event_type), ("severity", severity)):
        if value is not None:
            events = events.where(F.col(name) == value)
    return in_range(events, start, end)


def filter_readings(readings: DataFrame, device: str, start=None, end=None) -> DataFrame:
    return in_range(readings.where(F.col("device_id") == device), start, end)


def wildcard_events(events: DataFrame, start, end, severity: str = "ALL", event_type: str = "ALL") -> DataFrame:
    """Dashboard filter where ALL switches a condition off; the constant test folds away."""
    cond = F.lit(True)
    for name, value in (("severity", severity), ("event_type", event_type)):
        cond = cond & ((F.lit(value) == "ALL") | (F.col(name) == value))
    return in_range(events, start, end).where(cond)


def lookup(df: DataFrame, **key) -> DataFrame:
    """Point lookup by key equality."""
    for name, value in key.items():
        df = df.where(F.col(name) == value)
    return df.limit(1)


def newest_first(df: DataFrame, limit: int, maximum: int, *ties: str) -> DataFrame:
    """Newest rows first, the limit capped at ``maximum``; ties in a fixed order."""
    return df.orderBy(F.desc("time"), *ties).limit(max(1, min(limit, maximum)))


def list_devices(devices: DataFrame, limit: int = 500, maximum: int = 5000) -> DataFrame:
    return devices.orderBy("device_id").limit(max(1, min(limit, maximum)))


def recent_arrivals(df: DataFrame, limit: int = 50, ring: int = 500) -> DataFrame:
    """Last rows of a ring buffer, in arrival order."""
    return df.orderBy(F.desc("offset")).limit(min(limit, ring)).orderBy("offset")


def raw_series(readings: DataFrame, device: str, metric: str, start, end) -> DataFrame:
    return filter_readings(readings, device, start, end).select("time", metric).orderBy("time")


def latency_series(metrics: DataFrame, operation: str, start, end) -> DataFrame:
    """Latency statistics of one operation, the metric prefix cut off."""
    prefix = f"latency.{operation}."
    names = [prefix + s for s in ("avg_ms", "p50_ms", "p95_ms", "p99_ms")]
    rows = in_range(metrics.where(F.col("metric_name").isin(*names)), start, end)
    return rows.select(
        "time", F.replace("metric_name", F.lit(prefix), F.lit("")).alias("metric"),
        F.col("metric_value").alias("value"),
    ).orderBy("time")


def counter_rate(metrics: DataFrame, metric: str, label: str, *, slot_us: int = HOUR_US) -> DataFrame:
    """Counter to rate per minute; a counter that restarts counts as no increase."""
    rows = neighbour(
        metrics.where(F.col("metric_name") == metric), ["metric_name"], "time", "metric_value",
        ["time", "metric_value"], slot_us=slot_us,
    )
    step = F.greatest(F.col("metric_value") - F.col("previous_metric_value"), F.lit(0.0))
    seconds = F.greatest(seconds_between("time", "previous_time"), F.lit(1.0))
    return rows.where(F.col("previous_metric_value").isNotNull()).select(
        "time", (step / seconds * F.lit(60.0)).alias(label)
    ).orderBy("time")


def latest_by_device(readings: DataFrame) -> DataFrame:
    """Latest reading of each device, rounded for display."""
    # One max_by per number keeps the aggregate hash-based; (time, device_id) is unique.
    values = ("voltage_v", "current_a", "power_w", "temperature_c")
    last = readings.groupBy("device_id").agg(
        F.max("time").alias("last_seen"), *[F.max_by(c, "time").alias(c) for c in values]
    )
    return last.select("device_id", "last_seen", *[decimal_round(c).alias(c) for c in values])


def latest_value(df: DataFrame, value: str, *, rounded: bool = False) -> DataFrame:
    """Value of the latest row, 0 if there is none."""
    last = F.max_by(value, "time")
    return df.agg(F.coalesce(decimal_round(last) if rounded else last, F.lit(0.0)).alias("value"))


def device_state(history: DataFrame, devices: DataFrame, device: str) -> DataFrame:
    """Latest history status, else the stored device status, else 'unknown'."""
    def ranked(rows: DataFrame, best, rank: int) -> DataFrame:
        return rows.where(F.col("device_id") == device).agg(best.alias("status")).select(
            "status", F.lit(rank).alias("rank")
        )

    known = ranked(history, F.max_by("status", "time"), 1).unionByName(ranked(devices, F.max("status"), 2))
    first = F.min_by("status", F.when(F.col("status").isNotNull(), F.col("rank")))
    return known.agg(F.coalesce(first, F.lit("unknown")).alias("value"))


def recent_events(events: DataFrame, limit: int = 100) -> DataFrame:
    return events.orderBy(F.desc("time"), "offset", "rule_name").limit(limit).select(
        "time", "device_id", "event_type", "severity", "rule_name",
        decimal_round("event_value").alias("event_value"),
        decimal_round("threshold_value").alias("threshold_value"),
        "acknowledged",
    )


def with_all(events: DataFrame, column: str) -> DataFrame:
    """Dropdown values: ALL and every distinct value."""
    everything = events.sparkSession.sql("SELECT 'ALL' AS value")
    return everything.union(events.select(F.col(column).alias("value"))).distinct()


def device_names(readings: DataFrame) -> DataFrame:
    return readings.select("device_id").distinct().orderBy("device_id")


def power_with_markers(readings: DataFrame, events: DataFrame) -> DataFrame:
    """Power series with event markers laid over it."""
    power = readings.select("time", F.lit("power_w").alias("metric"), F.col("power_w").alias("value"))
    marks = events.select(
        "time", F.col("event_type").alias("metric"), F.coalesce("event_value", F.lit(0.0)).alias("value")
    )
    return power.unionByName(marks)


def with_iso_times(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Response form of rows: timestamps as ISO text."""
    return df.withColumns({n: iso(n) for n in names})


# Response fields and time fields of each resource.
RESPONSES = {
    "reading": (("time", "device_id", "voltage_v", "current_a", "power_w", "temperature_c", "sequence_no"), ("time",)),
    "device": (
        ("device_id", "location", "device_type", "firmware_version", "status", "last_seen_at", "created_at", "updated_at"),
        ("last_seen_at", "created_at", "updated_at"),
    ),
    "event": (
        ("event_id", "time", "device_id", "event_type", "severity", "rule_name", "message", "reading_time",
         "event_value", "threshold_value", "metadata", "acknowledged"),
        ("time", "reading_time"),
    ),
    "status": (("time", "device_id", "status", "firmware_version", "ip_address", "rssi_dbm", "metadata"), ("time",)),
}


def response(rows: DataFrame, resource: str) -> DataFrame:
    """Fields of one API resource, times as ISO text."""
    fields, times = RESPONSES[resource]
    return with_iso_times(rows.select(*fields), times)


def acknowledge(events: DataFrame, ids: DataFrame, key: str = "event_id") -> DataFrame:
    """Set the acknowledged flag of the given events; other rows stay as they are."""
    marks = ids.select(F.col(key), F.lit(True).alias("_hit")).distinct()
    return events.join(marks, key, "left").withColumn(
        "acknowledged", F.col("acknowledged") | F.coalesce("_hit", F.lit(False))
    ).drop("_hit").select(*events.columns)
