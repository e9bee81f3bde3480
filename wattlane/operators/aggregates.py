"""Dashboard and API aggregates.  All are partial-aggregated before the shuffle."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import MICROS, decimal_round, micros, minutes_between, safe_ratio
from .ordered import exact_quantiles, latest, newest

# Bucket units in seconds, and the origin of weekly buckets (a Monday).
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
WEEK_ORIGIN = 4 * 86400


def in_range(df: DataFrame, start=None, end=None, *, time: str = "time", closed: bool = True) -> DataFrame:
    """Optional time bounds.  List queries include the end, aggregates exclude it."""
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start).cast("timestamp"))
    if end is not None:
        stop = F.lit(end).cast("timestamp")
        df = df.where(F.col(time) <= stop if closed else F.col(time) < stop)
    return df


def bucket(time: str, interval: str) -> Column:
    """Start of the bucket of ``interval`` that holds ``time``."""
    count, unit = interval.split()
    unit = unit.rstrip("s")
    if unit not in UNITS:
        return F.date_trunc(unit, time)
    width = int(count) * UNITS[unit] * MICROS
    origin = WEEK_ORIGIN * MICROS if unit == "week" or width % (UNITS["week"] * MICROS) == 0 else 0
    us = micros(time)
    return F.timestamp_micros(us - F.pmod(us - F.lit(origin), F.lit(width)))


def _reading_stats() -> list[Column]:
    return [
        F.avg("voltage_v").alias("avg_voltage_v"),
        F.avg("current_a").alias("avg_current_a"),
        F.avg("power_w").alias("avg_power_w"),
        F.max("power_w").alias("max_power_w"),
        F.min("voltage_v").alias("min_voltage_v"),
        F.count("*").alias("sample_count"),
    ]


def device_buckets(readings: DataFrame, device: str, start, end, interval: str = "1 minute") -> DataFrame:
    """Bucketed statistics of one device over [start, end)."""
    rows = in_range(readings.where(F.col("device_id") == device), start, end, closed=False)
    return rows.groupBy(bucket("time", interval).alias("bucket")).agg(*_reading_stats()).orderBy("bucket")


def minute_rollup(readings: DataFrame) -> DataFrame:
    """One row per device and minute."""
    return readings.groupBy(bucket("time", "1 minute").alias("bucket"), "device_id").agg(*_reading_stats())


def coarser_rollup(minutes: DataFrame, interval: str) -> DataFrame:
    """Roll minute rows up further; averages are weighted by their counts."""
    def weighted(name: str) -> Column:
        return (F.sum(F.col(name) * F.col("sample_count")) / F.sum("sample_count")).alias(name)

    return minutes.groupBy(bucket("bucket", interval).alias("bucket"), "device_id").agg(
        weighted("avg_voltage_v"), weighted("avg_current_a"), weighted("avg_power_w"),
        F.max("max_power_w").alias("max_power_w"), F.min("min_voltage_v").alias("min_voltage_v"),
        F.sum("sample_count").alias("sample_count"),
    )


def load_per_minute(readings: DataFrame) -> DataFrame:
    return (
        readings.groupBy(bucket("time", "1 minute").alias("time"))
        .agg(F.avg("power_w").alias("avg_power_w")).orderBy("time")
    )


def count_per_minute(events: DataFrame, metric: str) -> DataFrame:
    return (
        events.groupBy(bucket("time", "1 minute").alias("time"), F.col(metric).alias("metric"))
        .agg(F.count("*").alias("value")).orderBy("time")
    )


def count_by(df: DataFrame, key: str, since=None) -> DataFrame:
    return in_range(df, since).groupBy(key).agg(F.count("*").alias("count"))


def quality_summary(quality: DataFrame) -> DataFrame:
    return quality.groupBy("error_type").agg(
        F.count("*").alias("failures"),
        F.countDistinct("device_id").alias("affected_devices"),
        F.max("time").alias("latest_failure"),
    ).orderBy(F.desc("failures"), "error_type")


def event_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", "severity").agg(
        F.count("*").alias("events"),
        F.countDistinct("device_id").alias("affected_devices"),
        F.max("time").alias("latest_event"),
    ).orderBy(F.desc("events"), "severity", "event_type")


def affected_devices(events: DataFrame, limit: int = 20) -> DataFrame:
    return events.groupBy("device_id").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "WARNING").alias("warning"),
        F.max("time").alias("latest_event"),
    ).orderBy(F.desc("events"), F.desc("latest_event"), "device_id").limit(limit)


def most_common_type(events: DataFrame, default: str = "none") -> DataFrame:
    counts = events.groupBy("event_type").agg(F.count("*").alias("n"))
    # Most frequent first; ties go to the smaller name.
    best = F.min_by("event_type", F.struct((-F.col("n")).alias("a"), F.col("event_type").alias("b")))
    return counts.agg(F.coalesce(best, F.lit(default)).alias("value"))


def event_counts(events: DataFrame, device: str) -> DataFrame:
    """Scalar event counts of the stat panels, in one pass."""
    return events.agg(
        F.count("*").alias("events"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "WARNING").alias("warning"),
        F.count_if(~F.col("acknowledged")).alias("unacknowledged"),
        F.count_if(F.col("device_id") == device).alias("of_device"),
    )


def distinct_devices(df: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(count("device_id").alias("devices"))


def average_voltage(readings: DataFrame) -> DataFrame:
    return readings.agg(F.coalesce(decimal_round(F.avg("voltage_v")), F.lit(0.0)).alias("value"))


def age_minutes(df: DataFrame, as_of: str, *, time: str = "time", oldest: bool = False) -> DataFrame:
    """Minutes from the latest (or oldest) row to ``as_of``; 0 for an empty table."""
    edge = F.min(time) if oldest else F.max(time)
    age = minutes_between(F.lit(as_of).cast("timestamp"), edge)
    return df.agg(F.coalesce(decimal_round(age), F.lit(0.0)).alias("value"))


def latest_total_load(readings: DataFrame) -> DataFrame:
    now = readings.groupBy("device_id").agg(F.max_by("power_w", "time").alias("power_w"))
    return now.agg(F.coalesce(decimal_round(F.sum("power_w")), F.lit(0.0)).alias("value"))


def outbox_summary(outbox: DataFrame) -> DataFrame:
    return outbox.groupBy("channel", "status").agg(
        F.count("*").alias("deliveries"), F.max("updated_at").alias("latest_update")
    ).orderBy(F.desc("deliveries"), "channel", "status")


def pending_count(outbox: DataFrame) -> DataFrame:
    return outbox.agg(F.count_if(F.col("status") == "pending").alias("value"))


def pipeline_counters(
    checked: DataFrame, stored: DataFrame, events: DataFrame, *, prefix_types: bool = True
) -> DataFrame:
    """Counter table (name, value) of one run.

    ``checked`` are validated messages, ``stored`` readings with ``copies``,
    ``kept`` and ``store_raw``, ``events`` the created events. Where ``stored`` has
    ``is_new``, only such readings were written; all other kept copies are duplicates.
    """
    written = F.col("is_new") if "is_new" in stored.columns else F.col("store_raw")
    ok = F.col("error_type").isNull()
    kinds = (("telemetry", "telemetry"), ("status", "status"), ("events", "event"))
    parsed = F.coalesce(F.col("error_type") != "invalid_json", F.lit(True))
    totals = {"messages.received": F.count("*"), "validation.failures": F.count_if(~ok)}
    for kind, short in kinds:
        of_kind = F.col("message_type") == kind
        totals[f"validation.{short}.success"] = F.count_if(of_kind & ok)
        totals[f"validation.{short}.failures"] = F.count_if(of_kind & ~ok & parsed)
        totals[f"messages.{kind}"] = F.count_if(of_kind & ok)
    kept = {
        "readings.stored": F.count_if(written),
        "readings.duplicates": F.sum(F.when(F.col("store_raw"), F.col("kept") - written.cast("int")).otherwise(0)),
        "readings.skipped_by_policy": F.sum(F.col("copies") - F.col("kept")),
    }
    by_severity = events.groupBy(F.concat(F.lit("events."), F.lower("severity")).alias("name"))
    by_type = events.groupBy(F.concat(F.lit("events.type."), F.lower("event_type")).alias("name"))
    parts = _long(checked, totals).unionByName(_long(stored, kept))
    for group in (by_severity, by_type):
        parts = parts.unionByName(group.agg(F.count("*").alias("value")))
    return parts.where("value > 0")


def _long(df: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """One aggregate row unpivoted to (name, value)."""
    wide = df.agg(*[c.cast("long").alias(f"c{i}") for i, c in enumerate(totals.values())])
    pairs = ", ".join(f"'{n}', c{i}" for i, n in enumerate(totals))
    return wide.selectExpr(f"stack({len(totals)}, {pairs}) AS (name, value)").selectExpr(
        "name", "coalesce(value, 0) AS value"
    )


def latency_summary(samples: DataFrame, *, keep: int = 10_000, salts: int = 64) -> DataFrame:
    """Count, mean and p50/p95/p99 of the last ``keep`` samples per operation.

    A percentile is the sample at position int((n - 1) * p) of the sorted samples.
    """
    recent = newest(samples, ["operation"], "offset", keep, salts=salts)
    lists = recent.groupBy("operation").agg(
        F.count("*").alias("n"), F.avg("value_ms").alias("avg_ms"),
        F.array_sort(F.collect_list("value_ms")).alias("v"),  # at most ``keep`` values
    )

    def at(p: float, name: str) -> Column:
        return F.element_at("v", (F.floor((F.col("n") - 1) * F.lit(p)) + 1).cast("int")).alias(name)

    return lists.select(
        "operation", F.col("n").alias("count"), "avg_ms", at(0.50, "p50_ms"), at(0.95, "p95_ms"),
        at(0.99, "p99_ms"),
    )


def throughput(counters: DataFrame, seconds: float) -> DataFrame:
    """Messages, readings and events per second of a counter table."""
    span = F.lit(max(float(seconds), 1e-9))
    name, value = F.col("name"), F.col("value")

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, value)), F.lit(0)) / span

    is_event = name.startswith("events.") & ~name.startswith("events.type.")
    return counters.agg(
        total(name == "messages.received").alias("messages_per_second"),
        total(name == "readings.stored").alias("readings_per_second"),
        total(is_event).alias("events_per_second"),
    )


def data_reduction(counters: DataFrame) -> DataFrame:
    """1 - events / stored readings, clamped to [0, 1]; 0 if nothing is stored."""
    stored = F.coalesce(F.sum(F.when(F.col("name") == "readings.stored", F.col("value"))), F.lit(0))
    events = F.coalesce(F.sum(F.when(F.col("name").startswith("events.type."), F.col("value"))), F.lit(0))
    raw = F.lit(1.0) - F.col("total_events") / F.greatest(F.col("raw_readings_stored"), F.lit(1))
    ratio = F.when(F.col("raw_readings_stored") == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    )
    return counters.agg(stored.alias("raw_readings_stored"), events.alias("total_events")).withColumn(
        "data_reduction_ratio", ratio
    )


def prediction_summary(predictions: DataFrame) -> DataFrame:
    label = F.when(F.col("is_anomaly"), "anomaly").otherwise("normal")
    return predictions.groupBy(label.alias("predicted_label")).agg(
        F.count("*").alias("n"),
        F.round(F.avg("anomaly_score"), 4).alias("avg_score"),
        F.round(F.max("anomaly_score"), 4).alias("max_score"),
    )


def run_totals(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of one run by severity or by type and severity, in key order."""
    return events.groupBy(*keys).agg(F.count("*").alias("count")).orderBy(*keys)


def confusion(df: DataFrame, truth: Column, flag: Column) -> DataFrame:
    """Confusion matrix with precision, recall, F1 and false-positive rate (zero-safe)."""
    counts = df.agg(
        F.count_if(truth & flag).alias("tp"), F.count_if(~truth & flag).alias("fp"),
        F.count_if(truth & ~flag).alias("fn"), F.count_if(~truth & ~flag).alias("tn"),
    )
    precision = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    scored = counts.withColumn("precision", precision).withColumn("recall", recall)
    f1 = safe_ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.select(
        "tp", "fp", "fn", "tn",
        F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"),
        F.round(f1, 4).alias("f1"),
        F.round(safe_ratio(F.col("fp"), F.col("tn") + F.col("fp")), 4).alias("false_positive_rate"),
    )


def recall_by_kind(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Share of flagged rows per anomaly kind, for each named flag."""
    return df.where(F.col("kind") != "normal").groupBy("kind").agg(
        F.count("*").alias("count"),
        *[F.round(F.avg(flag.cast("double")), 4).alias(name) for name, flag in flags.items()],
    )


def operating_points(
    scored: DataFrame, quantiles: Sequence[float] = (0.90, 0.95, 0.975, 0.99), *, accuracy: int = 100_000
) -> DataFrame:
    """False-positive rate and recall at score quantiles of the normal rows.

    The few thresholds are read first; then one pass counts all points.
    """
    normal = F.col("kind") == "normal"
    rows = exact_quantiles(scored.where(normal), "anomaly_score", quantiles, accuracy=accuracy).collect()
    cuts = sorted((r["quantile"], r["value"]) for r in rows)
    counts = [F.count_if(normal).alias("normal"), F.count_if(~normal).alias("anomalous")]
    for i, (_, cut) in enumerate(cuts):
        above = F.col("anomaly_score") > F.lit(cut)
        counts += [F.count_if(normal & above).alias(f"f{i}"), F.count_if(~normal & above).alias(f"t{i}")]
    points = ", ".join(f"{q}D, {cut!r}D, f{i}, t{i}" for i, (q, cut) in enumerate(cuts))
    return scored.agg(*counts).selectExpr(
        "normal", "anomalous", f"stack({len(cuts)}, {points}) AS (quantile, threshold, f, t)"
    ).select(
        "quantile", F.round("threshold", 4).alias("threshold"),
        F.round(safe_ratio(F.col("f"), F.col("normal")), 4).alias("fpr"),
        F.round(safe_ratio(F.col("t"), F.col("anomalous")), 4).alias("recall"),
    )


def arm_means(runs: DataFrame, arm: str, arms: Sequence[str], value: str, digits: int = 4) -> DataFrame:
    """Mean of repeated runs per arm, and the second arm minus the first."""
    first, second = arms
    wide = runs.agg(*[F.avg(F.when(F.col(arm) == a, F.col(value))).alias(a) for a in arms])
    return wide.select(
        F.round(first, digits).alias(first), F.round(second, digits).alias(second),
        F.round(F.col(second) - F.col(first), digits).alias("delta"),
    )
