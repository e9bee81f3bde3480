"""Storage, retention, escalation and alert policies."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import add_seconds
from ..settings import Settings


def storage_decision(readings: DataFrame, settings: Settings, trigger: str = "event_triggering") -> DataFrame:
    """Add store_raw and reason for the configured mode and policy."""
    fired = F.col(trigger)
    if settings.processing_mode == "baseline":
        keep, reason = F.lit(True), F.lit("baseline_forces_raw")
    elif settings.storage_policy == "raw":
        keep, reason = F.lit(True), F.lit("policy_raw")
    elif settings.storage_policy == "hybrid":
        keep = fired | F.lit(settings.store_raw_readings)
        reason = F.when(keep, "policy_hybrid_store").otherwise("policy_hybrid_skip")
    elif settings.storage_policy == "event_only":
        keep = fired
        reason = F.when(fired, "policy_event_only_event").otherwise("policy_event_only_skip")
    else:
        keep, reason = F.lit(False), F.lit("policy_aggregate_only_skip")
    return readings.withColumn("store_raw", keep).withColumn("reason", reason)


def mark_triggering(readings: DataFrame, hits: DataFrame) -> DataFrame:
    """Flag readings that caused at least one hit (one row per offset on both sides)."""
    fired = hits.select("offset").distinct().withColumn("_f", F.lit(True))
    return readings.join(fired, "offset", "left").withColumn(
        "event_triggering", F.coalesce("_f", F.lit(False))
    ).drop("_f")


def retained_bytes(readings: DataFrame, payload: str, policies: dict[str, Settings]) -> DataFrame:
    """Rows and payload bytes each policy would keep, in one pass."""
    size = F.octet_length(F.col(payload))
    aggs, parts = [], []
    for i, (name, settings) in enumerate(policies.items()):
        readings = storage_decision(readings, settings).withColumnRenamed("store_raw", f"_k{i}")
        aggs += [F.count_if(f"_k{i}").alias(f"n{i}"),
                 F.sum(F.when(F.col(f"_k{i}"), size).otherwise(0)).alias(f"b{i}")]
        parts.append(f"'{name}', n{i}, b{i}")
    return readings.agg(*aggs).selectExpr(f"stack({len(parts)}, {', '.join(parts)}) AS (policy, readings, bytes)")


def expired(as_of: str, days: float, time: str = "time", only_status: tuple[str, ...] = ()) -> Column:
    """Condition of rows older than ``days``; with ``only_status``, only in one of these states."""
    cutoff = add_seconds(F.lit(as_of).cast("timestamp"), -days * 86400)
    old = F.coalesce(F.col(time) < cutoff, F.lit(False))
    if only_status:
        old = old & F.coalesce(F.col("status").isin(*only_status), F.lit(False))
    return old


def retain(df: DataFrame, as_of: str, days: float, *, time: str = "time", only_status: tuple[str, ...] = ()) -> DataFrame:
    """Rows that stay after pruning; ``days`` <= 0 keeps all."""
    return df if days <= 0 else df.where(~expired(as_of, days, time, only_status))


def retain_outbox(outbox: DataFrame, as_of: str, days: float) -> DataFrame:
    return retain(outbox, as_of, days, time="created_at", only_status=("sent", "discarded"))


def escalation_gate(scored: DataFrame, mode: str, threshold: float | None = None) -> DataFrame:
    """Scored readings to forward: all, those flagged, or those at an own threshold."""
    if mode == "all":
        return scored
    if mode == "off":
        return scored.where(F.lit(False))
    if mode != "gated":
        raise ValueError(f"unknown escalation mode {mode!r}")
    if threshold is not None:
        return scored.where(F.col("anomaly_score") >= F.lit(float(threshold)))
    return scored.where("is_anomaly")


def alertable(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Events whose severity may alert at all."""
    if not settings.alerts_enabled:
        return events.where(F.lit(False))
    return events.where(F.col("severity") == "CRITICAL") if settings.alert_critical_only else events
