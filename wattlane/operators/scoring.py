"""Scored readings as predictions and events."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import Settings
from . import sequences
from .rules import HIT_COLUMNS

# The base features, in model order.
FEATURES = ("voltage_v", "current_a", "power_w", "temperature_c")


def prediction_rows(scored: DataFrame, rule_hits: DataFrame | None = None) -> DataFrame:
    """Prediction table rows of scored readings, with threshold and features as metadata.

    A reading without a score, for want of a feature, gives no row.
    """
    rows = scored.where(F.col("anomaly_score").isNotNull())
    if rule_hits is not None:
        fired = rule_hits.select("offset").distinct().withColumn("_f", F.lit(True))
        rows = rows.join(fired, "offset", "left")
    else:
        rows = rows.withColumn("_f", F.lit(False))
    meta = F.struct(
        "threshold", F.array(*[F.lit(f) for f in FEATURES]).alias("features"),
        F.coalesce("_f", F.lit(False)).alias("rule_triggered"),
    )
    return rows.select(
        "offset", "time", "device_id", "model_version", F.lit("anomaly").alias("prediction_type"),
        "anomaly_score", F.when(F.col("is_anomaly"), "anomaly").otherwise("normal").alias("predicted_label"),
        F.to_json(meta).alias("metadata"),
    )


def model_hits(scored: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Flagged readings in the form of rule hits (no cooldown yet)."""
    return scored.where("is_anomaly").select(
        "offset", "time", "device_id",
        F.lit("ml_isolation_forest").alias("rule_name"),
        F.lit(settings.model_event_type).alias("event_type"),
        F.lit(settings.model_event_severity).alias("severity"),
        F.col("anomaly_score").alias("event_value"), F.col("threshold").alias("threshold_value"),
        F.format_string(
            "ML anomaly score %.4f > %.4f (model=%s)", "anomaly_score", "threshold", "model_version"
        ).alias("message"),
        F.to_json(F.struct(
            F.lit("isolation_forest").alias("detector"), "model_version",
            F.array(*[F.lit(f) for f in FEATURES]).alias("features"),
        )).alias("metadata"),
    ).select(*HIT_COLUMNS)


def model_events(scored: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Model hits after the cooldown per device."""
    return sequences.cooldown(
        model_hits(scored, settings), ["device_id", "event_type"], "time", "offset", settings.alert_cooldown_seconds
    )
