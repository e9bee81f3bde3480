"""Streaming dedup, and the one-minute table as mergeable parts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import _reading_stats

# Messages older than this at arrival are rejected by validation, so state can go after it.
LATENESS = "1 day"
#: Per summed column of a reading, the name of its parts.
SUMMED = {"voltage_v": "voltage", "current_a": "current", "power_w": "power"}


def dedup_stream(readings: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """First arrival per (time, device_id) within the accepted lateness."""
    return readings.withWatermark("time", lateness).dropDuplicatesWithinWatermark(["time", "device_id"])


def minute_rollup_stream(readings: DataFrame, lateness: str | None = LATENESS) -> DataFrame:
    """One row per device and minute; ``lateness`` None if the input already has a watermark."""
    if lateness is not None:
        readings = readings.withWatermark("time", lateness)
    return (
        readings.groupBy(F.window("time", "1 minute").alias("w"), "device_id")
        .agg(*_reading_stats())
        .select(F.col("w.start").alias("bucket"), "device_id", "avg_voltage_v", "avg_current_a", "avg_power_w",
                "max_power_w", "min_voltage_v", "sample_count")
    )


def minute_parts(readings: DataFrame) -> DataFrame:
    """What some readings add to the one-minute table: sums, counts and bounds, which merge.

    Each batch writes the parts of the readings that no earlier batch had, into its own
    folder. Late readings add a part to their old minute, and a batch that runs again
    replaces its parts, so the merged table is the rollup of all readings at any time.
    """
    sums = [a for c, n in SUMMED.items() for a in (F.sum(c).alias(f"{n}_sum"), F.count(c).alias(f"{n}_count"))]
    return readings.groupBy(F.window("time", "1 minute").alias("w"), "device_id").agg(
        *sums, F.max("power_w").alias("max_power_w"), F.min("voltage_v").alias("min_voltage_v"),
        F.count("*").alias("sample_count")).select(F.col("w.start").alias("bucket"), "device_id", *[
            f"{n}_{part}" for n in SUMMED.values() for part in ("sum", "count")], "max_power_w", "min_voltage_v", "sample_count")


def merge_parts(parts: DataFrame) -> DataFrame:
    """Parts of a minute and device as one part."""
    sums = [F.sum(f"{n}_{part}").alias(f"{n}_{part}") for n in SUMMED.values() for part in ("sum", "count")]
    return parts.groupBy("bucket", "device_id").agg(
        *sums, F.max("max_power_w").alias("max_power_w"), F.min("min_voltage_v").alias("min_voltage_v"),
        F.sum("sample_count").alias("sample_count"))


def minute_table(parts: DataFrame) -> DataFrame:
    """The one-minute table from its parts."""
    averages = [F.try_divide(F.col(f"{n}_sum"), F.col(f"{n}_count")).alias(f"avg_{c}") for c, n in SUMMED.items()]
    return merge_parts(parts).select("bucket", "device_id", *averages, "max_power_w", "min_voltage_v", "sample_count")
