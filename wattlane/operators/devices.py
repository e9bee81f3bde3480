"""Device registry, rule table and references between tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFAULT_DEVICE_STATUS, DEFAULT_DEVICE_TYPE


def upsert_devices(stored: DataFrame, seen: DataFrame, now: str, *, fill_nulls: bool = False) -> DataFrame:
    """Insert devices on first sight; a known device keeps its location and firmware.

    ``seen`` has device_id, firmware_version and offset; the first arrival wins.
    ``fill_nulls`` lets a later firmware replace a stored null.
    """
    firmware = F.min_by("firmware_version", "offset")
    if fill_nulls:
        firmware = F.min_by("firmware_version", F.when(F.col("firmware_version").isNotNull(), F.col("offset")))
    new = seen.groupBy("device_id").agg(firmware.alias("_fw"))
    at = F.lit(now).cast("timestamp")
    known = F.col("_known").isNotNull()
    both = stored.withColumn("_known", F.lit(True)).join(new.withColumn("_new", F.lit(True)), "device_id", "full")
    kept = F.coalesce("firmware_version", "_fw") if fill_nulls else F.col("firmware_version")
    return both.select(
        "device_id", "location",
        F.when(known, F.col("device_type")).otherwise(DEFAULT_DEVICE_TYPE).alias("device_type"),
        F.when(known, kept).otherwise(F.col("_fw")).alias("firmware_version"),
        F.when(known, F.col("status")).otherwise(DEFAULT_DEVICE_STATUS).alias("status"),
        "last_seen_at",
        F.when(known, F.col("created_at")).otherwise(at).alias("created_at"),
        F.when(F.col("_new").isNotNull(), at).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def apply_status(stored: DataFrame, status: DataFrame, now: str) -> DataFrame:
    """Last arrival sets status and last_seen_at; an unknown device is created."""
    last = status.groupBy("device_id").agg(
        F.max_by(F.struct(F.col("status").alias("s"), F.col("time").alias("t")), "offset").alias("_l")
    )
    at = F.lit(now).cast("timestamp")
    both = stored.withColumn("_known", F.lit(True)).join(last, "device_id", "full")
    known, told = F.col("_known").isNotNull(), F.col("_l").isNotNull()
    return both.select(
        "device_id", "location",
        F.when(known, F.col("device_type")).otherwise(DEFAULT_DEVICE_TYPE).alias("device_type"),
        "firmware_version",
        F.coalesce("_l.s", "status").alias("status"),
        F.coalesce("_l.t", "last_seen_at").alias("last_seen_at"),
        F.when(known, F.col("created_at")).otherwise(at).alias("created_at"),
        F.when(told, at).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def upsert_rules(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """Full overwrite per rule_name by its last update (order column ``version``)."""
    fields = ("enabled", "event_type", "severity", "config")
    last = updates.groupBy("rule_name").agg(
        F.max_by(F.struct(*fields), "version").alias("_n")
    )
    both = stored.select("rule_name", *fields).join(last, "rule_name", "full")
    changed = F.col("_n").isNotNull()
    return both.select(
        "rule_name", *[F.when(changed, F.col(f"_n.{f}")).otherwise(F.col(f)).alias(f) for f in fields]
    )


def set_rule_enabled(rules: DataFrame, name: str, enabled: bool) -> DataFrame:
    return rules.withColumn(
        "enabled", F.when(F.col("rule_name") == name, F.lit(enabled)).otherwise(F.col("enabled"))
    )


def known_only(rows: DataFrame, devices: DataFrame) -> DataFrame:
    """Rows that name a known device, or none."""
    return rows.where(F.col("device_id").isNull()).unionByName(
        rows.where(F.col("device_id").isNotNull()).join(devices.select("device_id"), "device_id", "left_semi")
        .select(*rows.columns)
    )


def unknown_only(rows: DataFrame, devices: DataFrame) -> DataFrame:
    """Rows rejected because their device is unknown."""
    return rows.where(F.col("device_id").isNotNull()).join(
        devices.select("device_id"), "device_id", "left_anti"
    ).select(*rows.columns)
