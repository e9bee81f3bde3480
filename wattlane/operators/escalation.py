"""Forwarding of scored readings: envelopes, receiver counters, reductions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import iso
from . import sequences

# Fields of one escalated reading, in envelope order.
READING_FIELDS = (
    "device_id", "timestamp", "reading_time", "voltage_v", "current_a", "power_w",
    "temperature_c", "anomaly_score", "threshold", "model_version", "rule_fired",
)
ENVELOPE = (
    "STRUCT<source: STRING, mode: STRING, readings: ARRAY<STRUCT<device_id: STRING, "
    "timestamp: STRING, reading_time: STRING, voltage_v: DOUBLE, current_a: DOUBLE, "
    "power_w: DOUBLE, temperature_c: DOUBLE, anomaly_score: DOUBLE, threshold: DOUBLE, "
    "model_version: STRING, rule_fired: BOOLEAN>>>"
)


def envelopes(
    escalated: DataFrame, keys: Sequence[str], mode: str, *, source: str = "edge-gateway",
    max_rows: int = 64, millis: float = 1000,
) -> DataFrame:
    """JSON envelopes of size- or time-bounded batches per key, with their byte size.

    A batch has at most ``max_rows`` readings, so collecting one is bounded.
    """
    rows = sequences.batches(escalated, keys, "received_at", "offset", max_rows, millis)
    body = rows.withColumns({
        "timestamp": iso("time"), "reading_time": iso("time"),
        **({} if "rule_fired" in rows.columns else {"rule_fired": F.lit(False)}),
    })
    item = F.struct("offset", *READING_FIELDS)
    packed = body.groupBy(*keys, "batch_id").agg(F.array_sort(F.collect_list(item)).alias("r"))
    readings = F.transform("r", lambda r: F.struct(*[r.getField(f).alias(f) for f in READING_FIELDS]))
    text = F.to_json(
        F.struct(F.lit(source).alias("source"), F.lit(mode).alias("mode"), readings.alias("readings")),
        {"ignoreNullFields": "false"},
    )
    return packed.select(
        *keys, "batch_id", F.size("r").alias("readings"), text.alias("body")
    ).withColumn("bytes", F.octet_length("body"))


def receive(bodies: DataFrame) -> DataFrame:
    """Envelope text to one row per reading."""
    parsed = bodies.withColumn("e", F.from_json("body", ENVELOPE))
    return parsed.select(
        *[c for c in bodies.columns if c not in ("body", "readings")],
        F.col("e.source").alias("source"), F.col("e.mode").alias("mode"),
        F.posexplode("e.readings").alias("position", "r"),
    ).select("*", "r.*").drop("r")


def receiver_counters(bodies: DataFrame) -> DataFrame:
    """Batches, readings and bytes received, readings per mode and per device."""
    parsed = bodies.select(F.octet_length("body").alias("n"), F.from_json("body", ENVELOPE).alias("e"))
    totals = parsed.agg(
        F.count("*").alias("b"), F.sum(F.size("e.readings")).cast("long").alias("r"), F.sum("n").cast("long").alias("n")
    ).selectExpr(
        "stack(3, 'escalations.batches', b, 'escalations.readings', r,"
        " 'escalations.bytes_received', n) AS (name, value)"
    )
    modes = parsed.groupBy(F.concat(F.lit("escalations.mode."), F.col("e.mode")).alias("name")).agg(
        F.sum(F.size("e.readings")).cast("long").alias("value")
    )
    devices = parsed.select(F.explode("e.readings").alias("x")).groupBy(
        F.concat(F.lit("escalations.device."), F.col("x.device_id")).alias("name")
    ).agg(F.count("*").alias("value"))
    return totals.unionByName(modes).unionByName(devices)


def arm_totals(batches: DataFrame, mode: str) -> DataFrame:
    """Totals of one forwarding arm."""
    return batches.agg(
        F.lit(mode).alias("mode"), F.count("*").alias("batches"),
        F.coalesce(F.sum("readings"), F.lit(0)).cast("long").alias("readings"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"),
    )


def reduction(arms: DataFrame, smaller: str = "gated", larger: str = "all") -> DataFrame:
    """Both arms on one row with percent saved; null where the larger arm is empty."""
    picked = [
        F.max(F.when(F.col("mode") == m, F.col(c))).alias(f"{c}_{m}")
        for c in ("readings", "bytes") for m in (smaller, larger)
    ]

    def saved(c: str):
        share = F.col(f"{c}_{smaller}") / F.nullif(F.col(f"{c}_{larger}"), F.lit(0))
        return F.round(F.lit(100.0) * (F.lit(1.0) - share), 2).alias(f"{c}_reduction_pct")

    return arms.agg(*picked).select("*", saved("bytes"), saved("readings"))


def verdict_counters(verdicts: DataFrame) -> DataFrame:
    """Windows, scored readings, confirmed, suppressed and mean error of verdicts."""
    windows = verdicts.groupBy("device_id", "window_id").agg(
        F.count("*").alias("n"), F.count_if("confirmed").alias("c"), F.sum("recon_error").alias("e")
    )
    return windows.agg(
        F.count("*").alias("windows"), F.sum("n").alias("scored"), F.sum("c").alias("confirmed"),
        (F.sum("n") - F.sum("c")).alias("suppressed"), (F.sum("e") / F.sum("n")).alias("avg_error"),
    )
