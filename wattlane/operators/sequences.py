"""Sequence operators: cooldown, batches, count windows, heartbeat gaps."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import MICROS, add_seconds, iso, micros
from . import greedy, intervals
from .ordered import HOUR_US, OFFSET_SPAN, keyed_index, neighbour


def cooldown(
    df: DataFrame, keys: Sequence[str], time: str, tie: str, seconds: float, *, fan: int = greedy.FAN
) -> DataFrame:
    """Rows that pass a cooldown: never emitted before, or ``seconds`` since the last emitted.

    Of rows at one instant only the first can pass, so copies are reduced first.
    """
    us = int(seconds * MICROS)
    null_safe = [F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select("*", *null_safe, micros(time).alias("_t"))
    firsts = rows.groupBy(*names, "_t").agg(F.min(tie).alias("_tie"))
    picks = greedy.chains(firsts, names, "_t", us, index="_tie", fan=fan).where("t = pick_t").select(
        *names, F.col("t").alias("_t"), F.col("n").alias(tie)
    )
    return rows.join(picks, [*names, "_t", tie], "left_semi").select(*df.columns)


def batches(
    df: DataFrame, keys: Sequence[str], time: str, seq: str, max_rows: int, millis: float,
    *, fan: int = greedy.FAN, index_span: int = OFFSET_SPAN,
) -> DataFrame:
    """Add ``batch_id``: a batch opens at its first row and closes at ``max_rows`` or ``millis``.

    Rows must arrive in time order per key (``seq`` and ``time`` agree).  The id
    is the position, within the key, of the batch's first row.
    """
    rows = keyed_index(df.withColumn("_t", micros(time)), keys, seq, "_n", span=index_span)
    out = greedy.chains(rows, keys, "_t", int(millis * 1000), index="_n", rows=max_rows, fan=fan)
    ids = out.select(
        *[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)],
        F.col("n").alias("_bn"), F.col("pick_n").alias("batch_id"),
    )
    on = [F.col(k).cast("string").eqNullSafe(F.col(f"_b{i}")) for i, k in enumerate(keys)] + [F.col("_n") == F.col("_bn")]
    return rows.join(ids, on).select(*df.columns, "batch_id")


def count_windows(
    df: DataFrame, keys: Sequence[str], seq: str, size: int = 8, *, span: int = OFFSET_SPAN
) -> DataFrame:
    """Consecutive windows of ``size`` rows per key; an incomplete tail gives nothing."""
    rows = keyed_index(df, keys, seq, "_n", total="_total", span=span)
    return (
        rows.where(F.col("_n") <= F.col("_total") - F.pmod("_total", F.lit(size)))
        .withColumn("window_id", F.floor((F.col("_n") - 1) / size).cast("long"))
        .withColumn("window_pos", ((F.col("_n") - 1) % size).cast("int"))
        .drop("_n", "_total")
    )


def silent_gaps(
    status: DataFrame, as_of: str, timeout_seconds: float = 30, *, slot_us: int = HOUR_US
) -> DataFrame:
    """Times a device could be declared silent: [silent_at, next_seen) after each live status.

    The last status of a device is compared with ``as_of`` (inclusive).
    """
    seen = neighbour(
        status, ["device_id"], "time", "offset", ["time"], backward=False, prefix="next_", slot_us=slot_us
    )
    end = F.lit(as_of).cast("timestamp")
    silent_at = add_seconds("time", timeout_seconds)
    # One microsecond past as_of makes the last, closed interval half open too.
    until = F.coalesce(F.col("next_time"), F.timestamp_micros(micros(end) + 1))
    return (
        seen.where(~F.col("status").isin("offline", "maintenance"))
        .select("device_id", F.col("time").alias("last_seen"), silent_at.alias("silent_at"), until.alias("until"))
        .where(F.col("silent_at") < F.col("until"))
    )


def heartbeat_failures(
    status: DataFrame, as_of: str, timeout_seconds: float = 30, cooldown_seconds: float = 300,
    *, slot_us: int = HOUR_US, fan: int = intervals.FAN,
) -> DataFrame:
    """Offline transitions by silence, at most one per ``cooldown_seconds`` and device.

    A suppressed transition waits: it happens when the cooldown ends, unless the
    device was seen again. Silences are disjoint intervals, whose chain is composed
    block by block (``intervals``).
    """
    gaps = silent_gaps(status, as_of, timeout_seconds, slot_us=slot_us).select(
        "device_id", micros("silent_at").alias("start"), micros("until").alias("until"),
    )
    fired = intervals.firings(gaps, "device_id", int(cooldown_seconds * MICROS), fan=fan).select(
        "device_id", (F.col("start") - F.lit(int(timeout_seconds * MICROS))).alias("last_us"), F.col("at").alias("offline_us"))
    return fired.select(
        "device_id",
        F.timestamp_micros("last_us").alias("last_seen"),
        F.timestamp_micros("offline_us").alias("offline_at"),
        ((F.col("offline_us") - F.col("last_us")) / F.lit(float(MICROS))).alias("age_seconds"),
    )


def heartbeat_events(failures: DataFrame, timeout_seconds: float = 30) -> DataFrame:
    """Offline transitions as CRITICAL events."""
    return failures.select(
        F.xxhash64("device_id", "offline_at", F.lit("device_offline_heartbeat")).alias("event_id"),
        F.col("offline_at").alias("time"), "device_id",
        F.lit("DEVICE_FAILURE").alias("event_type"), F.lit("CRITICAL").alias("severity"),
        F.lit("device_offline_heartbeat").alias("rule_name"),
        F.format_string(
            f"Device %s silent for %.0fs (timeout={int(timeout_seconds)}s)", "device_id", "age_seconds"
        ).alias("message"),
        F.lit(None).cast("timestamp").alias("reading_time"),
        F.lit(None).cast("double").alias("event_value"),
        F.lit(float(timeout_seconds)).alias("threshold_value"),
        F.to_json(F.struct(iso("last_seen").alias("last_seen"), "age_seconds")).alias("metadata"),
        F.lit(False).alias("acknowledged"),
    )


def heartbeat_status_rows(failures: DataFrame) -> DataFrame:
    """Offline transitions as status-history rows."""
    return failures.select(
        F.col("offline_at").alias("time"), "device_id", F.lit("offline").alias("status"),
        F.to_json(F.struct(F.lit("heartbeat_timeout").alias("reason"), iso("last_seen").alias("last_seen"))).alias("metadata"),
    )
