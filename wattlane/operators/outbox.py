"""Alert outbox as a table state machine: enqueue, claim, settle."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import add_seconds, iso, natural_id
from ..settings import Settings
from . import sequences
from .policy import alertable

_PAYLOAD = ("event_id", "device_id", "event_type", "severity", "time", "message", "value", "threshold")


def payload() -> Column:
    """Alert body as JSON text, nulls kept."""
    fields = {
        "time": iso("time"), "value": F.col("event_value"), "threshold": F.col("threshold_value"),
    }
    return F.to_json(
        F.struct(*[fields.get(n, F.col(n)).alias(n) for n in _PAYLOAD]), {"ignoreNullFields": "false"}
    )


def chat_text() -> Column:
    """Chat message of an alert; the value line only when both numbers are known."""
    head = F.format_string(
        ":rotating_light: *%s* `%s` on `%s`\n%s", "severity", "event_type",
        F.coalesce("device_id", F.lit("unknown")), "message",
    )
    numbers = F.concat(
        F.lit("\nvalue=`"), F.col("event_value").cast("string"),
        F.lit("` threshold=`"), F.col("threshold_value").cast("string"), F.lit("`"),
    )
    tail = F.concat(F.lit("\n_event_id="), F.col("event_id").cast("string"), F.lit(" time="), iso("time"), F.lit("_"))
    return F.concat(head, F.coalesce(numbers, F.lit("")), tail)


def fan_out(events: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """One row per event and channel."""
    return events.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels]).cast("array<string>")))


def due_alerts(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Events that alert: severity policy, then cooldown per device, type and severity."""
    return sequences.cooldown(
        alertable(events, settings), ["device_id", "event_type", "severity"], "time", "offset",
        settings.alert_cooldown_seconds,
    )


def enqueue(outbox: DataFrame, events: DataFrame, now: str, settings: Settings = Settings()) -> DataFrame:
    """New pending outbox rows: due alerts times channels, unless already queued."""
    at = F.lit(now).cast("timestamp")
    empty = F.lit(None)
    rows = fan_out(due_alerts(events, settings), settings.alert_channels).select(
        natural_id("event_id", "channel").alias("outbox_id"),
        "event_id", "channel", payload().alias("payload"), F.lit("pending").alias("status"),
        F.lit(0).alias("attempts"), at.alias("next_attempt_at"), empty.cast("string").alias("last_error"),
        empty.cast("timestamp").alias("locked_at"), empty.cast("timestamp").alias("sent_at"),
        at.alias("created_at"), at.alias("updated_at"),
    )
    return rows.join(outbox.select("event_id", "channel"), ["event_id", "channel"], "left_anti").select(*rows.columns)


def due(outbox: DataFrame, now: str, limit: int = 50, reclaim_after: float | None = None) -> DataFrame:
    """Next rows to deliver, oldest first.

    ``reclaim_after`` seconds also frees rows left locked by a lost worker.
    """
    at = F.lit(now).cast("timestamp")
    waiting = F.col("status").isin("pending", "failed") & (F.col("next_attempt_at") <= at)
    if reclaim_after is not None:
        stuck = (F.col("status") == "processing") & (add_seconds("locked_at", reclaim_after) <= at)
        waiting = waiting | F.coalesce(stuck, F.lit(False))
    return outbox.where(waiting).orderBy("next_attempt_at", "outbox_id").limit(limit)


def claim(outbox: DataFrame, now: str, limit: int = 50, reclaim_after: float | None = None) -> DataFrame:
    """Outbox with the next ``limit`` due rows locked for delivery."""
    at = F.lit(now).cast("timestamp")
    ids = due(outbox, now, limit, reclaim_after).select("outbox_id", F.lit(True).alias("_c"))
    mine = F.col("_c").isNotNull()
    return outbox.join(ids, "outbox_id", "left").withColumns({
        "status": F.when(mine, "processing").otherwise(F.col("status")),
        "locked_at": F.when(mine, at).otherwise(F.col("locked_at")),
        "updated_at": F.when(mine, at).otherwise(F.col("updated_at")),
    }).select(*outbox.columns)


def retry_at(attempts: Column, now: Column, delays: tuple[int, ...]) -> Column:
    steps = F.array(*[F.lit(d) for d in delays])
    return add_seconds(now, F.element_at(steps, F.greatest(F.lit(1), F.least(attempts, F.lit(len(delays))))))


def settle(outbox: DataFrame, results: DataFrame, now: str, settings: Settings = Settings()) -> DataFrame:
    """Outbox after delivery: sent, failed with a later retry, or discarded.

    ``results`` has outbox_id, outcome (ok, error, exception) and response.
    """
    at = F.lit(now).cast("timestamp")
    done = F.col("_o").isNotNull()
    ok = done & (F.col("_o") == "ok")
    bad = done & (F.col("_o") != "ok")
    attempts = F.col("attempts") + 1
    given_up = attempts >= settings.outbox_max_attempts
    error = F.when(F.col("_o") == "exception", F.concat(F.lit("exception: "), F.col("_r"))).otherwise(
        F.coalesce("_r", "_o")
    )
    joined = outbox.join(
        results.select("outbox_id", F.col("outcome").alias("_o"), F.col("response").alias("_r")), "outbox_id", "left"
    )
    return joined.select(
        *[c for c in outbox.columns if c not in _SETTLED],
        F.when(ok, "sent").when(bad & given_up, "discarded").when(bad, "failed")
        .otherwise(F.col("status")).alias("status"),
        F.when(bad, attempts).otherwise(F.col("attempts")).cast("int").alias("attempts"),
        F.when(bad & given_up, at).when(bad, retry_at(attempts, at, settings.retry_delays_seconds))
        .otherwise(F.col("next_attempt_at")).alias("next_attempt_at"),
        F.when(bad, F.substring(error, 1, 1000)).when(ok, F.lit(None)).otherwise(F.col("last_error")).alias("last_error"),
        F.when(done, F.lit(None)).otherwise(F.col("locked_at")).cast("timestamp").alias("locked_at"),
        F.when(ok, at).otherwise(F.col("sent_at")).alias("sent_at"),
        F.when(done, at).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select(*outbox.columns)


_SETTLED = ("status", "attempts", "next_attempt_at", "last_error", "locked_at", "sent_at", "updated_at")


def deliveries(outbox: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """One delivery row per attempt; an exception counts as an error."""
    failed = F.col("outcome") == "exception"
    return results.join(outbox.select("outbox_id", "event_id", "channel", "attempts"), "outbox_id").select(
        natural_id("outbox_id", "attempts").alias("alert_id"), "event_id", "channel",
        F.when(failed, "error").otherwise(F.col("outcome")).alias("status"),
        F.when(failed, F.concat(F.lit("exception: "), F.col("response"))).otherwise(F.col("response")).alias("response"),
        F.lit(now).cast("timestamp").alias("sent_at"),
    )
