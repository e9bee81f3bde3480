"""Threshold and rolling-spike rules over readings, and rule hits as events."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import COMPARISONS, MICROS, compare, micros, natural_id, percent_change, slot
from ..sources.rules_config import Rule

# Numeric columns of a reading that rules may read.
NUMERIC_FIELDS = ("voltage_v", "current_a", "power_w", "temperature_c", "sequence_no")
# Columns every hit carries.
HIT_COLUMNS = (
    "offset", "time", "device_id", "rule_name", "event_type", "severity",
    "event_value", "threshold_value", "message", "metadata",
)


def _threshold_hit(rule: Rule) -> Column | None:
    """Struct of one rule's hit, null where the rule does not fire."""
    if not rule.field or rule.operator not in COMPARISONS or rule.value is None:
        return None
    actual = F.col(rule.field).cast("double")
    hit = F.struct(
        F.lit(rule.name).alias("rule_name"),
        F.lit(rule.event_type).alias("event_type"),
        F.lit(rule.severity).alias("severity"),
        actual.alias("event_value"),
        F.lit(rule.value).alias("threshold_value"),
        F.concat(
            F.lit(f"{rule.field}="), actual.cast("string"),
            F.lit(f" {rule.operator} {rule.value_text} (rule={rule.name})"),
        ).alias("message"),
        F.to_json(
            F.struct(F.lit(rule.field).alias("field"), F.lit(rule.operator).alias("operator"))
        ).alias("metadata"),
    )
    return F.when(compare(actual, rule.operator, rule.value), hit)


def threshold_array(rules: Sequence[Rule], known: set[str]) -> Column | None:
    """The hits of all enabled threshold rules on a row as one array; None without such rules."""
    structs = [
        h for r in rules
        if r.enabled and r.type == "threshold" and r.field in known
        and (h := _threshold_hit(r)) is not None
    ]
    return F.filter(F.array(*structs), lambda h: h.isNotNull()) if structs else None


def threshold_hits(readings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All enabled threshold rules in one pass: one array of hits per row, exploded."""
    fired = threshold_array(rules, set(readings.columns))
    if fired is None:
        return _no_hits(readings)
    return (
        readings.select("offset", "time", "device_id", F.explode(fired).alias("h"))
        .select("offset", "time", "device_id", "h.*")
        .select(*HIT_COLUMNS)
    )


def _no_hits(readings: DataFrame) -> DataFrame:
    texts = ("rule_name", "event_type", "severity", "message", "metadata")
    return readings.where(F.lit(False)).select(
        "offset", "time", "device_id",
        *[F.lit(None).cast("string").alias(c) for c in texts],
        *[F.lit(None).cast("double").alias(c) for c in ("event_value", "threshold_value")],
    ).select(*HIT_COLUMNS)


def complete_spike(rule: Rule) -> bool:
    """Whether a rule is an enabled spike rule with all it needs; others are ignored."""
    return bool(rule.enabled and rule.type == "percentage_increase" and rule.field) and (
        rule.percent is not None and rule.window_seconds is not None and rule.window_seconds >= 0)


def spike_baseline(
    readings: DataFrame,
    field: str,
    window_seconds: float,
    *,
    clock: str = "received_at",
    resets: DataFrame | None = None,
) -> DataFrame:
    """Each reading with the oldest sample of its device in the last ``window_seconds``.

    Samples sit at their own time, probes at the start of their window, both in
    slots one window wide.  Read from late to early, the last sample seen before
    a probe is its baseline; when the slot has none, it is the first sample of
    the next slot, added as one extra row per slot.  A group is one device for
    one window length, the scan is linear, and each row is shuffled twice.

    ``resets`` (device_id, reset_at) are instants that clear a device's samples.
    """
    width = max(1, int(window_seconds * MICROS))  # a window of 0 s holds rows of one instant
    rows = readings.where(F.col(field).isNotNull()).select(
        "device_id", "offset", "time",
        micros(clock).alias("t"), F.col(field).cast("double").alias("x"),
    )
    rows = rows.withColumn("probe", F.col("t") - F.lit(width))
    if resets is not None:
        rows = _clear_before(rows, resets, width)
    null_long = F.lit(None).cast("long")
    sample = F.struct(
        slot(F.col("t"), width).alias("slot"), F.col("t").alias("pos"), F.lit(0).alias("kind"),
        F.col("offset").alias("s_offset"), F.col("x").alias("s_x"),
    )
    probe = F.struct(
        slot(F.col("probe"), width).alias("slot"), F.col("probe").alias("pos"), F.lit(1).alias("kind"),
        null_long.alias("s_offset"), F.lit(None).cast("double").alias("s_x"),
    )
    placed = rows.select(
        "device_id", F.explode(F.array(sample, probe)).alias("p"), "offset", "time", "x"
    ).select("device_id", "p.*", "offset", "time", "x")
    heads = (
        rows.groupBy("device_id", slot(F.col("t"), width).alias("slot"))
        .agg(F.min(F.struct("t", "offset", "x")).alias("h"))
        .select(
            "device_id", (F.col("slot") - 1).alias("slot"), F.col("h.t").alias("pos"),
            F.lit(0).alias("kind"), F.col("h.offset").alias("s_offset"), F.col("h.x").alias("s_x"),
            null_long.alias("offset"), F.lit(None).cast("timestamp").alias("time"),
            F.lit(None).cast("double").alias("x"),
        )
    )
    late_first = Window.partitionBy("device_id", "slot").orderBy(
        F.col("pos").desc(), F.col("kind").asc(), F.col("s_offset").desc()
    ).rowsBetween(Window.unboundedPreceding, 0)
    base = F.last(
        F.when(F.col("kind") == 0, F.struct("s_offset", "s_x")), ignorenulls=True
    ).over(late_first)
    return (
        placed.unionByName(heads)
        .withColumn("b", base)
        .where(F.col("kind") == 1)
        .select(
            "device_id", "offset", "time", F.col("x").alias("value"),
            F.when(F.col("b.s_offset") != F.col("offset"), F.col("b.s_x")).alias("baseline"),
        )
    )


def _clear_before(rows: DataFrame, resets: DataFrame, width: int) -> DataFrame:
    """Move a probe up to the last reset inside its window."""
    marks = (
        resets.select("device_id", micros("reset_at").alias("r"))
        .distinct()
        .select("device_id", "r", F.explode(F.array(F.lit(0), F.lit(1))).alias("d"))
        .groupBy("device_id", (slot(F.col("r"), width) + F.col("d")).alias("slot"))
        .agg(F.collect_list("r").alias("marks"))  # resets are a cooldown apart: few per slot
    )
    last_mark = F.array_max(
        F.filter("marks", lambda r: (r <= F.col("t")) & (r > F.col("probe")))
    )
    return (
        rows.withColumn("slot", slot(F.col("t"), width))
        .join(marks, ["device_id", "slot"], "left")
        .withColumn("probe", F.coalesce(last_mark, F.col("probe")))
        .drop("slot", "marks")
    )


def spike_hits(
    readings: DataFrame, rule: Rule, *, clock: str = "received_at", resets: DataFrame | None = None
) -> DataFrame:
    return hits_over_baseline(spike_baseline(readings, rule.field, rule.window_seconds, clock=clock, resets=resets), rule)


def hits_over_baseline(based: DataFrame, rule: Rule) -> DataFrame:
    """Hits among (device_id, offset, time, value, baseline)."""
    seconds = f"{rule.window_seconds:g}"
    change = percent_change(F.col("value"), F.col("baseline"))
    return (
        based.where(F.col("baseline") > 0)
        .withColumn("change", change)
        .where(F.col("change") >= F.lit(float(rule.percent)))
        .select(
            "offset", "time", "device_id",
            F.lit(rule.name).alias("rule_name"),
            F.lit(rule.event_type).alias("event_type"),
            F.lit(rule.severity).alias("severity"),
            F.col("value").alias("event_value"),
            F.lit(float(rule.percent)).alias("threshold_value"),
            F.format_string(
                f"{rule.field} jumped %.1f%% in {seconds}s (rule={rule.name})", "change"
            ).alias("message"),
            F.to_json(
                F.struct(
                    F.lit(rule.field).alias("field"),
                    F.lit(int(rule.window_seconds)).alias("window_seconds"),
                    F.round("change", 2).alias("percent_change"),
                    F.col("baseline").alias("baseline"),
                )
            ).alias("metadata"),
        )
        .select(*HIT_COLUMNS)
    )


def evaluate(
    readings: DataFrame,
    rules: Sequence[Rule],
    *,
    clock: str = "received_at",
    resets: DataFrame | None = None,
) -> DataFrame:
    """Hits of every enabled rule on every reading; no cooldown is applied here."""
    parts = [threshold_hits(readings, rules)]
    parts += [
        spike_hits(readings, r, clock=clock, resets=resets)
        for r in rules
        if complete_spike(r) and r.field in readings.columns
    ]
    return reduce(DataFrame.unionByName, parts)


def to_events(hits: DataFrame) -> DataFrame:
    """Stored event rows; the id is a hash of the natural key, so replays agree."""
    return hits.select(
        natural_id("device_id", "time", "rule_name", "offset").alias("event_id"),
        "time", "device_id", "event_type", "severity", "rule_name", "message",
        F.col("time").alias("reading_time"), "event_value", "threshold_value", "metadata",
        F.lit(False).alias("acknowledged"), "offset",
    )
