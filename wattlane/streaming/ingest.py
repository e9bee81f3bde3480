"""Continuous ingest: one micro-batch of messages to all tables.

One query reads the messages twice over: as checked messages, and as findings of the device
machine (``machine.py``), whose state Spark keeps. Both meet in each micro-batch, are staged
once in columns, and feed the sinks.

Bad messages are rows of the quality table, never exceptions. What a batch writes depends
only on its input and on earlier batches: history tables have a folder per batch that a rerun
replaces, and state tables one version per batch. So a batch that is run again after a
failure changes nothing.
"""
from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, suppress
from datetime import datetime, timedelta
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.scalar import add_seconds
from ..operators import aggregates, ingest, outbox, policy, rules, scoring, sequences, validate, verifier
from ..operators.forest import Scorer
from ..schemas import DEFAULT_DEVICE_TYPE
from ..session import keep_state_in_rocksdb, use_utc
from ..settings import Settings
from ..sources.models import ModelStore
from ..sources.rules_config import Rule
from ..sources.tables import TableStore
from . import machine
from .rollup import minute_parts

MARKS = "device_id STRING, event_type STRING, time TIMESTAMP"
TOTALS = "name STRING, value BIGINT"
LATENCIES = "operation STRING, batch BIGINT, n BIGINT, value_ms DOUBLE"
#: What a window of readings under way keeps of each, and how many windows a device has had.
OPEN_WINDOW = "device_id STRING, offset BIGINT, time TIMESTAMP, voltage_v DOUBLE, current_a DOUBLE, power_w DOUBLE, temperature_c DOUBLE"
WINDOWS_DONE = "device_id STRING, done BIGINT"
FINDING = "finding"
#: Fewest partitions of the state, and partitions for each core; a stream keeps what it began with.
#: A partition costs about half a second a batch, however few rows it has, so each core has one.
STATE_PARTITIONS, PARTITIONS_PER_CORE = 8, 1
#: The shuffles of a batch's sinks have a partition for each so many messages, and so many at least.
#: Up to 200 partitions each task of a shuffle opens a file for each, however few rows it has.
SINK_ROWS, SINK_PARTITIONS = 50_000, 8
EPOCH = datetime(1970, 1, 1)


def together(checked: DataFrame, findings: DataFrame) -> DataFrame:
    """Checked messages and findings as one stream; ``part`` tells the kinds apart."""
    kind = F.when(F.col("error_type").isNotNull(), "rejected").otherwise(F.col("message_type"))
    own = findings.select(*[F.col(c).alias(f"f_{c}") for c in findings.columns]).withColumn("part", F.lit(FINDING))
    return checked.withColumn("part", kind).unionByName(own, allowMissingColumns=True)


def _us(name: str) -> Column:
    return F.timestamp_micros(name)


class Batch:
    """The parts of one staged micro-batch."""

    def __init__(self, staged: DataFrame) -> None:
        # Each part is a folder: a sink reads only its own.
        self.checked = staged.where(F.col("part") != FINDING).select(*[c for c in staged.columns if not c.startswith("f_") and c != "part"])
        self.findings = staged.where(F.col("part") == FINDING).select(
            *[F.col(c).alias(c[2:]) for c in staged.columns if c.startswith("f_")])
        part = lambda kind: staged.where(F.col("part") == kind)
        self.readings = validate.valid_readings(part("telemetry"))
        self.states = validate.valid_status(part("status"))
        self.reports = validate.valid_device_events(part("events"))
        self.rejected = part("rejected")
        # A row per part and kind of finding: what is empty is not worked on.
        parts = staged.groupBy("part", "f_kind").agg(
            F.count("*").alias("n"), F.max(F.greatest(F.unix_micros("received_at"), "f_at_us")).alias("at")).collect()
        self.counts = {r["f_kind"] or r["part"]: r["n"] for r in parts}
        newest = max((r["at"] for r in parts if r["at"] is not None), default=None)
        # As text in UTC: a collected timestamp would be in the zone of the driver.
        self.at = None if newest is None else f"{EPOCH + timedelta(microseconds=newest):%Y-%m-%d %H:%M:%S.%f}"

    def has(self, *kinds: str) -> bool:
        """Whether the batch has messages or findings of one of the kinds."""
        return any(self.counts.get(k) for k in kinds)

    def found(self, kind: str) -> DataFrame:
        return self.findings.where(F.col("kind") == kind)


def at_once(session: SparkSession, **sinks: Callable[[], object]) -> dict:
    """The results of sinks that don't need each other. Each is a few small jobs, which run side by side.

    All have ended when this returns or raises, so a batch never writes after it has failed.
    """
    with ThreadPoolExecutor(max(1, len(sinks))) as pool:
        running = {name: pool.submit(inheritable_thread_target(session)(sink)) for name, sink in sinks.items()}
    return {name: sink.result() for name, sink in running.items()}


def spike_hits(batch: Batch, rule_list: Sequence[Rule]) -> DataFrame:
    """The machine's spikes as hits, with the texts of their rules."""
    based = batch.found("spike").select("device_id", "offset", _us("ref_us").alias("time"), "value", F.col("base").alias("baseline"), "rule")
    parts = [rules.hits_over_baseline(based.where(F.col("rule") == r.name), r) for r in machine.spike_rules(rule_list)]
    return reduce(DataFrame.unionByName, parts, rules._no_hits(batch.readings))


def silences(batch: Batch) -> DataFrame:
    """Offline transitions of the batch: (device_id, last_seen, offline_at, age_seconds)."""
    return batch.found("offline").select(
        "device_id", _us("ref_us").alias("last_seen"), _us("at_us").alias("offline_at"),
        ((F.col("at_us") - F.col("ref_us")) / F.lit(1e6)).alias("age_seconds"))


def registry_rows(batch: Batch) -> DataFrame:
    """The devices that the batch changed, as rows of the registry's history."""
    last = batch.found("device").groupBy("device_id").agg(
        F.max_by(F.struct("at_us", "ref_us", "first_us", "firmware", "status"), F.struct("at_us", F.col("status") == "offline")).alias("d"))
    return last.select(
        "device_id", F.lit(None).cast("string").alias("location"), F.lit(DEFAULT_DEVICE_TYPE).alias("device_type"),
        F.col("d.firmware").alias("firmware_version"), F.col("d.status").alias("status"), _us("d.ref_us").alias("last_seen_at"),
        _us("d.first_us").alias("created_at"), _us("d.at_us").alias("updated_at"))


def device_table(history: DataFrame) -> DataFrame:
    """The registry: the last row of each device in its history."""
    columns = [c for c in history.columns if c not in ("device_id", "date", "batch")]
    last = history.groupBy("device_id").agg(F.max_by(F.struct(*columns), "batch").alias("d"))
    return last.select("device_id", "d.*")


def cooled(store: TableStore, name: str, candidates: DataFrame, version: int, at: str, seconds: float) -> DataFrame:
    """Candidates (with ``received_at``) that pass the cooldown of their device and type across batches.

    The marks of earlier batches are one row per key, and go when the cooldown has passed.
    """
    keys = ["device_id", "event_type"]
    marks = store.state(name, version, MARKS)
    quiet = marks.withColumnRenamed("time", "_mark")
    open_ = candidates.join(quiet, keys, "left").where(
        F.col("_mark").isNull() | (F.col("received_at") >= add_seconds("_mark", seconds))).select(*candidates.columns)
    passed = store.stage(f"_{name}", version, sequences.cooldown(open_, keys, "received_at", "offset", seconds).withColumn("part", F.lit("all")), "part")
    latest = marks.unionByName(passed.select(*keys, F.col("received_at").alias("time"))).groupBy(*keys).agg(F.max("time").alias("time"))
    store.save_state(name, version, latest.where(F.col("time") > add_seconds(F.lit(at).cast("timestamp"), -seconds)))
    return passed.drop("part")


def model_hits(store: TableStore, batch: Batch, scored: DataFrame, version: int, settings: Settings) -> DataFrame:
    """Hits of the model after their own cooldown, on arrival."""
    came = batch.readings.select(F.col("offset").alias("_o"), "received_at")
    hits = scoring.model_hits(scored, settings).join(came, F.col("offset") == F.col("_o")).drop("_o")
    return cooled(store, "model_marks", hits, version, batch.at, settings.alert_cooldown_seconds).drop("received_at")


def write_readings(store: TableStore, batch: Batch, hits: DataFrame, version: int, settings: Settings) -> DataFrame:
    """Store the readings that the policy keeps and that are new, and their minutes.

    Gives each reading of the batch with ``copies``, ``kept``, ``store_raw`` and ``is_new``.
    """
    created = F.lit(batch.at).cast("timestamp").alias("created_at")
    judged = ingest.stored_readings(batch.readings, hits, settings)
    new = store.unseen("energy_readings", judged.where("store_raw").select("time", "device_id", "offset"), version, among=batch.readings).select(
        F.col("offset").alias("_o"), F.lit(True).alias("is_new"))
    judged = store.stage("_judged", version, judged.join(new, F.col("offset") == F.col("_o"), "left").drop("_o").withColumn(
        "is_new", F.coalesce("is_new", F.lit(False))).withColumn("part", F.lit("all")), "part").drop("part")
    store.append("energy_readings", judged.where("is_new").select(
        "time", "device_id", "voltage_v", "current_a", "power_w", "temperature_c", "sequence_no", "raw_payload", created), version)
    if settings.stores_every_reading:
        first = judged.where("is_new")
    else:
        # The minutes hold all valid readings, so those that are not stored are known by their keys.
        first = store.unseen("reading_keys", judged, version, among=batch.readings)
        store.append("reading_keys", first.select("time", "device_id"), version)
    store.append("energy_readings_1min", minute_parts(first), version)
    return judged


def write_alerts(store: TableStore, batch: Batch, new_events: DataFrame, model: DataFrame, version: int, settings: Settings) -> None:
    """Queue the alerts of new events that pass their cooldown.

    The machine judges all events but the model's, which have passed one of their own.
    """
    alerts = batch.found("alert").select(
        F.col("offset").alias("_o"), F.col("rule").alias("_r"), F.col("device_id").alias("_d"), _us("at_us").alias("_t")).distinct()
    same = (F.col("rule_name") == F.col("_r")) & (F.col("device_id") == F.col("_d")) & F.coalesce(
        F.col("offset") == F.col("_o"), F.col("_o").isNull() & (F.col("time") == F.col("_t")))
    due = new_events.join(alerts, same, "left_semi")
    own = policy.alertable(model, settings).join(new_events.select("event_id"), "event_id", "left_semi")
    now, none = F.lit(batch.at).cast("timestamp"), F.lit(None)
    rows = outbox.fan_out(due.unionByName(own.select(*due.columns)), settings.alert_channels).select(
        F.xxhash64("event_id", "channel").alias("outbox_id"), "event_id", "channel",
        outbox.payload().alias("payload"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"),
        now.alias("next_attempt_at"), none.cast("string").alias("last_error"),
        none.cast("timestamp").alias("locked_at"), none.cast("timestamp").alias("sent_at"),
        now.alias("created_at"), now.alias("updated_at"),
    )
    store.append("alert_outbox", rows, version)


def add_totals(store: TableStore, deltas: DataFrame, version: int) -> DataFrame:
    """Running totals (name, value): those of earlier batches and this one's counts."""
    both = store.state("counter_totals", version, TOTALS).unionByName(deltas.select("name", F.col("value").cast("long").alias("value")))
    store.save_state("counter_totals", version, both.groupBy("name").agg(F.sum("value").alias("value")).coalesce(1))
    return store.state("counter_totals", version + 1, TOTALS)


def add_latencies(store: TableStore, timed: Sequence[tuple[str, int, float]], version: int, keep: int) -> DataFrame:
    """Latency statistics per operation over the last ``keep`` samples.

    A batch gives each of its ``n`` rows its share of the time taken. The state holds
    (operation, batch, n, ms), cut to the batches that the last ``keep`` samples reach into.
    """
    rows = [(op, version, n, 1000.0 * seconds / n) for op, n, seconds in timed if n > 0]
    runs = store.state("latency_samples", version, LATENCIES).unionByName(store.spark.createDataFrame(rows, LATENCIES))
    newer = Window.partitionBy("operation").orderBy(F.desc("batch")).rowsBetween(Window.unboundedPreceding, -1)
    kept = runs.withColumn("_before", F.coalesce(F.sum("n").over(newer), F.lit(0))).where(F.col("_before") < keep).withColumn(
        "n", F.least("n", F.lit(keep) - F.col("_before"))).drop("_before")
    store.save_state("latency_samples", version, kept.coalesce(1))
    held = store.state("latency_samples", version + 1, LATENCIES)
    samples = held.select("operation", F.col("batch").alias("offset"), "value_ms", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return aggregates.latency_summary(samples.drop("col"), keep=keep)


def write_verdicts(store: TableStore, escalated: DataFrame, model: verifier.Verifier, version: int) -> None:
    """Verdicts of the windows that the batch completes; the rest waits for later batches.

    All complete windows of the batch, of whatever device, are scored together.
    """
    fields = [c.split()[0] for c in OPEN_WINDOW.split(", ")]
    waiting = store.state("open_windows", version, OPEN_WINDOW).unionByName(escalated.select(*fields))
    rows = store.stage("_windows", version, waiting.withColumn("part", F.lit("all")), "part").drop("part")
    # The windows are counted once, for all three sinks.
    whole = store.stage("_numbered", version, sequences.count_windows(rows, ["device_id"], "offset", model.window).withColumn(
        "part", F.lit("all")), "part").drop("part")
    before = store.state("windows_done", version, WINDOWS_DONE)
    times = rows.select(F.col("offset").alias("_o"), "time")
    found = verifier.verdicts_of(whole, model).join(before, "device_id", "left").join(times, F.col("offset") == F.col("_o"))
    scored = found.select(
        "time", "device_id", (F.col("window_id") + F.coalesce("done", F.lit(0))).alias("window_id"), "offset",
        "recon_error", "threshold", "confirmed")
    open_ = rows.join(whole.select("offset"), "offset", "left_anti").select(*fields)
    closed = whole.groupBy("device_id").agg(F.countDistinct("window_id").alias("done"))
    done = before.unionByName(closed).groupBy("device_id").agg(F.sum("done").alias("done"))
    at_once(store.spark, verdicts=lambda: store.append("verdicts", scored, version),
            open_windows=lambda: store.save_state("open_windows", version, open_),
            windows_done=lambda: store.save_state("windows_done", version, done))


def process_batch(
    store: TableStore, messages: DataFrame, version: int, rule_list: Sequence[Rule], settings: Settings = Settings(),
    scorer: Scorer | None = None, window_model: verifier.Verifier | None = None,
) -> None:
    """All sinks of one micro-batch of checked messages and findings (``together``)."""
    began = time.monotonic()
    staged = store.stage("_batch", version, messages, "part")
    with at_most_partitions(store.spark, SINK_PARTITIONS):
        batch = Batch(staged)
    if batch.at is None:
        return
    with at_most_partitions(store.spark, sink_partitions(batch)):
        _process(store, batch, version, rule_list, settings, scorer, window_model, began)


def sink_partitions(batch: Batch) -> int:
    return max(SINK_PARTITIONS, -(-sum(batch.counts.values()) // SINK_ROWS))


def _process(
    store: TableStore, batch: Batch, version: int, rule_list: Sequence[Rule], settings: Settings,
    scorer: Scorer | None, window_model: verifier.Verifier | None, began: float,
) -> None:
    created = F.lit(batch.at).cast("timestamp")
    proposed = settings.processing_mode == "proposed"
    staged = time.monotonic()

    no_hits = rules._no_hits(batch.readings)
    hits = rules.threshold_hits(batch.readings, rule_list if proposed else [])
    if proposed and batch.has("spike"):
        hits = hits.unionByName(spike_hits(batch, rule_list))
    fired = no_hits if settings.detection_mode == "ml" else hits
    gone = silences(batch)
    sinks, timed = {}, []
    if scorer is not None and proposed and settings.detection_mode != "rules" and batch.has("telemetry"):
        scored = store.stage("_scored", version, scorer.score(batch.readings).withColumn("part", F.lit("all")), "part").drop("part")
        timed.append(("ml_inference", batch.counts["telemetry"], time.monotonic() - staged))
        sinks["found"] = lambda: model_hits(store, batch, scored, version, settings)
        predictions = scoring.prediction_rows(scored, hits).withColumn("created_at", created)
        predictions = predictions.dropDuplicates(["time", "device_id", "model_version", "prediction_type"]).drop("offset")
        sinks["predictions"] = lambda: store.append_new("model_predictions", predictions, batch=version, among=batch.readings)
        escalated = policy.escalation_gate(scored, settings.escalation_mode, settings.escalation_threshold)
        if window_model is not None and settings.escalation_mode != "off":
            sinks["verdicts"] = lambda: write_verdicts(store, escalated, window_model, version)
    if batch.has("telemetry") and not settings.ml_inline:
        sinks["judged"] = lambda: write_readings(store, batch, fired, version, settings)
    if batch.has("device"):
        sinks["devices"] = lambda: store.append("devices", registry_rows(batch), version)
    if batch.has("rejected"):
        bad = validate.quality_rows(batch.rejected).drop("offset")
        sinks["rejected"] = lambda: store.append_new("data_quality_logs", bad, batch=version)
    if batch.has("status", "offline"):
        told = ingest.status_history(batch.states)
        lost = sequences.heartbeat_status_rows(gone).withColumn("id", F.xxhash64("device_id", "time", F.lit("heartbeat")))
        history = told.unionByName(lost, allowMissingColumns=True).withColumn("created_at", created)
        sinks["status"] = lambda: store.append_new("device_status_history", history, batch=version)
    done = at_once(store.spark, **sinks)
    found = done.get("found", no_hits)

    # What the model found belongs to the events and, if it counts for the policy, to the readings.
    sinks = {}
    if batch.has("telemetry") and settings.ml_inline:
        sinks["judged"] = lambda: write_readings(store, batch, fired.unionByName(found), version, settings)
    by_model = rules.to_events(found)
    events = rules.to_events(fired).unionByName(by_model)
    if batch.has("status"):
        events = events.unionByName(ingest.offline_events(batch.states, settings))
    if batch.has("events"):
        reported = ingest.reported_events(batch.reports).join(batch.found("unknown").select("offset"), "offset", "left_anti")
        events = events.unionByName(reported.select(*by_model.columns))
    if batch.has("offline"):
        failures = sequences.heartbeat_events(gone, settings.heartbeat_timeout_seconds)
        events = events.unionByName(failures.withColumn("offset", F.lit(None).cast("long")))
    if batch.has("telemetry", "status", "events", "offline"):
        all_events = events.withColumn("part", F.lit("all"))
        sinks["events"] = lambda: store.stage("_events", version, all_events, "part").drop("part")
    done |= at_once(store.spark, **sinks)

    sinks = {}
    if "events" in done:
        events = done["events"]
        new_events = store.unseen("events", events, version)
        sinks["events"] = lambda: store.append("events", new_events.withColumn("created_at", created).drop("offset"), version)
        sinks["alerts"] = lambda: write_alerts(store, batch, new_events, by_model, version, settings)
    none = batch.readings.select(F.lit(0).alias("copies"), F.lit(0).alias("kept"), F.lit(False).alias("store_raw"), F.lit(False).alias("is_new"))
    counters = aggregates.pipeline_counters(batch.checked, done.get("judged", none), events).where("value > 0")
    if batch.has("offline"):
        counters = counters.unionByName(gone.agg(F.count("*").alias("value")).select(F.lit("devices.offline_detected").alias("name"), "value"))
    sinks["totals"] = lambda: add_totals(store, counters, version)
    totals = at_once(store.spark, **sinks)["totals"]
    spent = time.monotonic() - began
    kinds = [k for k in ("telemetry", "status", "events") if batch.has(k)]
    whole = sum(batch.counts[k] for k in kinds)
    timed += [(k, batch.counts[k], spent * batch.counts[k] / whole) for k in kinds]
    latencies = add_latencies(store, timed, version, settings.metrics_latency_samples)
    store.append("system_metrics", ingest.metric_rows(totals, latencies, batch.at).withColumn("created_at", created), version)
    for name in ("_batch", "_judged", "_events", "_scored", "_windows", "_numbered", "_model_marks"):
        store.unstage(name, version)


@contextmanager
def at_most_partitions(session: SparkSession, n: int) -> Iterator[None]:
    """A stream that starts here and queries that run here have the session's settings, with at most ``n`` shuffle partitions."""
    key = "spark.sql.shuffle.partitions"
    before = session.conf.get(key)
    session.conf.set(key, str(min(n, int(before))))
    try:
        yield
    finally:
        session.conf.set(key, before)


def session_like(session: SparkSession) -> SparkSession:
    """A session with the settings of another, which can change without it."""
    own = session.newSession()
    for key, value in session.conf.getAll.items():
        if own.conf.get(key, None) != value:
            with suppress(AnalysisException):  # static, so the same for all
                own.conf.set(key, value)
    return own


def start_ingest(
    messages: DataFrame,
    base: str,
    checkpoint: str,
    rules_of: Callable[[], Sequence[Rule]],
    settings: Settings = Settings(),
    *,
    trigger: dict | None = None,
    lag: str = "5 seconds",
    window_model: verifier.Verifier | None = None,
    changed: threading.Event | None = None,
) -> StreamingQuery:
    """Run the ingest on a message stream.

    The rules are those of ``rules_of`` at the start. With ``changed``, it is asked again
    before each batch; where the rules differ the event is set and the query ends before it
    touches the batch (see ``run_ingest``). The newest model of the store's ``models`` folder
    scores each batch.
    """
    session: SparkSession = messages.sparkSession
    keep_state_in_rocksdb(use_utc(session))
    partitions = max(STATE_PARTITIONS, PARTITIONS_PER_CORE * session.sparkContext.defaultParallelism)
    rule_list = list(rules_of())
    checked = validate.validate_messages(validate.route(messages), settings)
    findings = machine.device_findings(checked, rule_list, settings, lag)
    models: list[ModelStore] = []
    sinks = session_like(session)

    def each(batch: DataFrame, batch_id: int) -> None:
        if changed is not None and list(rules_of()) != rule_list:
            changed.set()
            raise RulesChanged
        # The stream's own session has no adaptive execution: all 200 or so partitions of the state
        # would be tasks and files of each sink's small jobs. What is staged is read in one like the caller's.
        store = TableStore(sinks, base)
        if not models:
            models.append(ModelStore(store))
        process_batch(store, batch, batch_id + 1, rule_list, settings, models[0].newest(), window_model)

    with at_most_partitions(session, partitions):
        return (
            together(checked, findings).writeStream.foreachBatch(each)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


class RulesChanged(Exception):
    """The query has to start anew with other rules."""


def run_ingest(messages: DataFrame, base: str, checkpoint: str, rules_of: Callable[[], Sequence[Rule]], settings: Settings = Settings(),
               **options) -> None:
    """Run the ingest until it ends, starting it anew from its checkpoint whenever the rules change."""
    while True:
        changed = threading.Event()
        try:
            start_ingest(messages, base, checkpoint, rules_of, settings, changed=changed, **options).awaitTermination()
            return
        except StreamingQueryException:
            if not changed.is_set():
                raise
