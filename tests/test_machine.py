"""The device machine on a stream of four files against the batch operators."""
from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattlane.operators import rules, sequences
from wattlane.settings import Settings
from wattlane.sources.rules_config import Rule
from wattlane.streaming import machine

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
CHECKED = (
    "offset long, received_at timestamp, time timestamp, device_id string, message_type string, error_type string, "
    "status string, firmware_version string, event_type string, severity string, "
    "voltage_v double, current_a double, power_w double, temperature_c double, sequence_no long"
)
SPIKE = Rule("jump", True, "POWER_SPIKE", "CRITICAL", "percentage_increase", "power_w", percent=40.0, window_seconds=60)
LOW = Rule("low", True, "LOW_VOLTAGE", "CRITICAL", "threshold", "voltage_v", "lt", 200.0, "200.0")


def _row(offset, at, device, kind, status=None, firmware=None, event=None, severity=None, power=None, volts=None):
    t = T0 + timedelta(microseconds=at)
    return (offset, t, t, device, kind, None, status, firmware, event, severity, volts, None, power, None, None)


def _messages(seed=3, n=1_500):
    rng = random.Random(seed)
    at, out = 0, []
    for i in range(n):
        at += rng.choice([100_000, 1_000_000, 5_000_000]) if rng.random() < 0.98 else 90_000_000
        device = rng.choice(["a", "a", "b", "c"])
        pick = rng.random()
        if pick < 0.05:
            out.append(_row(i, at, device, "status", rng.choice(["online"] * 4 + ["offline", "maintenance", "error"]), f"fw{i % 3}"))
        elif pick < 0.1:
            out.append(_row(i, at, device, "events", event="DOOR", severity=rng.choice(["CRITICAL", "INFO"])))
        else:
            out.append(_row(i, at, device, "telemetry", power=rng.choice([None, 80.0, 100.0, 120.0, 150.0]), volts=rng.choice([190.0, 220.0, 230.0]), firmware="r"))
    # Rows long after all others, each a file of its own, move the watermark past every deadline.
    return out + [_row(n + i, at + (i + 1) * 10**10, "zz", "telemetry", power=1.0, volts=220.0) for i in range(3)]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    def make(rows, rule_list=(SPIKE, LOW), settings=Settings(), files=4, name="found", lag="0 seconds"):
        folder, ck = str(tmp_path_factory.mktemp("in")), str(tmp_path_factory.mktemp("ck"))
        table = spark.createDataFrame(rows, CHECKED)
        parts = table.withColumn("_p", F.ntile(files).over(Window.orderBy("offset")))
        parts = parts.withColumn("_p", F.when(F.col("device_id") == "zz", F.lit(files) + F.col("offset")).otherwise(F.col("_p")))
        for p in sorted(r._p for r in parts.select("_p").distinct().collect()):
            parts.where(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        q = machine.device_findings(stream, list(rule_list), settings, lag).writeStream.format("memory").queryName(name).option(
            "checkpointLocation", ck).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name).cache(), table, ck

    return make


@pytest.fixture(scope="module")
def replayed(run):
    return run(_messages())


def _failures(table):
    as_of = str(table.agg(F.max("received_at") - F.expr("interval 1 second")).first()[0])
    return sequences.heartbeat_failures(table.where("message_type = 'status'"), as_of)


def _rows(df, *columns):
    return sorted(tuple(map(str, r)) for r in df.select(*columns).collect())


def test_offline_transitions(replayed):
    found, table, _ = replayed
    got = found.where("kind = 'offline'").select("device_id", F.timestamp_micros("ref_us").alias("last_seen"), F.timestamp_micros("at_us").alias("offline_at"))
    want = _failures(table)
    assert got.count() > 5 and _rows(got, *got.columns) == _rows(want, *got.columns)


def test_spikes_with_samples_cleared_by_silence(replayed):
    found, table, _ = replayed
    resets = _failures(table).select("device_id", F.col("offline_at").alias("reset_at"))
    readings = table.where("message_type = 'telemetry'")
    want = rules.spike_hits(readings, SPIKE, resets=resets)
    got = found.where("kind = 'spike'")
    assert got.count() > 30 and _rows(got, "device_id", "offset", "value") == _rows(want, "device_id", "offset", "event_value")
    assert want.count() != rules.spike_hits(readings, SPIKE).count()


def test_alerts(replayed):
    found, table, _ = replayed
    status = table.where("message_type = 'status'")
    known = table.where("message_type <> 'events'").groupBy("device_id").agg(F.min("offset").alias("first"))
    reports = table.where("message_type = 'events' AND severity = 'CRITICAL'").join(known, "device_id").where("offset > first")
    readings = table.where("message_type = 'telemetry'")
    resets = _failures(table)
    hits = rules.evaluate(readings, [SPIKE, LOW], resets=resets.select("device_id", F.col("offline_at").alias("reset_at")))
    event = lambda df, kind, time: df.select("device_id", F.lit(kind).alias("event_type"), F.col(time).alias("time"), F.monotonically_increasing_id().alias("tie"))
    events = event(hits.where("event_type = 'POWER_SPIKE'"), "POWER_SPIKE", "time").unionByName(
        event(hits.where("event_type = 'LOW_VOLTAGE'"), "LOW_VOLTAGE", "time")).unionByName(event(reports, "DOOR", "time")).unionByName(
        event(status.where("status = 'offline'"), "DEVICE_FAILURE", "time")).unionByName(event(resets, "DEVICE_FAILURE", "offline_at"))
    want = sequences.cooldown(events, ["device_id", "event_type"], "time", "tie", 300)
    names = F.create_map(*[F.lit(x) for x in ("jump", "POWER_SPIKE", "low", "LOW_VOLTAGE", "device_event", "DOOR",
                                              "device_offline_status", "DEVICE_FAILURE", "device_offline_heartbeat", "DEVICE_FAILURE")])
    got = found.where("kind = 'alert'").select("device_id", names[F.col("rule")].alias("event_type"), F.timestamp_micros("at_us").alias("time"))
    assert got.count() > 10 and _rows(got, "device_id", "event_type", "time") == _rows(want, "device_id", "event_type", "time")


def test_registry(replayed):
    found, table, _ = replayed
    assert found.where("kind = 'unknown'").count() == table.alias("t").where("message_type = 'events'").join(
        table.where("message_type <> 'events'").groupBy("device_id").agg(F.min("offset").alias("first")), "device_id").where("offset < first").count()
    last = found.where("kind = 'device'").groupBy("device_id").agg(F.max_by(F.struct("firmware", "status", "ref_us", "first_us"), F.struct("at_us", F.col("status") == "offline")).alias("d")).select("device_id", "d.*")
    seen = table.where("message_type <> 'events'").groupBy("device_id").agg(F.min_by("firmware_version", "offset").alias("firmware"), F.min(F.unix_micros("received_at")).alias("first_us"))
    assert _rows(last, "device_id", "firmware", "first_us") == _rows(seen, "device_id", "firmware", "first_us")
    told = {r.device_id: r.s for r in table.where("message_type = 'status'").groupBy("device_id").agg(F.max_by("status", "offset").alias("s")).collect()}
    # Every live device of the data has gone silent at the end.
    assert {r.device_id: r.status for r in last.collect()} == {d: "maintenance" if s == "maintenance" else "offline" for d, s in told.items()} | {"zz": "unknown"}


def test_state_of_a_silent_device_expires(spark, replayed):
    _, _, ck = replayed
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(ck)
    assert {r.key.device_id for r in state("device").collect()} == {"a", "b", "c", "zz"}
    assert {r.key.device_id for r in spark.read.format("statestore").option("stateVarName", "samples").option("flattenCollectionTypes", True).load(ck).collect()} == {"zz"}
    assert spark.read.format("statestore").option("stateVarName", "marks").option("flattenCollectionTypes", True).load(ck).count() == 0
    assert all(r.value.failed is None and r.value.due is None for r in state("device").collect() if r.key.device_id != "zz")


def test_files_do_not_matter(run, replayed):
    found, _, _ = replayed
    once, _, _ = run(_messages(), files=1, name="once")
    columns = ["device_id", "kind", "offset", "rule", "at_us", "value", "base"]
    events = "kind <> 'device'"
    assert _rows(once.where(events), *columns) == _rows(found.where(events), *columns)


def test_readings_may_show_life(run):
    second = 1_000_000
    rows = [_row(0, 0, "a", "status", "online")] + [_row(i, i * 20 * second, "a", "telemetry", power=1.0, volts=220.0) for i in range(1, 6)]
    rows.append(_row(9, 10**10, "zz", "telemetry", power=1.0, volts=220.0))
    silent, _, _ = run(rows, name="by_status", files=2)
    alive, _, _ = run(rows, name="by_any", files=2, settings=Settings(liveness="any"))
    at = lambda df: [(r.at_us - rows[0][1].timestamp() * second) // second for r in df.where("kind = 'offline'").collect()]
    assert at(silent) == [30] and at(alive) == [130]
