"""Rules, policies, outbox, metrics, waveform, escalation and model cases."""
from __future__ import annotations

import json
import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlane.operators import (
    aggregates, devices, escalation, forest, ingest, outbox, policy, rules, series, verifier, waveform,
)
from wattlane.plans import fixtures as fx
from wattlane.plans.report import report_lines, snapshot, write_report
from wattlane.settings import Settings
from wattlane.sources.rules_config import load_rules, parse_rules, shipped_rules

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def readings(spark, *rows):
    schema = ("offset LONG, time TIMESTAMP, received_at TIMESTAMP, device_id STRING, voltage_v DOUBLE, "
              "current_a DOUBLE, power_w DOUBLE, temperature_c DOUBLE")
    full = [(i, T0 + timedelta(seconds=i), T0 + timedelta(seconds=i), "d", *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, schema)


def one(name, **condition):
    return parse_rules({"rules": {name: {"condition": condition}}})


def test_threshold_rule(spark):
    df = readings(spark, (180.0, 1.0, 200.0, None))
    rule = {"event_type": "UNDER_VOLTAGE", "condition": {"field": "voltage_v", "operator": "lt", "value": 200}}
    hit = rules.threshold_hits(df, parse_rules({"rules": {"undervoltage": rule}})).first()
    assert (hit.event_type, hit.severity) == ("UNDER_VOLTAGE", "WARNING")
    assert hit.message == "voltage_v=180.0 lt 200 (rule=undervoltage)"
    assert json.loads(hit.metadata) == {"field": "voltage_v", "operator": "lt"}
    off = parse_rules({"rules": {"undervoltage": {**rule, "enabled": False}}})
    assert rules.evaluate(df, off).count() == 0
    assert rules.threshold_hits(df, one("hot", field="temperature_c", operator="gt", value=1)).count() == 0


@pytest.mark.parametrize("op,hits", [("lt", 1), ("le", 2), ("gt", 1), ("ge", 2), ("eq", 1), ("ne", 2)])
def test_comparisons(spark, op, hits):
    df = readings(spark, *[(v, 0.0, 0.0, 0.0) for v in (1.0, 2.0, 3.0)])
    assert rules.threshold_hits(df, one("r", field="voltage_v", operator=op, value=2)).count() == hits


def test_rule_files(tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"rules": {"a": {"condition": {"field": "power_w", "operator": "gt", "value": 1}}}}))
    loaded = load_rules(path)
    assert [(r.name, r.event_type, r.severity, r.type) for r in loaded] == [("a", "A", "WARNING", "threshold")]
    path.write_text("{broken")
    assert load_rules(path, loaded) == loaded
    assert load_rules(tmp_path / "none.json") == []
    assert [r.name for r in shipped_rules() if r.enabled] == [
        "undervoltage", "overvoltage", "overload", "power_spike", "voltage_anomaly_low", "over_temperature"
    ]


@pytest.mark.parametrize("settings,fired,keep,reason", [
    (Settings(processing_mode="baseline", storage_policy="aggregate_only"), False, True, "baseline_forces_raw"),
    (Settings(storage_policy="raw"), False, True, "policy_raw"),
    (Settings(storage_policy="hybrid", store_raw_readings=False), False, False, "policy_hybrid_skip"),
    (Settings(storage_policy="hybrid", store_raw_readings=False), True, True, "policy_hybrid_store"),
    (Settings(storage_policy="event_only"), True, True, "policy_event_only_event"),
    (Settings(storage_policy="event_only"), False, False, "policy_event_only_skip"),
    (Settings(storage_policy="aggregate_only"), True, False, "policy_aggregate_only_skip"),
])
def test_storage_policy(spark, settings, fired, keep, reason):
    df = spark.createDataFrame([(fired,)], "event_triggering BOOLEAN")
    got = policy.storage_decision(df, settings).first()
    assert (got.store_raw, got.reason) == (keep, reason)


def test_unknown_modes_are_refused(spark):
    for bad in ({"processing_mode": "x"}, {"storage_policy": "x"}):
        with pytest.raises(ValueError):
            Settings(**bad)
    with pytest.raises(ValueError):
        policy.escalation_gate(spark.range(1), "sometimes")


def test_escalation_gate(spark):
    df = spark.createDataFrame([(0.60, True), (0.75, True), (0.40, False)], "anomaly_score DOUBLE, is_anomaly BOOLEAN")
    assert policy.escalation_gate(df, "gated").count() == 2
    assert [r.anomaly_score for r in policy.escalation_gate(df, "gated", 0.7).collect()] == [0.75]
    assert policy.escalation_gate(df, "gated", 0.75).count() == 1
    assert policy.escalation_gate(df, "all").count() == 3
    assert policy.escalation_gate(df, "off").count() == 0


def test_latency_index_rule(spark):
    df = spark.createDataFrame([("op", float(v), v) for v in (5, 1, 4, 2, 3)], "operation STRING, value_ms DOUBLE, offset LONG")
    got = aggregates.latency_summary(df).first()
    assert (got["count"], got.avg_ms, got.p50_ms, got.p95_ms, got.p99_ms) == (5, 3.0, 3.0, 4.0, 4.0)
    last = aggregates.latency_summary(df, keep=2).first()
    assert (last["count"], last.avg_ms) == (2, 4.5)


def test_data_reduction_and_throughput(spark):
    counters = spark.createDataFrame(
        [("readings.stored", 100), ("events.type.a", 30), ("events.warning", 30), ("messages.received", 200)],
        "name STRING, value LONG",
    )
    assert aggregates.data_reduction(counters).first().data_reduction_ratio == pytest.approx(0.7)
    assert aggregates.data_reduction(counters.where("value < 100")).first().data_reduction_ratio == 0.0
    many = counters.where("name = 'readings.stored'").unionByName(
        spark.createDataFrame([("events.type.a", 500)], "name STRING, value LONG"))
    assert aggregates.data_reduction(many).first().data_reduction_ratio == 0.0
    got = aggregates.throughput(counters, 10).first()
    assert (got.messages_per_second, got.readings_per_second, got.events_per_second) == (20.0, 10.0, 3.0)


def test_confusion_is_safe_without_rows(spark):
    empty = spark.createDataFrame([], "t BOOLEAN, f BOOLEAN")
    got = aggregates.confusion(empty, F.col("t"), F.col("f")).first()
    assert (got.tp, got.precision, got.recall, got.f1, got.false_positive_rate) == (0, 0.0, 0.0, 0.0, 0.0)


def test_waveform(spark):
    n, rows = 640, []
    for window, phase in ((1, 0.0), (2, math.pi / 3)):
        for k in range(n):
            a = 2 * math.pi * k * 4 / n
            rows.append((window, k, 2048 + round(800 * math.sin(a)), 2048 + round(600 * math.sin(a - phase))))
    df = spark.createDataFrame(rows, "window_id INT, k INT, v_raw INT, i_raw INT")
    v_scale, i_scale = 230 / (800 / math.sqrt(2)), 5 / (600 / math.sqrt(2))
    got = {r.window_id: r for r in waveform.window_metrics(df, v_scale, i_scale, ("window_id",)).collect()}
    assert got[1].voltage_v == pytest.approx(230, rel=2e-3) and got[1].current_a == pytest.approx(5, rel=2e-3)
    assert got[1].power_factor == pytest.approx(1, abs=2e-3) and got[2].power_factor == pytest.approx(0.5, abs=2e-3)
    assert got[1].power_w == pytest.approx(1150, rel=3e-3) and got[2].power_w == pytest.approx(575, rel=5e-3)
    flat = df.withColumn("i_raw", F.lit(2048))
    assert waveform.window_metrics(flat, 1.0, 1.0, ("window_id",)).first().power_factor == 0.0
    none = df.limit(1).withColumn("v_raw", F.lit(None).cast("int"))
    assert waveform.window_metrics(none, 1.0, 1.0, ("window_id",)).first().voltage_v == 0.0


def _outbox(spark, *rows):
    base = spark.createDataFrame(rows, "outbox_id LONG, event_id LONG, channel STRING, attempts INT, status STRING")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    null = F.lit(None)
    return base.withColumns({
        "next_attempt_at": now, "last_error": null.cast("string"), "locked_at": now,
        "sent_at": null.cast("timestamp"), "created_at": now, "updated_at": now,
    })


def test_outbox_settles(spark):
    box = _outbox(spark, (1, 10, "console", 0, "processing"), (2, 20, "webhook", 1, "processing"),
                  (3, 30, "slack", 4, "processing"), (4, 40, "slack", 1, "pending"))
    results = spark.createDataFrame(
        [(1, "ok", None), (2, "error", "status=500"), (3, "exception", "slack down")],
        "outbox_id LONG, outcome STRING, response STRING",
    )
    got = {r.outbox_id: r for r in outbox.settle(box, results, "2024-01-02 00:00:00").collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == ["sent", "failed", "discarded", "pending"]
    assert [got[i].attempts for i in (1, 2, 3, 4)] == [0, 2, 5, 1]
    assert got[2].last_error == "status=500" and got[3].last_error == "exception: slack down"
    assert got[2].next_attempt_at == datetime(2024, 1, 2, 0, 2) and got[3].next_attempt_at == datetime(2024, 1, 2)
    assert got[1].locked_at is None and got[4].locked_at is not None
    sent = {(r.event_id, r.status, r.response) for r in outbox.deliveries(box, results, "2024-01-02 00:00:00").collect()}
    assert sent == {(10, "ok", None), (20, "error", "status=500"), (30, "error", "exception: slack down")}


@pytest.mark.parametrize("attempts,seconds", [(1, 30), (2, 120), (3, 600), (4, 1800), (9, 1800), (0, 30)])
def test_retry_delays(spark, attempts, seconds):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = spark.range(1).select(outbox.retry_at(F.lit(attempts), now, Settings().retry_delays_seconds).alias("t")).first().t
    assert got == datetime(2024, 1, 1) + timedelta(seconds=seconds)


def test_claim_and_reclaim(spark):
    box = _outbox(spark, (1, 1, "a", 0, "pending"), (2, 2, "a", 0, "failed"), (3, 3, "a", 0, "processing"), (4, 4, "a", 0, "sent"))
    assert [r.outbox_id for r in outbox.due(box, "2024-01-02 00:00:00", 1).collect()] == [1]
    claimed = outbox.claim(box, "2024-01-02 00:00:00")
    assert {r.outbox_id for r in claimed.where("locked_at > '2024-01-01 12:00:00'").collect()} == {1, 2}
    assert {r.outbox_id for r in outbox.due(box, "2024-01-02 00:00:00", reclaim_after=60).collect()} == {1, 2, 3}
    assert outbox.due(box, "2023-12-31 00:00:00").count() == 0


def test_alert_texts(spark):
    df = spark.sql("""SELECT 7L AS event_id, 'd' AS device_id, 'OVERLOAD' AS event_type, 'CRITICAL' AS severity,
        timestamp '2024-01-01 00:00:00' AS time, 'msg' AS message, 12.5D AS event_value, 10.0D AS threshold_value""")
    got = df.select(outbox.payload().alias("p"), outbox.chat_text().alias("t")).first()
    assert json.loads(got.p) == {
        "event_id": 7, "device_id": "d", "event_type": "OVERLOAD", "severity": "CRITICAL",
        "time": "2024-01-01T00:00:00+00:00", "message": "msg", "value": 12.5, "threshold": 10.0,
    }
    assert got.t == (":rotating_light: *CRITICAL* `OVERLOAD` on `d`\nmsg\nvalue=`12.5` threshold=`10.0`"
                     "\n_event_id=7 time=2024-01-01T00:00:00+00:00_")
    bare = df.withColumn("event_value", F.lit(None).cast("double")).select(outbox.chat_text().alias("t")).first().t
    assert "value=" not in bare


def test_envelope_text_and_round_trip(spark):
    df = readings(spark, (230.0, 1.5, 345.0, None)).selectExpr(
        "*", "0.62D AS anomaly_score", "0.5D AS threshold", "'iforest_v1' AS model_version", "true AS rule_fired"
    ).withColumn("gateway", F.lit("g"))
    sent = escalation.envelopes(df, ["gateway"], "gated").first()
    assert sent.body == (
        '{"source":"edge-gateway","mode":"gated","readings":[{"device_id":"d","timestamp":"2024-01-01T00:00:00+00:00",'
        '"reading_time":"2024-01-01T00:00:00+00:00","voltage_v":230.0,"current_a":1.5,"power_w":345.0,'
        '"temperature_c":null,"anomaly_score":0.62,"threshold":0.5,"model_version":"iforest_v1","rule_fired":true}]}'
    )
    assert sent.bytes == len(sent.body)
    back = escalation.receive(escalation.envelopes(df, ["gateway"], "gated")).first()
    assert (back.device_id, back.anomaly_score, back.temperature_c, back.rule_fired) == ("d", 0.62, None, True)


def test_reduction_of_empty_arm_is_null(spark):
    arms = spark.createDataFrame([("gated", 0, 0, 0), ("all", 0, 0, 0)], "mode STRING, batches LONG, readings LONG, bytes LONG")
    assert escalation.reduction(arms).first().bytes_reduction_pct is None


def test_device_upsert_keeps_stored_nulls(spark):
    stored = spark.createDataFrame([], "device_id STRING, location STRING, device_type STRING, firmware_version STRING, "
                                   "status STRING, last_seen_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP")
    seen = spark.createDataFrame([("a", None, 1), ("a", "fw2", 2)], "device_id STRING, firmware_version STRING, offset LONG")
    first = devices.upsert_devices(stored, seen, "2024-01-01")
    row = first.first()
    assert (row.device_type, row.status, row.firmware_version) == ("energy_node", "unknown", None)
    again = devices.upsert_devices(first, seen, "2024-01-02").first()
    assert again.firmware_version is None and again.updated_at == datetime(2024, 1, 2) and again.created_at == datetime(2024, 1, 1)
    assert devices.upsert_devices(first, seen, "2024-01-02", fill_nulls=True).first().firmware_version == "fw2"
    status = spark.createDataFrame([("a", "online", T0, 1), ("a", "error", T0 - timedelta(days=1), 2), ("b", "online", T0, 3)],
                                   "device_id STRING, status STRING, time TIMESTAMP, offset LONG")
    got = {r.device_id: (r.status, r.last_seen_at) for r in devices.apply_status(first, status, "2024-01-02").collect()}
    assert got == {"a": ("error", datetime(2023, 12, 31)), "b": ("online", datetime(2024, 1, 1))}


def test_acknowledge_and_insert_if_absent(spark):
    events = spark.createDataFrame([(1, False), (2, False), (3, True)], "event_id LONG, acknowledged BOOLEAN")
    ids = spark.createDataFrame([(2,), (9,)], "event_id LONG")
    assert {(r.event_id, r.acknowledged) for r in series.acknowledge(events, ids).collect()} == {(1, False), (2, True), (3, True)}
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k STRING, offset LONG, v STRING")
    held = spark.createDataFrame([("b",)], "k STRING")
    once = ingest.insert_if_absent(held, rows, ["k"], "offset")
    assert [tuple(r) for r in once.collect()] == [("a", 1, "y")]
    assert ingest.insert_if_absent(held.unionByName(once.select("k")), rows, ["k"], "offset").count() == 0


def test_forest_finds_anomalies(spark, small):
    normal = fx.labelled(spark, small).where("kind = 'normal'")
    model = forest.fit(normal, trees=40, samples=128)
    rows = [(220.0, 2.0, 440.0, 30.0), (262.0, 6.8, 1500.0, 30.0), (180.0, 8.0, 1500.0, 30.0), (220.0, 2.0, 440.0, None)]
    got = [r.anomaly_score for r in forest.score(readings(spark, *rows), model).orderBy("offset").collect()]
    assert got[1] > got[0] and got[2] > got[0] and got[3] is None
    assert got[1] > model.threshold
    single = [forest.score(readings(spark, r), model).first().anomaly_score for r in rows[:3]]
    assert single == got[:3]
    again = forest.fit(normal.repartition(3), trees=40, samples=128)
    assert again.threshold == pytest.approx(model.threshold, abs=1e-12)
    assert 1.0 > max(got[:3]) and min(got[:3]) > 0.0


def test_tree_leaves_hold_all_rows():
    x = np.random.default_rng(0).normal(size=(200, 6))
    nodes = forest.grow_tree(x, np.random.default_rng(1), 8)
    assert all(f == -1 or (b > i and a > i) for i, (f, _, b, a, _) in enumerate(nodes))
    same = forest.grow_tree(np.ones((50, 6)), np.random.default_rng(1), 8)
    assert len(same) == 1 and same[0][4] == pytest.approx(float(forest.average_path(50)))
    assert forest.average_path([0, 1, 2]).tolist() == [0.0, 0.0, 1.0]


def test_verifier_windows(spark):
    weights = {k: np.zeros(s) for k, s in {
        "enc_w_ih": (8, 6), "enc_w_hh": (8, 2), "enc_b_ih": (8,), "enc_b_hh": (8,),
        "dec_w_ih": (8, 2), "dec_w_hh": (8, 2), "dec_b_ih": (8,), "dec_b_hh": (8,), "out_w": (6, 2), "out_b": (6,),
    }.items()}
    model = verifier.Verifier((220.0, 2.0, 440.0, 0.0, 0.0, 0.0), (1.0,) * 6, verifier.sequence_autoencoder(weights), 0.5)
    seven = readings(spark, *[(220.0, 2.0, 440.0, None)] * 7)
    assert verifier.verdicts(seven, model).count() == 0
    eight = verifier.verdicts(readings(spark, *[(220.0, 2.0, 440.0, None)] * 8, ), model).collect()
    assert len(eight) == 8 and not any(r.confirmed for r in eight) and all(r.recon_error == 0.0 for r in eight)
    bad = verifier.verdicts(readings(spark, *[(180.0, 2.0, 1500.0, 0.0)] * 9), model).collect()
    assert len(bad) == 8 and all(r.confirmed for r in bad)


def test_recurrent_step_matches_formula():
    rng = np.random.default_rng(3)
    into, back, bias = rng.normal(size=(8, 6)), rng.normal(size=(8, 2)), rng.normal(size=8)
    x = rng.normal(size=(1, 1, 6))
    gates = into @ x[0, 0] + bias
    sig = lambda v: 1 / (1 + np.exp(-v))
    cell = sig(gates[:2]) * np.tanh(gates[4:6])
    assert np.allclose(verifier._recurrent(x, into, back, bias)[0, 0], sig(gates[6:]) * np.tanh(cell))


def test_linear_verifier_rebuilds_normal_windows(spark, small):
    normal = fx.labelled(spark, small).where("kind = 'normal'")
    model = verifier.train_linear(normal, components=12)
    flagged = verifier.verdicts(normal, model).agg(F.avg(F.col("confirmed").cast("int")).alias("r")).first().r
    assert flagged == pytest.approx(0.05, abs=0.01)


def test_report(spark, small, tmp_path):
    counters = spark.createDataFrame([("b", 2), ("a", 1)], "name STRING, value LONG")
    lat = aggregates.latency_summary(spark.createDataFrame([("op", 1.0, 1)], "operation STRING, value_ms DOUBLE, offset LONG"))
    sev = spark.createDataFrame([("INFO", 3)], "severity STRING, count LONG")
    err = spark.createDataFrame([("invalid_json", 4)], "error_type STRING, count LONG")
    lines = report_lines(counters, lat, sev, err)
    got = [r.line for r in lines.collect()]
    assert got[:7] == ["## Counters", "", "| Counter | Value |", "| --- | ---: |", "| `a` | 1 |", "| `b` | 2 |", ""]
    assert "| `op` | 1 | 1.00 | 1.00 | 1.00 | 1.00 |" in got and "| `invalid_json` | 4 |" in got
    write_report(lines, str(tmp_path / "report"))
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == got
    doc = json.loads(snapshot(counters, lat, sev, err, "2024").first().snapshot)
    assert doc["counters"] == [{"name": "a", "value": 1}, {"name": "b", "value": 2}]


def test_rule_pass_is_one_scan_without_python(spark, small):
    hits = rules.threshold_hits(fx.arrivals(spark, small), shipped_rules())
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Python" not in plan


def test_filters_reach_the_scan(spark, small):
    df = fx.table(spark, small, "events").where("value > 100").select("user_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,100.0)" in plan and "ReadSchema: struct<user_id:bigint,value:double>" in plan
