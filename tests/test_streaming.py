"""Streams replayed from files give the rows of the batch operators."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wattlane.operators import aggregates, forest, ingest, rules, scoring, sequences, series, validate, verifier
from wattlane.plans import fixtures as fx
from wattlane.settings import Settings
from wattlane.sources import messages as sources
from wattlane.sources.models import ModelStore
from wattlane.sources.rules_config import shipped_rules
from wattlane.sources.tables import TableStore
from wattlane.streaming import ingest as stream_ingest
from wattlane.streaming import machine, maintenance, rollup, stateful


@pytest.fixture(scope="module")
def replay(spark, tmp_path_factory):
    """Write a frame as several ordered files and read it back as a stream."""
    def make(df, order, files=4):
        folder = str(tmp_path_factory.mktemp("stream"))
        parts = df.withColumn("_p", F.ntile(files).over(__import__("pyspark").sql.Window.orderBy(order)))
        for i in range(1, files + 1):
            parts.where(F.col("_p") == i).drop("_p").coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return make


@pytest.fixture(scope="module")
def collect(spark, tmp_path_factory):
    def run(stream, name, mode="append"):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option(
            "checkpointLocation", str(tmp_path_factory.mktemp("ck"))
        ).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name)

    return run


def rows(df, *columns):
    return sorted(tuple(map(str, r)) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def few(spark, small):
    keep = F.col("device_id").isin("house_0001", "house_0002", "house_0003", "house_0007")
    return lambda df: df.where(keep)


def test_spike_stream(spark, small, replay, collect, few):
    source = few(fx.arrivals(spark, small))
    got = collect(stateful.spike_stream(replay(source, "offset"), "power_w", 60), "spikes")
    want = rules.spike_baseline(source, "power_w", 60)
    assert rows(got, "device_id", "offset", "value", "baseline") == rows(want, "device_id", "offset", "value", "baseline")


def test_cooldown_stream(spark, small, replay, collect, few):
    source = few(fx.rule_events(spark, small)).select("device_id", "event_type", "time", "offset")
    source = spark.createDataFrame(source.collect(), source.schema)
    got = collect(stateful.cooldown_stream(replay(source, "offset"), ["device_id", "event_type"], "time", 300), "cool")
    want = sequences.cooldown(source, ["device_id", "event_type"], "time", "offset", 300)
    assert rows(got, "device_id", "event_type", "time") == rows(want, "device_id", "event_type", "time")


def test_count_window_stream(spark, small, replay, collect, few):
    source = few(fx.arrivals(spark, small)).select("device_id", "offset", "voltage_v", "temperature_c")
    got = collect(stateful.count_window_stream(replay(source, "offset"), 8), "windows")
    want = sequences.count_windows(source, ["device_id"], "offset", 8)
    names = ("device_id", "offset", "temperature_c", "window_id", "window_pos")
    assert rows(got, *names) == rows(want, *names)


def test_heartbeat_stream(spark, small, replay, collect, few):
    source = few(fx.status(spark, small)).select("device_id", "time", "offset", "status")
    late = spark.createDataFrame([("zz", 10**9, "maintenance")], "device_id STRING, offset LONG, status STRING")
    # A last row an hour after the data moves the watermark past every deadline.
    source = source.unionByName(late.withColumn("time", F.lit("2024-01-01 03:00:00").cast("timestamp")))
    got = collect(stateful.heartbeat_stream(replay(source, "offset"), lateness="0 seconds"), "beats")
    want = sequences.heartbeat_failures(source, "2024-01-01 02:59:00")
    assert rows(got, "device_id", "last_seen", "offline_at") == rows(want, "device_id", "last_seen", "offline_at")


def test_dedup_and_rollup_stream(spark, small, replay, collect):
    source = fx.duplicates(spark, small)
    end = source.limit(1).withColumn("time", F.lit("2024-01-01 09:00:00").cast("timestamp")).withColumn(
        "offset", F.lit(10**15)
    )
    stream = replay(source.unionByName(end), "offset")
    unique = rollup.dedup_stream(stream, "2 hours")
    got = collect(rollup.minute_rollup_stream(unique, None), "minutes")
    want = aggregates.minute_rollup(ingest.dedup_readings(source))
    names = ("bucket", "device_id", "sample_count", "max_power_w", "min_voltage_v")
    assert rows(got, *names) == rows(want, *names)


#: A message of another device an hour later, after which all others are silent.
CLOSING = """SELECT 'energy/house_9999/telemetry' AS topic, CAST('{"schema_version":"1.0","device_id":"house_9999",
    "timestamp":"2024-01-01T03:00:00Z","voltage_v":220.0,"current_a":1.0,"power_w":220.0,"temperature_c":20.0}' AS BINARY) AS payload,
    timestamp '2024-01-01 03:00:00' AS received_at, 1000000000L AS offset"""
OPTIONS = Settings(alert_channels=("console", "webhook"), escalation_mode="all")


@pytest.fixture(scope="module")
def models(spark, small):
    """A small forest and a linear verifier."""
    readings = fx.arrivals(spark, small)
    return forest.fit(readings, trees=8, samples=64, train_rows=2_000), verifier.train_linear(readings, components=4)


@pytest.fixture(scope="module")
def ingest_files(spark, small, tmp_path_factory, models):
    def run(files, settings=OPTIONS, rows=800, source=None):
        base = tmp_path_factory.mktemp("tables")
        landing = tmp_path_factory.mktemp("landing")
        if source is None:
            source = fx.messages(spark, small).where(F.col("offset") < rows).unionByName(spark.sql(CLOSING))
        size = rows // files
        for i in range(files):
            last = F.lit(i + 1 == files) | (F.col("offset") < (i + 1) * size)
            source.where((F.col("offset") >= i * size) & last).coalesce(1).write.mode("append").parquet(str(landing))
        store = TableStore(spark, str(base / "t"))
        ModelStore(store).save(models[0], 1)
        stream = sources.stream_messages(spark, str(landing), max_files=1)
        q = stream_ingest.start_ingest(stream, str(base / "t"), str(base / "ck"), shipped_rules, settings, window_model=models[1])
        q.awaitTermination(600)
        assert q.exception() is None
        return store, source, base, stream

    return run


@pytest.fixture(scope="module")
def ingested(ingest_files):
    return ingest_files(3)


@pytest.fixture(scope="module")
def at_once(ingest_files):
    return ingest_files(1)


def contents(store):
    """What the tables hold, but for times of processing."""
    out = {}
    for name in ("energy_readings", "data_quality_logs", "device_status_history", "events", "model_predictions", "verdicts"):
        if not store._folders(name, "date"):
            continue
        df = store.scan(name)
        # The last digits of an error depend on how many windows are multiplied at once.
        out[name] = rows(df, *sorted(set(df.columns) - {"created_at", "batch", "date", "recon_error"}))
    out["alert_outbox"] = [] if not store._folders("alert_outbox", "date") else rows(store.scan("alert_outbox"), "event_id", "channel", "payload")
    out["minutes"] = minutes(rollup.minute_table(store.scan("energy_readings_1min")))
    if store._folders("devices", "date"):
        devices = stream_ingest.device_table(store.scan("devices"))
        out["devices"] = rows(devices, *devices.columns)
    out["totals"] = rows(store.state("counter_totals", 99, stream_ingest.TOTALS), "name", "value")
    return out


def minutes(df):
    averages = [F.round(c, 6) for c in ("avg_voltage_v", "avg_current_a", "avg_power_w")]
    return sorted(tuple(map(str, r)) for r in df.select("bucket", "device_id", *averages, "max_power_w", "min_voltage_v", "sample_count").collect())


def test_ingest_tables_equal_one_batch(spark, ingested):
    store, source, _, _ = ingested
    checked = validate.validate_messages(validate.route(source))
    readings = validate.valid_readings(checked)
    unique = ingest.dedup_readings(readings)
    assert rows(store.scan("energy_readings"), "time", "device_id", "power_w") == rows(unique, "time", "device_id", "power_w")
    assert rows(store.scan("data_quality_logs"), "log_id", "error_type") == rows(
        validate.quality_rows(checked), "log_id", "error_type"
    )
    lost = store.scan("events").where("rule_name = 'device_offline_heartbeat'")
    hits = rules.evaluate(readings, shipped_rules(), resets=lost.select("device_id", F.col("time").alias("reset_at")))
    other = ("device_event", "device_offline_status", "device_offline_heartbeat", "ml_isolation_forest")
    fired = store.scan("events").where(~F.col("rule_name").isin(*other))
    assert rows(fired, "time", "device_id", "rule_name") == rows(hits, "time", "device_id", "rule_name")
    assert stream_ingest.device_table(store.scan("devices")).count() == checked.where(
        "error_type IS NULL AND message_type <> 'events'"
    ).select("device_id").distinct().count()


def test_three_files_equal_one(ingested, at_once):
    three, one = contents(ingested[0]), contents(at_once[0])
    assert {n: len(v) for n, v in three.items()} == {n: len(v) for n, v in one.items()}
    for name in three:
        assert three[name] == one[name], name


def test_silence_has_four_effects(ingested):
    store = ingested[0]
    lost = store.scan("events").where("rule_name = 'device_offline_heartbeat'")
    assert lost.count() > 0 and {r.severity for r in lost.collect()} == {"CRITICAL"}
    history = store.scan("device_status_history").where("metadata LIKE '%heartbeat_timeout%'")
    assert rows(history, "device_id", "time") == rows(lost, "device_id", "time")
    assert store.scan("alert_outbox").join(lost.select("event_id"), "event_id").count() > 0
    devices = {r.device_id: r for r in stream_ingest.device_table(store.scan("devices")).collect()}
    ends = lost.groupBy("device_id").agg(F.max("time").alias("t")).collect()
    ended = [r for r in ends if devices[r.device_id].updated_at == r.t]
    assert len(ended) > 2 and {devices[r.device_id].status for r in ended} == {"offline"}
    assert not {"online", "error"} & {r.status for r in devices.values()}  # at the end nobody is live


def test_predictions_and_model_events(spark, ingested, models):
    store, source, _, _ = ingested
    readings = validate.valid_readings(validate.validate_messages(validate.route(source)))
    scored = forest.score(readings, models[0])
    got = store.scan("model_predictions")
    want = scoring.prediction_rows(scored).dropDuplicates(["time", "device_id"])
    key = ("time", "device_id", "predicted_label")
    assert rows(got.select(*key), *key) == rows(want, *key)
    hits = scoring.model_hits(scored).join(readings.select("offset", "received_at"), "offset")
    passed = sequences.cooldown(hits, ["device_id", "event_type"], "received_at", "offset", 300)
    events = store.scan("events").where("rule_name = 'ml_isolation_forest'")
    assert events.count() > 0 and rows(events, "time", "device_id", "message") == rows(passed, "time", "device_id", "message")


def test_minute_table_with_late_rows_and_copies(ingested):
    store, source, _, _ = ingested
    readings = validate.valid_readings(validate.validate_messages(validate.route(source)))
    want = aggregates.minute_rollup(ingest.dedup_readings(readings))
    assert minutes(rollup.minute_table(store.scan("energy_readings_1min"))) == minutes(want)
    assert store.scan("energy_readings_1min").count() > want.count()  # minutes that several batches share


def test_totals_run_over_batches(ingested):
    store, source, _, _ = ingested
    checked = validate.validate_messages(validate.route(source))
    readings = validate.valid_readings(checked)
    metrics = store.scan("system_metrics")
    stored = metrics.where("metric_name = 'counter.readings.stored'").orderBy("batch").collect()
    values = [r.metric_value for r in stored]
    assert len(values) >= 3 and values == sorted(values) and values[-1] == ingest.dedup_readings(readings).count()
    copies = metrics.where("metric_name = 'counter.readings.duplicates'").agg(F.max("metric_value")).first()[0] or 0
    assert copies + values[-1] == readings.count()
    received = metrics.where("metric_name = 'counter.messages.received'").agg(F.max("metric_value")).first()[0]
    assert received == checked.count()
    rates = series.counter_rate(metrics, "counter.messages.received", "rate").collect()
    assert len(rates) >= 2 and all(r.rate >= 0 for r in rates) and max(r.rate for r in rates) > 0
    names = {r.metric_name for r in metrics.select("metric_name").distinct().collect()}
    assert {f"latency.{op}.{stat}" for op in ("telemetry", "status", "ml_inference") for stat in ("avg_ms", "p50_ms", "p95_ms", "p99_ms")} <= names


def test_latencies_keep_the_last_samples(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    first = stream_ingest.add_latencies(store, [("telemetry", 6, 0.006), ("status", 0, 1.0)], 1, 10).collect()
    assert [(r.operation, r["count"], round(r.avg_ms, 6)) for r in first] == [("telemetry", 6, 1.0)]
    again = stream_ingest.add_latencies(store, [("telemetry", 8, 0.016)], 2, 10).collect()
    assert [(r["count"], round(r.avg_ms, 6), round(r.p50_ms, 6)) for r in again] == [(10, 1.8, 2.0)]
    assert rows(stream_ingest.add_latencies(store, [("telemetry", 8, 0.016)], 2, 10), "count", "avg_ms") == rows(spark.createDataFrame(again), "count", "avg_ms")
    last = stream_ingest.add_latencies(store, [("telemetry", 50, 0.150)], 3, 10).collect()
    assert [(r["count"], round(r.p50_ms, 6)) for r in last] == [(10, 3.0)]
    assert store.state("latency_samples", 9, stream_ingest.LATENCIES).count() == 1


def test_verdicts_equal_the_batch(ingested, models):
    store, source, _, _ = ingested
    readings = validate.valid_readings(validate.validate_messages(validate.route(source)))
    want = verifier.verdicts(readings, models[1])
    got = store.scan("verdicts")
    columns = ("device_id", "window_id", "offset", "confirmed")
    assert got.count() > 100 and rows(got, *columns) == rows(want, *columns)
    assert got.select("batch").distinct().count() > 1


def test_alert_cooldown_spans_batches(spark, ingested):
    store, source, _, _ = ingested
    came = source.select(F.col("offset").alias("_o"), "received_at")
    critical = store.scan("events").where("severity = 'CRITICAL'")
    queued = store.scan("alert_outbox").select("event_id", "channel", "created_at")
    assert queued.select("event_id", "channel").distinct().count() == queued.count() == 2 * queued.select("event_id").distinct().count()
    sent = critical.join(queued.select("event_id").distinct(), "event_id")
    per_key = sent.groupBy("device_id", "event_type").agg(F.sort_array(F.collect_list(F.unix_micros("time"))).alias("t")).collect()
    # Arrival is at most some seconds after the event's time.
    assert all(b - a >= 290_000_000 for r in per_key for a, b in zip(r.t, r.t[1:]))
    keys = critical.select("device_id", "event_type").distinct()
    assert len(per_key) == keys.count() and came.count() > 0


@pytest.fixture
def process(spark, models, tmp_path):
    """Give batches of messages to the sinks, with the findings of a machine that found nothing."""
    store = TableStore(spark, str(tmp_path / "t"))

    def run(messages, version, settings=OPTIONS, model=True):
        checked = validate.validate_messages(validate.route(messages))
        both = stream_ingest.together(checked, spark.createDataFrame([], machine.FINDINGS))
        stream_ingest.process_batch(store, both, version, shipped_rules(), settings, forest.Scorer(models[0]) if model else None, models[1])
        return store

    return run


def test_replayed_batch_changes_nothing(spark, small, process):
    source = fx.messages(spark, small).where("offset < 300")
    process(source.where("offset < 150"), 1, model=False)
    store = process(source.where("offset >= 150"), 2)
    before = contents(store)
    assert contents(process(source.where("offset >= 150"), 2)) == before


def test_redelivered_messages_add_nothing(spark, small, process):
    """The same messages come again in a later batch: no new rows, and all count as duplicates."""
    source = fx.messages(spark, small).where("offset < 300")
    process(source, 1, model=False)
    store = process(source.withColumn("offset", F.col("offset") + 300), 2, model=False)
    once = ingest.dedup_readings(validate.valid_readings(validate.validate_messages(validate.route(source))))
    assert rows(store.scan("energy_readings"), "time", "device_id") == rows(once, "time", "device_id")
    assert minutes(rollup.minute_table(store.scan("energy_readings_1min"))) == minutes(aggregates.minute_rollup(once))
    totals = {r.name: r.value for r in store.state("counter_totals", 99, stream_ingest.TOTALS).collect()}
    assert totals["readings.stored"] == once.count() and totals["readings.duplicates"] == totals["messages.telemetry"] - once.count()


@pytest.mark.parametrize("mode,inline,expected", [("ml", False, {"ml"}), ("hybrid", True, {"rules", "ml"})])
def test_detection_modes(spark, small, process, mode, inline, expected):
    settings = Settings(detection_mode=mode, ml_inline=inline, storage_policy="event_only")
    source = fx.messages(spark, small).where("offset < 400")
    store = process(source, 1, settings)
    names = {r.rule_name for r in store.scan("events").select("rule_name").distinct().collect()}
    rule_names = {r.name for r in shipped_rules()}
    assert {k for k, own in (("rules", rule_names), ("ml", {"ml_isolation_forest"})) if names & own} == expected
    triggers = rule_names & names | ({"ml_isolation_forest"} if inline else set())
    hit = store.scan("events").where(F.col("rule_name").isin(*triggers)) if triggers else None
    kept = rows(store.scan("energy_readings"), "time", "device_id") if triggers else []
    assert kept == (rows(hit.select("time", "device_id").distinct(), "time", "device_id") if hit is not None else [])
    readings = ingest.dedup_readings(validate.valid_readings(validate.validate_messages(validate.route(source))))
    assert minutes(rollup.minute_table(store.scan("energy_readings_1min"))) == minutes(aggregates.minute_rollup(readings))


def test_changed_rules_restart_the_query(spark, small, tmp_path):
    landing = tmp_path / "in"
    for i in range(2):
        fx.messages(spark, small).where((F.col("offset") >= i * 100) & (F.col("offset") < (i + 1) * 100)).coalesce(1).write.mode("append").parquet(str(landing))
    asked = []

    def rules_of():
        asked.append(1)
        return shipped_rules() if len(asked) > 2 else []

    stream = sources.stream_messages(spark, str(landing), max_files=1)
    stream_ingest.run_ingest(stream, str(tmp_path / "t"), str(tmp_path / "ck"), rules_of)
    store = TableStore(spark, str(tmp_path / "t"))
    batches = {r.batch for r in store.scan("events").where(F.col("rule_name").isin(*[r.name for r in shipped_rules()])).select("batch").distinct().collect()}
    assert batches and 1 not in batches
    assert store.scan("energy_readings").select("batch").distinct().count() == 2


def test_time_scan_prunes_dates(ingested):
    store = ingested[0]
    plan = store.scan("energy_readings", "2024-01-01 00:00:00", "2024-01-01 00:05:00")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in text
    assert "GreaterThanOrEqual(time" in text


def test_prune_keeps_recent_rows(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    df = spark.sql("""SELECT timestamp '2024-01-01 12:00:00' + make_dt_interval(id) AS time, concat('d', id) AS device_id
                      FROM range(5)""")
    store.append("energy_readings", df)
    assert store.prune("energy_readings", "2024-01-05 18:00:00", 2) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    left = {str(r.time)[:10] for r in store.scan("energy_readings").collect()}
    assert left == {"2024-01-04", "2024-01-05"}
    assert store.prune("energy_readings", "2024-01-06 00:00:00", 2) == []
    assert store.prune("energy_readings", "2024-01-06 18:00:00", 2) == ["2024-01-04"]
    assert store.scan("energy_readings").count() == 1


def test_prune_of_the_outbox_keeps_open_rows(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    df = spark.sql("""SELECT timestamp '2024-01-01 12:00:00' + make_dt_interval(id DIV 2) AS created_at,
                      id AS outbox_id, if(id = 1 OR id > 5, 'pending', 'sent') AS status FROM range(8)""")
    store.append("alert_outbox", df)
    assert store.prune("alert_outbox", "2024-01-10 00:00:00", 2) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert sorted(r.outbox_id for r in store.scan("alert_outbox").collect()) == [1, 6, 7]
    assert store.prune("alert_outbox", "2024-01-10 00:00:00", 2) == []


def test_appends_read_only_their_own_times(spark, tmp_path):
    """However full the day is, a batch looks up the rows of its own range of times."""
    store = TableStore(spark, str(tmp_path))
    looked = []
    for batch in range(1, 6):
        df = spark.sql(f"""SELECT timestamp '2024-01-01 00:00:00' + make_dt_interval(0, {batch}, 0, id) AS time,
                           concat('d', id % 7) AS device_id FROM range(50)""")
        df = df.unionByName(df.limit(5))
        held = store.held("energy_readings", df, batch)
        looked.append(0 if held is None else held.count())
        store.append_new("energy_readings", df.distinct(), batch=batch)
    assert looked == [0] * 5 and store.scan("energy_readings").count() == 250
    plan = store.held("energy_readings", df, 9)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(time), GreaterThanOrEqual(time" in plan and "PartitionFilters: [" in plan
    again = store.unseen("energy_readings", df, 9)
    assert again.count() == 0 and store.unseen("energy_readings", df, 5).count() == 55


def test_compacted_days_hold_the_same_rows(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    df = spark.sql("""SELECT timestamp '2024-01-01 12:00:00' + make_dt_interval(0, 0, 0, 20 * id) AS time, concat('d', id % 3) AS device_id,
                      id * 1.0D AS voltage_v, if(id % 4 = 0, NULL, 2.0D) AS current_a, id * 3.0D AS power_w FROM range(40)""")
    for batch in (1, 2, 3):
        part = df.where(F.pmod(F.xxhash64("time"), F.lit(3)) == batch - 1)
        store.append("energy_readings", part, batch)
        store.append("energy_readings_1min", rollup.minute_parts(part), batch)
    for name in ("energy_readings", "energy_readings_1min"):
        assert maintenance.compact(store, name, "2024-01-01") == []
        assert maintenance.compact(store, name, "2024-01-02") == ["2024-01-01"]
        assert {r.batch for r in store.scan(name).select("batch").distinct().collect()} == {3}
        assert maintenance.compact(store, name, "2024-01-02") == []
    assert rows(store.scan("energy_readings"), "time", "device_id", "power_w") == rows(df, "time", "device_id", "power_w")
    parts = store.scan("energy_readings_1min")
    assert parts.count() == parts.select("bucket", "device_id").distinct().count()
    assert minutes(rollup.minute_table(parts)) == minutes(aggregates.minute_rollup(df))
