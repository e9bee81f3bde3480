"""What the continuous ingest leaves in its tables, over all messages.

The messages are dealt into four parts in order of arrival, and each part is a micro-batch.
One run per session and data set serves all queries here. A last message of a device of its
own, two hours later, ends every silence; it is left out of the results.
"""
from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..operators import forest, verifier
from ..settings import Settings
from ..sources import messages as sources
from ..sources.models import ModelStore
from ..sources.rules_config import shipped_rules
from ..sources.tables import TableStore
from ..streaming import rollup
from ..streaming.delivery import AlertDelivery
from ..streaming.ingest import device_table, start_ingest
from . import fixtures as fx
from .registry import query

SETTINGS = Settings(alert_channels=fx.CHANNELS, escalation_mode="all")
PARTS = 4
LAST_DEVICE = "house_end"
LAST = f"""SELECT 'energy/{LAST_DEVICE}/telemetry' AS topic, CAST(concat('{{"schema_version":"1.0","device_id":"{LAST_DEVICE}",',
    '"timestamp":"2024-01-01T05:00:00Z","voltage_v":220.0,"current_a":1.0,"power_w":220.0}}') AS BINARY) AS payload,
    timestamp '2024-01-01 05:00:00' AS received_at, {1 << 60}L AS offset"""

# A small forest, (tree, node, feature, split, below, above, path), and what it stands for.
NODES = [
    (0, 0, 0, 200.0, 1, 2, 0.0), (0, 1, -1, 0.0, 1, 1, 1.0), (0, 2, 0, 250.0, 3, 4, 0.0), (0, 3, -1, 0.0, 3, 3, 3.0), (0, 4, -1, 0.0, 4, 4, 1.5),
    (1, 0, 2, 1500.0, 1, 2, 0.0), (1, 1, -1, 0.0, 1, 1, 3.0), (1, 2, -1, 0.0, 2, 2, 1.0),
    (2, 0, 3, 55.0, 1, 2, 0.0), (2, 1, -1, 0.0, 1, 1, 3.0), (2, 2, -1, 0.0, 2, 2, 2.0),
]
SAMPLES = 8
SCALE = 2 * (math.log(SAMPLES - 1) + 0.5772156649015329) - 2 * (SAMPLES - 1) / SAMPLES
THRESHOLD = 2 ** (-2.45 / SCALE)
SCORE_SQL = f"""pow(2, -((CASE WHEN voltage_v <= 200 THEN 1.0 WHEN voltage_v <= 250 THEN 3.0 ELSE 1.5 END
    + CASE WHEN power_w <= 1500 THEN 3.0 ELSE 1.0 END + CASE WHEN temperature_c <= 55 THEN 3.0 ELSE 2.0 END) / 3) / CAST({SCALE!r} AS DOUBLE))"""
# Scale of the six features, and the threshold, of a verifier that rebuilds each feature by its mean over the window.
MEAN = (220.0, 5.0, 1000.0, 40.0, 5.0, 0.0)
STD = (20.0, 5.0, 1000.0, 20.0, 10.0, 100.0)
CONFIRMED_ABOVE = 0.2

_RUNS: dict[tuple[str, str], TableStore] = {}


def fixed_forest(spark: SparkSession) -> forest.Forest:
    nodes = spark.createDataFrame(NODES, forest.NODES)
    width = len(forest.FEATURE_NAMES)
    return forest.Forest(nodes, (0.0,) * width, (1.0,) * width, SAMPLES, THRESHOLD, "iforest_v1", 220.0)


def window_means(window: int = 8) -> verifier.Verifier:
    """The verifier of the fixed values above, as a projection."""
    axes = np.zeros((window * verifier.WIDTH, verifier.WIDTH))
    for k in range(window):
        axes[k * verifier.WIDTH + np.arange(verifier.WIDTH), np.arange(verifier.WIDTH)] = 1 / math.sqrt(window)
    rebuild = verifier._linear(np.zeros(window * verifier.WIDTH), axes)
    return verifier.Verifier(MEAN, STD, rebuild, CONFIRMED_ABOVE, window)


def streamed(spark: SparkSession, sf_dir: str) -> TableStore:
    """The tables of the ingest of all messages."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        base = f"{session.shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
        messages = fx.messages(spark, sf_dir).unionByName(spark.sql(LAST))
        low, high = messages.where(F.col("offset") < 1 << 60).agg(F.min("offset"), F.max("offset")).first()
        files = spark.sparkContext.defaultParallelism
        step = (high - low) // PARTS + 1
        # The messages are made once; a part is a folder, whose rows then land as the files of one batch.
        at = F.least(F.floor((F.col("offset") - low) / step), F.lit(PARTS - 1)).cast("int")
        messages.withColumn("part", at).write.partitionBy("part").parquet(f"{base}/made")
        for part in range(PARTS):
            rows = spark.read.schema(messages.schema).parquet(f"{base}/made/part={part}")
            rows.repartition(files).write.mode("append").parquet(f"{base}/messages")
        store = TableStore(spark, f"{base}/tables")
        ModelStore(store).save(fixed_forest(spark), 1)
        stream = sources.stream_messages(spark, f"{base}/messages", max_files=files)
        start_ingest(stream, f"{base}/tables", f"{base}/checkpoint", shipped_rules, SETTINGS, window_model=window_means()).awaitTermination()
        _RUNS[key] = store
    return _RUNS[key]


def _rows(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return streamed(spark, sf_dir).scan(table).where(F.col("device_id") != LAST_DEVICE)


# Valid readings with the values sent, and the first copy of each.
VALID_SQL = """valid AS (SELECT c."offset", c.received_at, c.time, c.device_id, t.voltage_v, t.current_a, t.power_w, t.temperature_c
        FROM checked c JOIN telemetry t ON t.sequence_no = c.id AND c.kind = 'telemetry' WHERE c.error_type IS NULL),
    firsts AS (SELECT * FROM valid WHERE "offset" IN (SELECT min("offset") FROM valid GROUP BY time, device_id))"""
VIEWS = ("checked", "telemetry", "status", "device_events")

# Offline transitions by silence, on arrival: due 30 s after the last time seen, 300 s after the last transition.
SILENCE_SQL = """gaps AS (
        SELECT c.device_id, c.time AS last_seen, greatest(c.received_at, c.time + INTERVAL 30 SECOND) AS a,
               coalesce(lead(c.received_at) OVER (PARTITION BY c.device_id ORDER BY c.received_at, c."offset"), TIMESTAMP '2024-01-01 05:00:00') AS b,
               s.status FROM checked c JOIN status s ON s."offset" = c.id WHERE c.kind = 'status' AND c.error_type IS NULL),
    live AS (SELECT * FROM gaps WHERE status NOT IN ('offline', 'maintenance') AND a < b),
    fired AS (
        SELECT device_id, min(a) AS f FROM live GROUP BY 1
        UNION ALL
        SELECT * FROM (
            SELECT p.device_id, (SELECT min(greatest(l.a, p.f + INTERVAL 300 SECOND)) FROM live l
                WHERE l.device_id = p.device_id AND l.a > p.f AND greatest(l.a, p.f + INTERVAL 300 SECOND) < l.b) AS f
            FROM fired p)
        WHERE f IS NOT NULL),
    silences AS (SELECT device_id, f AS offline_at, (SELECT max(last_seen) FROM live l WHERE l.device_id = fired.device_id AND l.a <= f) AS last_seen
                 FROM fired)"""

# The baseline of a reading: its device's first sample of the last 60 s, not from before a silence.
SPIKES_SQL = """cleared AS (SELECT v.*, greatest(v.received_at - INTERVAL 60 SECOND, coalesce((
            SELECT max(offline_at) FROM silences s WHERE s.device_id = v.device_id AND s.offline_at <= v.received_at), TIMESTAMP '2000-01-01')) AS since
        FROM valid v),
    based AS (SELECT c.*, (SELECT arg_min(s.power_w, s."offset") FROM valid s WHERE s.device_id = c.device_id
              AND s.received_at >= c.since AND s."offset" < c."offset") AS baseline FROM cleared c),
    spikes AS (SELECT * FROM based WHERE baseline > 0 AND (power_w - baseline) / baseline * 100 >= 30)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n    ".join(parts)


@query("i12_stored_readings", _with(VALID_SQL) + """
    SELECT time, device_id, voltage_v, power_w FROM firsts""", VIEWS)
def _(spark, sf):
    return _rows(spark, sf, "energy_readings").select("time", "device_id", "voltage_v", "power_w")


@query("i12_dead_letters", """
    SELECT received_at AS time, error_type, count(*) AS n FROM checked WHERE error_type IS NOT NULL GROUP BY 1, 2""", VIEWS)
def _(spark, sf):
    return streamed(spark, sf).scan("data_quality_logs").groupBy("time", "error_type").agg(F.count("*").alias("n"))


@query("i4_minute_table", _with(VALID_SQL) + """
    SELECT date_trunc('minute', time) AS bucket, device_id, round(avg(voltage_v), 6) AS avg_voltage_v, round(avg(current_a), 6) AS avg_current_a,
           round(avg(power_w), 6) AS avg_power_w, max(power_w) AS max_power_w, min(voltage_v) AS min_voltage_v, count(*) AS sample_count
    FROM firsts GROUP BY 1, 2""", VIEWS)
def _(spark, sf):
    table = rollup.minute_table(_rows(spark, sf, "energy_readings_1min"))
    return table.withColumns({c: F.round(c, 6) for c in ("avg_voltage_v", "avg_current_a", "avg_power_w")})


@query("i7_offline_transitions", _with(SILENCE_SQL) + """
    SELECT device_id, offline_at AS time, last_seen, 'CRITICAL' AS severity, 'offline' AS status,
           round((epoch_us(offline_at) - epoch_us(last_seen)) / 1000000, 6) AS age_seconds FROM silences""", VIEWS)
def _(spark, sf):
    meta = F.from_json("metadata", "last_seen TIMESTAMP, age_seconds DOUBLE")
    events = _rows(spark, sf, "events").where("rule_name = 'device_offline_heartbeat'").withColumn("m", meta)
    history = _rows(spark, sf, "device_status_history").where("metadata LIKE '%heartbeat_timeout%'").select("device_id", "time", "status")
    return events.join(history, ["device_id", "time"], "full").select(
        "device_id", "time", F.col("m.last_seen").alias("last_seen"), "severity", "status", F.round("m.age_seconds", 6).alias("age_seconds"))


@query("i5_spikes", _with(VALID_SQL, SILENCE_SQL, SPIKES_SQL) + """
    SELECT device_id, time, power_w AS event_value, round(baseline, 6) AS baseline FROM spikes""", VIEWS)
def _(spark, sf):
    base = F.round(F.get_json_object("metadata", "$.baseline").cast("double"), 6)
    return _rows(spark, sf, "events").where("rule_name = 'power_spike'").select("device_id", "time", "event_value", base.alias("baseline"))


@query("i6_queued_alerts", _with(VALID_SQL, SILENCE_SQL, """src AS (
        SELECT device_id, 'OVERLOAD' AS event_type, received_at AS t, 1 AS o FROM valid WHERE current_a > 10
        UNION ALL SELECT c.device_id, e.event_type, c.received_at, 2 FROM checked c JOIN device_events e ON e."offset" = c.id
            WHERE c.kind = 'events' AND c.error_type IS NULL AND e.severity = 'CRITICAL' AND EXISTS (
                SELECT 1 FROM checked k WHERE k.device_id = c.device_id AND k.kind <> 'events' AND k.error_type IS NULL AND k.received_at <= c.received_at)
        UNION ALL SELECT device_id, 'DEVICE_FAILURE', received_at, 0 FROM (SELECT c.*, s.status FROM checked c JOIN status s ON s."offset" = c.id
            WHERE c.kind = 'status' AND c.error_type IS NULL) WHERE status = 'offline'
        UNION ALL SELECT device_id, 'DEVICE_FAILURE', offline_at, 0 FROM silences)""", """picks AS (
        SELECT device_id, event_type, min(t) AS t FROM src GROUP BY 1, 2
        UNION ALL
        SELECT * FROM (
            SELECT p.device_id, p.event_type, (SELECT min(s.t) FROM src s WHERE s.device_id = p.device_id AND s.event_type = p.event_type
                     AND s.t >= p.t + INTERVAL 300 SECOND) AS t FROM picks p)
        WHERE t IS NOT NULL)""") + """
    SELECT device_id, event_type, channel, count(*) AS alerts FROM picks, (VALUES ('console'), ('webhook')) AS c(channel) GROUP BY 1, 2, 3""", VIEWS)
def _(spark, sf):
    body = F.from_json("payload", "device_id STRING, event_type STRING")
    return streamed(spark, sf).scan("alert_outbox").select(body.alias("p"), "channel").groupBy("p.device_id", "p.event_type", "channel").agg(
        F.count("*").alias("alerts"))


@query("i8_registry", """
    WITH told AS (SELECT c.*, CASE c.kind WHEN 'status' THEN 0 ELSE 1 END AS k, s.firmware_version, s.status
                  FROM checked c LEFT JOIN status s ON s."offset" = c.id AND c.kind = 'status' WHERE c.error_type IS NULL AND c.kind <> 'events'),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY received_at, k, "offset") AS r FROM told),
    lasts AS (SELECT device_id, status, time, row_number() OVER (PARTITION BY device_id ORDER BY received_at DESC, "offset" DESC) AS r
              FROM told WHERE kind = 'status')
    SELECT f.device_id, f.firmware_version, CASE WHEN l.status IS NULL THEN 'unknown' WHEN l.status = 'maintenance' THEN 'maintenance' ELSE 'offline' END AS status,
           l.time AS last_seen_at, f.received_at AS created_at
    FROM firsts f LEFT JOIN lasts l ON l.device_id = f.device_id AND l.r = 1 WHERE f.r = 1""", VIEWS)
def _(spark, sf):
    table = device_table(_rows(spark, sf, "devices"))
    return table.select("device_id", "firmware_version", "status", "last_seen_at", "created_at")


@query("i14_running_totals", _with(VALID_SQL) + """
    SELECT * FROM (
        SELECT 'counter.messages.received' AS metric_name, CAST(count(*) + 1 AS DOUBLE) AS metric_value FROM checked
        UNION ALL SELECT 'counter.validation.failures', count(error_type) FROM checked
        UNION ALL SELECT 'counter.messages.' || kind, count(*) + CASE kind WHEN 'telemetry' THEN 1 ELSE 0 END FROM checked WHERE error_type IS NULL GROUP BY kind
        UNION ALL SELECT 'counter.readings.stored', count(*) + 1 FROM firsts)""", VIEWS)
def _(spark, sf):
    names = ["messages.received", "validation.failures", "messages.telemetry", "messages.status", "messages.events", "readings.stored"]
    rows = streamed(spark, sf).scan("system_metrics").where(F.col("metric_name").isin([f"counter.{n}" for n in names]))
    return rows.groupBy("metric_name").agg(F.max_by("metric_value", "batch").alias("metric_value"))


@query("i14_totals_grow", """
    SELECT DISTINCT 'counter.' || name AS metric_name, true AS grows FROM (VALUES ('messages.received'), ('readings.stored')) AS v(name), checked""", VIEWS)
def _(spark, sf):
    rows = streamed(spark, sf).scan("system_metrics").where(F.col("metric_name").isin("counter.messages.received", "counter.readings.stored"))
    values = rows.groupBy("metric_name").agg(F.array_sort(F.collect_list(F.struct("batch", "metric_value"))).alias("v"))  # a row per batch
    ordered = F.col("v.metric_value")
    return values.select("metric_name", (F.size(ordered) >= PARTS).__and__(ordered == F.sort_array(ordered)).__and__(ordered[0] < F.element_at(ordered, -1)).alias("grows"))


@query("i14_latencies", """
    SELECT 'latency.' || op || '.' || stat AS metric_name FROM (VALUES ('telemetry'), ('status'), ('events'), ('ml_inference')) AS o(op),
        (VALUES ('avg_ms'), ('p50_ms'), ('p95_ms'), ('p99_ms')) AS s(stat) WHERE (SELECT count(*) FROM checked) > 0""", VIEWS)
def _(spark, sf):
    return streamed(spark, sf).scan("system_metrics").where("metric_name LIKE 'latency.%' AND metric_value > 0").select("metric_name").distinct()


PREDICTED_SQL = f"predicted AS (SELECT *, {SCORE_SQL} AS score FROM valid WHERE temperature_c IS NOT NULL)"


@query("i12_predictions", _with(VALID_SQL, PREDICTED_SQL) + f"""
    SELECT time, device_id, round(score, 6) AS anomaly_score, CASE WHEN score > CAST({THRESHOLD!r} AS DOUBLE) THEN 'anomaly' ELSE 'normal' END AS predicted_label,
           model_version FROM predicted, (VALUES ('iforest_v1')) AS m(model_version) WHERE "offset" IN (SELECT "offset" FROM firsts)""", VIEWS)
def _(spark, sf):
    return _rows(spark, sf, "model_predictions").select("time", "device_id", F.round("anomaly_score", 6).alias("anomaly_score"), "predicted_label", "model_version")


@query("i12_model_events", _with(VALID_SQL, PREDICTED_SQL, f"src AS (SELECT * FROM predicted WHERE score > CAST({THRESHOLD!r} AS DOUBLE))", """picks AS (
        SELECT device_id, min(received_at) AS t FROM src GROUP BY 1
        UNION ALL
        SELECT * FROM (SELECT p.device_id, (SELECT min(s.received_at) FROM src s WHERE s.device_id = p.device_id
                     AND s.received_at >= p.t + INTERVAL 300 SECOND) AS t FROM picks p)
        WHERE t IS NOT NULL)""") + """
    SELECT device_id, t - INTERVAL 1 SECOND AS time, 'ML_ANOMALY' AS event_type, 'WARNING' AS severity FROM picks""", VIEWS)
def _(spark, sf):
    return _rows(spark, sf, "events").where("rule_name = 'ml_isolation_forest'").select("device_id", "time", "event_type", "severity")


def _verdict_sql(source: str, order: str = '"offset"') -> str:
    """Squared distance of the standardised features from their means over the window of eight."""
    features = ("voltage_v", "current_a", "power_w", "coalesce(temperature_c, 0)", "abs(voltage_v - 220)", "power_w - voltage_v * current_a")
    z = ", ".join(f"({f} - {_num(m)}) / {_num(s)} AS z{i}" for i, (f, m, s) in enumerate(zip(features, MEAN, STD, strict=True)))
    error = " + ".join(f"pow(z{i} - avg(z{i}) OVER w, 2)" for i in range(6))
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY {order}) - 1 AS k,
            count(*) OVER (PARTITION BY device_id) AS n FROM {source}),
    scaled AS (SELECT "offset", device_id, k // 8 AS window_id, {z} FROM numbered WHERE k < n - n % 8),
    judged AS (SELECT "offset", device_id, window_id, ({error}) / 6 AS e FROM scaled WINDOW w AS (PARTITION BY device_id, window_id))"""


def _num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


@query("i9_stream_verdicts", _with(VALID_SQL, _verdict_sql("valid")) + f"""
    SELECT device_id, window_id, "offset", round(e, 6) AS recon_error, e > {_num(CONFIRMED_ABOVE)} AS confirmed FROM judged""", VIEWS)
def _(spark, sf):
    return _rows(spark, sf, "verdicts").select("device_id", "window_id", "offset", F.round("recon_error", 6).alias("recon_error"), "confirmed")


@query("k6_fixed_verdicts", _with(_verdict_sql("arrivals")) + f"""
    SELECT device_id, window_id, "offset", round(e, 6) AS recon_error, e > {_num(CONFIRMED_ABOVE)} AS confirmed FROM judged""", ("arrivals",))
def _(spark, sf):
    return verifier.verdicts(fx.arrivals(spark, sf), window_means()).select(
        "device_id", "window_id", "offset", F.round("recon_error", 6).alias("recon_error"), "confirmed")


@query("k3_fixed_trees", f"""
    SELECT "offset", device_id, round({SCORE_SQL}, 9) AS anomaly_score, {SCORE_SQL} > {_num(THRESHOLD)} AS is_anomaly
    FROM arrivals WHERE temperature_c IS NOT NULL""", ("arrivals",))
def _(spark, sf):
    return forest.score(fx.arrivals(spark, sf), fixed_forest(spark)).where("anomaly_score IS NOT NULL").select(
        "offset", "device_id", F.round("anomaly_score", 9).alias("anomaly_score"), "is_anomaly")


@query("j5_delivered", """
    SELECT channel, 'sent' AS status, CAST(0 AS INTEGER) AS attempts, true AS all_delivered FROM (VALUES ('console'), ('webhook')) AS c(channel)
    WHERE (SELECT count(*) FROM checked) > 0""", VIEWS)
def _(spark, sf):
    """Every queued alert is delivered once: rounds of claim, delivery and settling until nothing is due."""
    store = streamed(spark, sf)
    job = AlertDelivery(store, lambda key, channel, payload: ("ok", None), Settings(outbox_batch_size=1_000_000))
    while job.tick("2024-01-02 00:00:00") is not None:
        pass
    sent = job.current().groupBy("channel", "status", "attempts").agg(F.count("*").alias("n"))
    told = store.scan("alert_deliveries").groupBy("channel").agg(F.count("*").alias("m"), F.countDistinct("event_id").alias("d"))
    return sent.join(told, "channel").select("channel", "status", "attempts", ((F.col("n") == F.col("m")) & (F.col("m") == F.col("d"))).alias("all_delivered"))

