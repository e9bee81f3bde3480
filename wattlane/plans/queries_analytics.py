"""Dashboard and API queries (aggregates, series, top-k, set operations)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import decimal_round, power_discrepancy, voltage_deviation
from ..operators import aggregates as agg
from ..operators import policy, series, waveform
from . import fixtures as fx
from .oracle_views import AS_OF_SQL, DEVICE_SQL, END_SQL, RANGE_SQL, START_SQL
from .registry import query

STATS_SQL = """round(avg(voltage_v), 6) AS avg_voltage_v, round(avg(current_a), 6) AS avg_current_a,
    round(avg(power_w), 6) AS avg_power_w, max(power_w) AS max_power_w,
    min(voltage_v) AS min_voltage_v, count(*) AS sample_count"""


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def ranged(df):
    return agg.in_range(df, fx.RANGE_START, fx.RANGE_END)


AVERAGES = ("avg_voltage_v", "avg_current_a", "avg_power_w")


@query("d1_device_buckets", f"""
    SELECT time_bucket(INTERVAL 5 MINUTE, time) AS bucket, {STATS_SQL} FROM telemetry
    WHERE device_id = {DEVICE_SQL} AND time >= {START_SQL} AND time < {END_SQL} GROUP BY 1""", ("telemetry",))
def _(spark, sf):
    return rounded(
        agg.device_buckets(fx.telemetry(spark, sf), fx.DEVICE, fx.RANGE_START, fx.RANGE_END, "5 minutes"), *AVERAGES
    )


@query("d1_week_buckets", f"""
    SELECT time_bucket(INTERVAL 7 DAY, time) AS bucket, device_id, {STATS_SQL}
    FROM telemetry GROUP BY 1, 2""", ("telemetry",))
def _(spark, sf):
    return rounded(
        fx.telemetry(spark, sf).groupBy(agg.bucket("time", "1 week").alias("bucket"), "device_id")
        .agg(*agg._reading_stats()), *AVERAGES
    )


@query("d2_minute_rollup", f"""
    SELECT time_bucket(INTERVAL 1 MINUTE, time) AS bucket, device_id, {STATS_SQL}
    FROM telemetry GROUP BY 1, 2""", ("telemetry",))
def _(spark, sf):
    return rounded(agg.minute_rollup(fx.telemetry(spark, sf)), *AVERAGES)


@query("d2_hour_from_minutes", f"""
    SELECT time_bucket(INTERVAL 1 HOUR, time) AS bucket, device_id, {STATS_SQL.replace(", 6)", ", 9)")}
    FROM telemetry GROUP BY 1, 2""", ("telemetry",))
def _(spark, sf):
    hours = agg.coarser_rollup(agg.minute_rollup(fx.telemetry(spark, sf)), "1 hour")
    return rounded(hours, *AVERAGES, digits=9)


@query("d3_load_per_minute", """
    SELECT time_bucket(INTERVAL 1 MINUTE, time) AS time, round(avg(power_w), 6) AS avg_power_w
    FROM telemetry GROUP BY 1""", ("telemetry",))
def _(spark, sf):
    return rounded(agg.load_per_minute(fx.telemetry(spark, sf)), "avg_power_w")


for _name, _column in (("d4_severity_per_minute", "severity"), ("d5_type_per_minute", "event_type")):
    @query(_name, f"""
        SELECT time_bucket(INTERVAL 1 MINUTE, time) AS time, {_column} AS metric, count(*) AS value
        FROM rule_events WHERE {RANGE_SQL} GROUP BY 1, 2""", ("rule_events",))
    def _(spark, sf, column=_column):
        return agg.count_per_minute(ranged(fx.rule_events(spark, sf)), column)


@query("d6_events_by_severity", f"""
    SELECT severity, count(*) AS count FROM rule_events WHERE time >= {START_SQL} GROUP BY 1""", ("rule_events",))
def _(spark, sf):
    return agg.count_by(fx.rule_events(spark, sf), "severity", fx.RANGE_START)


@query("d7_quality_by_type", f"""
    SELECT error_type, count(*) AS count FROM quality_logs WHERE time >= {START_SQL} GROUP BY 1""", ("quality_logs",))
def _(spark, sf):
    return agg.count_by(fx.quality_logs(spark, sf), "error_type", fx.RANGE_START)


@query("d8_quality_summary", """
    SELECT error_type, count(*) AS failures, count(DISTINCT device_id) AS affected_devices,
           max(time) AS latest_failure FROM quality_logs GROUP BY 1""", ("quality_logs",))
def _(spark, sf):
    return agg.quality_summary(fx.quality_logs(spark, sf))


@query("d9_event_summary", f"""
    SELECT event_type, severity, count(*) AS events, count(DISTINCT device_id) AS affected_devices,
           max(time) AS latest_event FROM rule_events WHERE {RANGE_SQL} GROUP BY 1, 2""", ("rule_events",))
def _(spark, sf):
    return agg.event_summary(ranged(fx.rule_events(spark, sf)))


@query("d10_affected_devices", f"""
    SELECT device_id, count(*) AS events, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical,
           count(*) FILTER (WHERE severity = 'WARNING') AS warning, max(time) AS latest_event
    FROM rule_events WHERE {RANGE_SQL} GROUP BY 1
    ORDER BY events DESC, latest_event DESC, device_id LIMIT 20""", ("rule_events",))
def _(spark, sf):
    return agg.affected_devices(ranged(fx.rule_events(spark, sf)))


@query("d11_most_common_type", f"""
    SELECT coalesce((SELECT event_type FROM rule_events WHERE {RANGE_SQL} GROUP BY event_type
                     ORDER BY count(*) DESC, event_type LIMIT 1), 'none') AS value""", ("rule_events",))
def _(spark, sf):
    return agg.most_common_type(ranged(fx.rule_events(spark, sf)))


@query("d12_event_counts", f"""
    SELECT count(*) AS events, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical,
           count(*) FILTER (WHERE severity = 'WARNING') AS warning,
           count(*) FILTER (WHERE NOT acknowledged) AS unacknowledged,
           count(*) FILTER (WHERE device_id = {DEVICE_SQL}) AS of_device
    FROM rule_events WHERE {RANGE_SQL}""", ("rule_events",))
def _(spark, sf):
    return agg.event_counts(ranged(fx.rule_events(spark, sf)), fx.DEVICE)


@query("d12_reading_count", f"SELECT count(*) AS value FROM telemetry WHERE {RANGE_SQL}", ("telemetry",))
def _(spark, sf):
    return ranged(fx.telemetry(spark, sf)).agg(F.count("*").alias("value"))


@query("d13_distinct_devices", f"""
    SELECT (SELECT count(DISTINCT device_id) FROM telemetry WHERE {RANGE_SQL}) AS devices, 'readings' AS source
    UNION ALL SELECT (SELECT count(DISTINCT device_id) FROM rule_events WHERE {RANGE_SQL}), 'events'
    """, ("telemetry", "rule_events"))
def _(spark, sf):
    one = agg.distinct_devices(ranged(fx.telemetry(spark, sf))).withColumn("source", F.lit("readings"))
    two = agg.distinct_devices(ranged(fx.rule_events(spark, sf))).withColumn("source", F.lit("events"))
    return one.unionByName(two)


@query("d14_average_voltage", f"""
    SELECT coalesce(CAST(round(CAST(avg(voltage_v) AS DECIMAL(38,10)), 2) AS DOUBLE), 0) AS value
    FROM telemetry WHERE {RANGE_SQL}""", ("telemetry",))
def _(spark, sf):
    return agg.average_voltage(ranged(fx.telemetry(spark, sf)))


@query("d15_age_minutes", f"""
    SELECT coalesce(round((epoch_us({AS_OF_SQL}) - epoch_us(max(time))) / 60000000.0, 2), 0) AS value,
           'newest' AS edge FROM telemetry WHERE device_id = {DEVICE_SQL}
    UNION ALL
    SELECT coalesce(round((epoch_us({AS_OF_SQL}) - epoch_us(min(time))) / 60000000.0, 2), 0), 'oldest'
    FROM system_metrics""", ("telemetry", "system_metrics"))
def _(spark, sf):
    mine = fx.telemetry(spark, sf).where(F.col("device_id") == fx.DEVICE)
    newest = agg.age_minutes(mine, fx.AS_OF).withColumn("edge", F.lit("newest"))
    oldest = agg.age_minutes(fx.system_metrics(spark, sf), fx.AS_OF, oldest=True)
    return newest.unionByName(oldest.withColumn("edge", F.lit("oldest")))


@query("d16_latest_total_load", f"""
    SELECT coalesce(round(sum(p), 2), 0) AS value
    FROM (SELECT arg_max(power_w, time) AS p FROM telemetry WHERE {RANGE_SQL} GROUP BY device_id)""", ("telemetry",))
def _(spark, sf):
    return agg.latest_total_load(ranged(fx.telemetry(spark, sf)))


@query("d17_outbox_summary", """
    SELECT channel, status, count(*) AS deliveries, max(updated_at) AS latest_update
    FROM outbox GROUP BY 1, 2""", ("outbox",))
def _(spark, sf):
    return agg.outbox_summary(fx.outbox(spark, sf))


@query("d17_pending", "SELECT count(*) AS value FROM outbox WHERE status = 'pending'", ("outbox",))
def _(spark, sf):
    return agg.pending_count(fx.outbox(spark, sf))


@query("d19_latency_summary", """
    SELECT operation, count(*) AS count, round(avg(value_ms), 6) AS avg_ms,
           list_sort(list(value_ms))[CAST(floor((count(*) - 1) * 0.50) AS INT) + 1] AS p50_ms,
           list_sort(list(value_ms))[CAST(floor((count(*) - 1) * 0.95) AS INT) + 1] AS p95_ms,
           list_sort(list(value_ms))[CAST(floor((count(*) - 1) * 0.99) AS INT) + 1] AS p99_ms
    FROM (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY "offset" DESC) AS k FROM latencies)
    WHERE k <= 10000 GROUP BY 1""", ("latencies",))
def _(spark, sf):
    return rounded(agg.latency_summary(fx.latencies(spark, sf), keep=10_000), "avg_ms")


@query("d23_prediction_summary", """
    SELECT CASE WHEN is_anomaly THEN 'anomaly' ELSE 'normal' END AS predicted_label, count(*) AS n,
           round(avg(anomaly_score), 4) AS avg_score, round(max(anomaly_score), 4) AS max_score
    FROM predictions GROUP BY 1""", ("predictions",))
def _(spark, sf):
    return agg.prediction_summary(fx.predictions(spark, sf))


@query("d24_confusion", """
    WITH c AS (SELECT count(*) FILTER (WHERE kind <> 'normal' AND is_anomaly) AS tp,
                      count(*) FILTER (WHERE kind = 'normal' AND is_anomaly) AS fp,
                      count(*) FILTER (WHERE kind <> 'normal' AND NOT is_anomaly) AS fn,
                      count(*) FILTER (WHERE kind = 'normal' AND NOT is_anomaly) AS tn FROM predictions)
    SELECT tp, fp, fn, tn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall,
           round(2.0 * tp / (2 * tp + fp + fn), 4) AS f1, round(fp / (fp + tn), 4) AS false_positive_rate
    FROM c""", ("predictions",))
def _(spark, sf):
    return agg.confusion(fx.predictions(spark, sf), F.col("kind") != "normal", F.col("is_anomaly"))


@query("d25_recall_by_kind", """
    SELECT kind, count(*) AS count, round(avg(CASE WHEN is_anomaly THEN 1.0 ELSE 0.0 END), 4) AS edge_recall
    FROM predictions WHERE kind <> 'normal' GROUP BY 1""", ("predictions",))
def _(spark, sf):
    return agg.recall_by_kind(fx.predictions(spark, sf), {"edge_recall": F.col("is_anomaly")})


@query("d26_operating_points", """
    WITH cuts AS (SELECT q AS quantile, (SELECT quantile_cont(anomaly_score, [0.90, 0.95, 0.975, 0.99])
                         FROM predictions WHERE kind = 'normal')[i] AS cut
                  FROM (VALUES (1, CAST(0.90 AS DOUBLE)), (2, 0.95), (3, 0.975), (4, 0.99)) AS t(i, q))
    SELECT quantile, round(cut, 4) AS threshold,
           round(count(*) FILTER (WHERE kind = 'normal' AND anomaly_score > cut)
                 / count(*) FILTER (WHERE kind = 'normal'), 4) AS fpr,
           round(count(*) FILTER (WHERE kind <> 'normal' AND anomaly_score > cut)
                 / count(*) FILTER (WHERE kind <> 'normal'), 4) AS recall
    FROM predictions, cuts GROUP BY quantile, cut""", ("predictions",))
def _(spark, sf):
    return agg.operating_points(fx.predictions(spark, sf))


@query("d28_arm_means", """
    WITH m AS (SELECT avg(value_ms) FILTER (WHERE operation = 'view') AS a,
                      avg(value_ms) FILTER (WHERE operation = 'click') AS b FROM latencies)
    SELECT round(a, 4) AS view, round(b, 4) AS click, round(b - a, 4) AS delta FROM m""", ("latencies",))
def _(spark, sf):
    return agg.arm_means(fx.latencies(spark, sf), "operation", ("view", "click"), "value_ms")


# Samples are integers, so both engines work on exact sums.
WINDOW_SQL = """SELECT device_id, window_id, sqrt(n * svv - sv * sv) / n * CAST(0.35 AS DOUBLE) AS voltage_v,
           sqrt(n * sii - si * si) / n * CAST(0.05 AS DOUBLE) AS current_a,
           (n * svi - sv * si) / (n * n) * CAST(0.35 AS DOUBLE) * CAST(0.05 AS DOUBLE) AS power_w
    FROM (SELECT device_id, window_id, CAST(count(*) AS DOUBLE) AS n, CAST(sum(v_raw) AS DOUBLE) AS sv,
                 CAST(sum(i_raw) AS DOUBLE) AS si, CAST(sum(v_raw * v_raw) AS DOUBLE) AS svv,
                 CAST(sum(i_raw * i_raw) AS DOUBLE) AS sii, CAST(sum(v_raw * i_raw) AS DOUBLE) AS svi
          FROM waveform GROUP BY 1, 2)"""


@query("d31_window_metrics", f"""
    WITH w AS ({WINDOW_SQL})
    SELECT *, voltage_v * current_a AS apparent_va,
           CASE WHEN voltage_v * current_a > 1e-6 THEN power_w / (voltage_v * current_a) ELSE 0 END
               AS power_factor FROM w""", ("waveform",))
def _(spark, sf):
    return waveform.window_metrics(fx.waveform(spark, sf), 0.35, 0.05)


@query("d32_publish_average", f"""
    WITH w AS ({WINDOW_SQL})
    SELECT device_id, window_id // 1000 AS period, round(avg(voltage_v), 6) AS voltage_v,
           round(avg(current_a), 6) AS current_a, round(avg(power_w), 6) AS power_w, count(*) AS windows
    FROM w GROUP BY 1, 2""", ("waveform",))
def _(spark, sf):
    metrics = waveform.window_metrics(fx.waveform(spark, sf), 0.35, 0.05)
    return rounded(
        waveform.publish_average(metrics, "device_id", "window_id", 1000), "voltage_v", "current_a", "power_w"
    )


@query("d33_totals_by_severity", "SELECT severity, count(*) AS count FROM rule_events GROUP BY 1", ("rule_events",))
def _(spark, sf):
    return agg.run_totals(fx.rule_events(spark, sf), ["severity"])


@query("d33_totals_by_type", """
    SELECT event_type, severity, count(*) AS count FROM rule_events GROUP BY 1, 2""", ("rule_events",))
def _(spark, sf):
    return agg.run_totals(fx.rule_events(spark, sf), ["event_type", "severity"])


@query("e2_counter_rate", f"""
    SELECT time, round(greatest(metric_value - pv, 0) / greatest(epoch(time) - epoch(pt), 1) * 60, 6)
                 AS messages_per_minute
    FROM (SELECT time, metric_value, lag(metric_value) OVER (ORDER BY time) AS pv,
                 lag(time) OVER (ORDER BY time) AS pt FROM system_metrics WHERE {RANGE_SQL})
    WHERE pv IS NOT NULL""", ("system_metrics",))
def _(spark, sf):
    rows = ranged(fx.system_metrics(spark, sf))
    return rounded(series.counter_rate(rows, "counter.messages.received", "messages_per_minute"), "messages_per_minute")


@query("e3_latest_by_device", """
    SELECT device_id, max(time) AS last_seen, round(arg_max(voltage_v, time), 2) AS voltage_v,
           CAST(round(CAST(arg_max(current_a, time) AS DECIMAL(38,10)), 2) AS DOUBLE) AS current_a,
           CAST(round(CAST(arg_max(power_w, time) AS DECIMAL(38,10)), 2) AS DOUBLE) AS power_w,
           round(arg_max(ROW(temperature_c), time)[1], 2) AS temperature_c
    FROM telemetry GROUP BY 1""", ("telemetry",))
def _(spark, sf):
    return series.latest_by_device(fx.telemetry(spark, sf))


@query("e4_latest_value", f"""
    SELECT 'metric' AS source, (SELECT coalesce(arg_max(metric_value, time), 0) FROM system_metrics
                                WHERE metric_name = 'counter.messages.received') AS value
    UNION ALL
    SELECT 'power', (SELECT coalesce(CAST(round(CAST(arg_max(power_w, time) AS DECIMAL(38,10)), 2) AS DOUBLE), 0)
                     FROM telemetry WHERE device_id = {DEVICE_SQL})
    UNION ALL SELECT 'missing', CAST(0 AS DOUBLE)""", ("system_metrics", "telemetry"))
def _(spark, sf):
    metrics = fx.system_metrics(spark, sf)
    mine = fx.telemetry(spark, sf).where(F.col("device_id") == fx.DEVICE)
    parts = (
        ("metric", series.latest_value(metrics.where("metric_name = 'counter.messages.received'"), "metric_value")),
        ("power", series.latest_value(mine, "power_w", rounded=True)),
        ("missing", series.latest_value(metrics.where("metric_name = 'counter.none'"), "metric_value")),
    )
    out = [df.select(F.lit(n).alias("source"), "value") for n, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("f1_devices", """
    SELECT device_id, device_type, status FROM stored_devices ORDER BY device_id LIMIT 500""", ("stored_devices",))
def _(spark, sf):
    return series.list_devices(fx.stored_devices(spark, sf)).select("device_id", "device_type", "status")


@query("f2_newest_readings", f"""
    SELECT sequence_no, time, voltage_v, power_w FROM telemetry WHERE device_id = {DEVICE_SQL}
    ORDER BY time DESC, sequence_no LIMIT 50""", ("telemetry",))
def _(spark, sf):
    rows = series.filter_readings(fx.telemetry(spark, sf), fx.DEVICE)
    return series.newest_first(rows, 50, 5000, "sequence_no").select("sequence_no", "time", "voltage_v", "power_w")


@query("f2_newest_status", f"""
    SELECT "offset", time, status, rssi_dbm FROM status WHERE device_id = {DEVICE_SQL}
    ORDER BY time DESC, "offset" LIMIT 50""", ("status",))
def _(spark, sf):
    rows = fx.status(spark, sf).where(F.col("device_id") == fx.DEVICE)
    return series.newest_first(rows, 50, 500, "offset").select("offset", "time", "status", "rssi_dbm")


@query("f3_latest_reading", f"""
    SELECT sequence_no, time, device_id, voltage_v, current_a, power_w, temperature_c FROM telemetry
    WHERE device_id = {DEVICE_SQL} ORDER BY time DESC LIMIT 1""", ("telemetry",))
def _(spark, sf):
    return series.newest_first(series.filter_readings(fx.telemetry(spark, sf), fx.DEVICE), 1, 1)


@query("f4_recent_events", """
    SELECT time, device_id, event_type, severity, rule_name,
           CAST(round(CAST(event_value AS DECIMAL(38,10)), 2) AS DOUBLE) AS event_value,
           threshold_value, acknowledged
    FROM rule_events ORDER BY time DESC, "offset", rule_name LIMIT 100""", ("rule_events",))
def _(spark, sf):
    return series.recent_events(fx.rule_events(spark, sf))


@query("f6_recent_arrivals", """
    SELECT * FROM (SELECT "offset", device_id, anomaly_score FROM predictions WHERE is_anomaly
                   ORDER BY "offset" DESC LIMIT 50)""", ("predictions",))
def _(spark, sf):
    rows = policy.escalation_gate(fx.predictions(spark, sf), "gated")
    return series.recent_arrivals(rows.select("offset", "device_id", "anomaly_score"))


@query("g1_type_choices", """
    SELECT 'ALL' AS value UNION SELECT event_type FROM rule_events""", ("rule_events",))
def _(spark, sf):
    return series.with_all(fx.rule_events(spark, sf), "event_type")


@query("g2_device_names", "SELECT DISTINCT device_id FROM telemetry", ("telemetry",))
def _(spark, sf):
    return series.device_names(fx.telemetry(spark, sf))


@query("g3_power_with_markers", f"""
    SELECT time, 'power_w' AS metric, power_w AS value FROM telemetry
    WHERE device_id = {DEVICE_SQL} AND {RANGE_SQL}
    UNION ALL SELECT time, event_type, coalesce(event_value, 0) FROM rule_events
    WHERE device_id = {DEVICE_SQL} AND {RANGE_SQL}""", ("telemetry", "rule_events"))
def _(spark, sf):
    readings = series.filter_readings(fx.telemetry(spark, sf), fx.DEVICE, fx.RANGE_START, fx.RANGE_END)
    events = series.filter_events(
        fx.rule_events(spark, sf), device=fx.DEVICE, start=fx.RANGE_START, end=fx.RANGE_END
    )
    return series.power_with_markers(readings, events)


# Counts observed in one published run.
OBSERVED = """VALUES ('OVERLOAD', 'CRITICAL', 284), ('DEVICE_FAILURE', 'CRITICAL', 12), ('POWER_SPIKE', 'WARNING', 430),
    ('UNDER_VOLTAGE', 'WARNING', 31), ('OVER_VOLTAGE', 'WARNING', 14), ('VOLTAGE_ANOMALY', 'INFO', 31)"""


@query("g5_observed_against_events", f"""
    SELECT o.event_type, o.severity, o.observed_count, coalesce(e.n, 0) AS events
    FROM ({OBSERVED}) AS o(event_type, severity, observed_count)
    LEFT JOIN (SELECT event_type, severity, count(*) AS n FROM rule_events GROUP BY 1, 2) e
      ON e.event_type = o.event_type AND e.severity = o.severity""", ("rule_events",))
def _(spark, sf):
    observed = spark.sql(f"SELECT * FROM ({OBSERVED}) AS t(event_type, severity, observed_count)")
    counts = agg.run_totals(fx.rule_events(spark, sf), ["event_type", "severity"])
    return observed.join(counts, ["event_type", "severity"], "left").select(
        "event_type", "severity", "observed_count", F.coalesce("count", F.lit(0)).alias("events")
    )


@query("h4_physics_features", """
    SELECT sequence_no, round(abs(voltage_v - 220), 6) AS voltage_deviation,
           round(power_w - voltage_v * current_a, 6) AS power_discrepancy FROM telemetry""", ("telemetry",))
def _(spark, sf):
    return fx.telemetry(spark, sf).select(
        "sequence_no", F.round(voltage_deviation("voltage_v"), 6).alias("voltage_deviation"),
        F.round(power_discrepancy("power_w", "voltage_v", "current_a"), 6).alias("power_discrepancy"),
    )


@query("h7_time_buckets", """
    SELECT sequence_no, time_bucket(INTERVAL 1 MINUTE, time) AS minute,
           time_bucket(INTERVAL 15 MINUTE, time) AS quarter_hour, time_bucket(INTERVAL 7 DAY, time) AS week,
           date_trunc('month', time) AS month FROM telemetry""", ("telemetry",))
def _(spark, sf):
    return fx.telemetry(spark, sf).select(
        "sequence_no", *[agg.bucket("time", i).alias(n) for n, i in (
            ("minute", "1 minute"), ("quarter_hour", "15 minutes"), ("week", "1 week"), ("month", "1 month"))]
    )


@query("h5_display_rounding", """
    SELECT sequence_no, CAST(round(CAST(current_a AS DECIMAL(38,10)), 2) AS DOUBLE) AS current_a,
           coalesce(temperature_c, 0) AS temperature_c FROM telemetry""", ("telemetry",))
def _(spark, sf):
    return fx.telemetry(spark, sf).select(
        "sequence_no", decimal_round("current_a").alias("current_a"),
        F.coalesce("temperature_c", F.lit(0.0)).alias("temperature_c"),
    )
