"""Sources, validation, policies, joins, rules and outbox queries."""
from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import aggregates as agg
from ..operators import devices, ingest, outbox, policy, rules, series, validate
from ..session import cut_lineage, stored_once
from ..settings import Settings
from ..sources.rules_config import rules_frame, shipped_rules
from . import fixtures as fx
from .oracle_views import AS_OF_SQL, DEVICE_SQL, END_SQL, RANGE_SQL
from .registry import query

SETTINGS = Settings(alert_channels=fx.CHANNELS)


def checked(spark, sf):
    return validate.validate_messages(validate.route(fx.messages(spark, sf)))


@query("a2_append_readings", """
    SELECT "offset", time, device_id, voltage_v FROM duplicates d
    WHERE "offset" = (SELECT min("offset") FROM duplicates e
                      WHERE e.time = d.time AND e.device_id = d.device_id)
      AND sequence_no % 10 <> 0""", ("duplicates",))
def _(spark, sf):
    held = fx.arrivals(spark, sf).where("sequence_no % 10 = 0")
    rows = fx.duplicates(spark, sf).select("offset", "time", "device_id", "voltage_v")
    return ingest.insert_if_absent(held, rows, ("time", "device_id"), "offset")


@query("a4_dead_letters", """
    SELECT "offset", time, device_id, error_type FROM quality_logs""", ("quality_logs",))
def _(spark, sf):
    return fx.quality_logs(spark, sf).select("offset", "time", "device_id", "error_type")


@query("a5_status_history", """
    SELECT time, device_id, status, firmware_version, ip_address, rssi_dbm,
           CASE WHEN reason IS NOT NULL THEN '{"reason":"' || reason || '"}' END AS metadata
    FROM status""", ("status",))
def _(spark, sf):
    return ingest.status_history(fx.status(spark, sf)).drop("id")


@query("a6_append_predictions", """
    SELECT time, device_id, model_version, anomaly_score FROM predictions WHERE sequence_no % 7 <> 0""",
       ("predictions",))
def _(spark, sf):
    rows = fx.predictions(spark, sf).select(
        "sequence_no", "offset", "time", "device_id", "model_version",
        F.lit("anomaly").alias("prediction_type"), "anomaly_score",
    )
    keys = ("time", "device_id", "model_version", "prediction_type")
    held = rows.where("sequence_no % 7 = 0")
    return ingest.insert_if_absent(held, rows.drop("sequence_no"), keys, "offset").select(
        "time", "device_id", "model_version", "anomaly_score"
    )


@query("a7_metric_rows", f"""
    SELECT {AS_OF_SQL} AS time, 'counter.events.type.' || lower(event_type) AS metric_name,
           CAST(count(*) AS DOUBLE) AS metric_value,
           '{{"kind":"counter","name":"events.type.' || lower(event_type) || '"}}' AS labels
    FROM rule_events GROUP BY event_type
    UNION ALL
    SELECT {AS_OF_SQL}, 'latency.' || operation || '.' || stat, round(value, 6),
           '{{"kind":"latency","operation":"' || operation || '","stat":"' || stat || '"}}'
    FROM (SELECT operation, avg(value_ms) AS avg_ms,
                 list_sort(list(value_ms))[CAST(floor((count(*) - 1) * 0.50) AS INT) + 1] AS p50_ms,
                 list_sort(list(value_ms))[CAST(floor((count(*) - 1) * 0.95) AS INT) + 1] AS p95_ms,
                 list_sort(list(value_ms))[CAST(floor((count(*) - 1) * 0.99) AS INT) + 1] AS p99_ms
          FROM (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY "offset" DESC) AS k FROM latencies)
          WHERE k <= 10000 GROUP BY 1)
    UNPIVOT (value FOR stat IN (avg_ms, p50_ms, p95_ms, p99_ms))""", ("rule_events", "latencies"))
def _(spark, sf):
    counters = fx.rule_events(spark, sf).groupBy(
        F.concat(F.lit("events.type."), F.lower("event_type")).alias("name")
    ).agg(F.count("*").alias("value"))
    stats = agg.latency_summary(fx.latencies(spark, sf))
    return ingest.metric_rows(counters, stats, fx.AS_OF).withColumn("metric_value", F.round("metric_value", 6))


@query("a9_upsert_devices", """
    SELECT device_id, d.location, coalesce(d.device_type, 'energy_node') AS device_type,
           CASE WHEN d.device_id IS NOT NULL THEN d.firmware_version ELSE n.fw END AS firmware_version,
           coalesce(d.status, 'unknown') AS status, d.device_id IS NULL AS inserted
    FROM stored_devices d FULL JOIN (
        SELECT device_id, arg_min(firmware_version, "offset") AS fw FROM status GROUP BY 1) n USING (device_id)
    """, ("stored_devices", "status"))
def _(spark, sf):
    out = devices.upsert_devices(fx.stored_devices(spark, sf), fx.status(spark, sf), fx.AS_OF)
    return out.select(
        "device_id", "location", "device_type", "firmware_version", "status",
        (F.col("created_at") == F.lit(fx.AS_OF).cast("timestamp")).alias("inserted"),
    )


@query("a10_device_status", """
    SELECT device_id, coalesce(n.s, d.status) AS status, coalesce(n.t, d.last_seen_at) AS last_seen_at
    FROM stored_devices d FULL JOIN (
        SELECT device_id, arg_max(status, "offset") AS s, arg_max(time, "offset") AS t FROM status GROUP BY 1) n
        USING (device_id)""", ("stored_devices", "status"))
def _(spark, sf):
    out = devices.apply_status(fx.stored_devices(spark, sf), fx.status(spark, sf), fx.AS_OF)
    return out.select("device_id", "status", "last_seen_at")


@query("a11_upsert_rules", """
    SELECT coalesce(r.rule_name, u.rule_name) AS rule_name, coalesce(u.severity, r.severity) AS severity,
           coalesce(u.enabled, TRUE) AS enabled
    FROM (SELECT rule_name, severity FROM rule_list UNION ALL SELECT 'power_spike', 'WARNING') r
    FULL JOIN (SELECT event_type AS rule_name, arg_max(severity, "offset") AS severity, FALSE AS enabled
               FROM (SELECT CASE event_type WHEN 'USER_PURCHASE' THEN 'overload' END AS event_type,
                            severity, "offset" FROM device_events) GROUP BY 1) u
      ON u.rule_name = r.rule_name""", ("rule_list", "device_events"))
def _(spark, sf):
    stored = rules_frame(spark, shipped_rules())
    updates = fx.device_events(spark, sf).select(
        F.when(F.col("event_type") == "USER_PURCHASE", "overload").alias("rule_name"),
        F.lit(False).alias("enabled"), "event_type", "severity", F.lit("{}").alias("config"),
        F.col("offset").alias("version"),
    )
    return devices.upsert_rules(stored, updates).select("rule_name", "severity", "enabled")


@query("b1_parse_topics", """
    SELECT CAST("offset" AS BIGINT) AS "offset", device_id AS topic_device,
           CASE WHEN id % 50 = 29 THEN 'commands' ELSE kind END AS message_type
    FROM (SELECT sequence_no * 2 AS "offset", sequence_no AS id, device_id, 'telemetry' AS kind FROM telemetry
          UNION ALL SELECT "offset" * 2 + 1, "offset", device_id, 'status' FROM status
          UNION ALL SELECT "offset" * 2 + 1, "offset", device_id, 'events' FROM device_events)
    WHERE id % 50 <> 31""", ("telemetry", "status", "device_events"))
def _(spark, sf):
    return validate.parse_topic(fx.messages(spark, sf)).select("offset", "topic_device", "message_type")


@query("b2_route", 'SELECT kind AS message_type, count(*) AS messages FROM checked GROUP BY 1', ("checked",))
def _(spark, sf):
    routed = validate.route(fx.messages(spark, sf))
    return routed.groupBy("message_type").agg(F.count("*").alias("messages"))


@query("b3_invalid_json", """
    SELECT "offset" FROM checked WHERE error_type = 'invalid_json'""", ("checked",))
def _(spark, sf):
    return checked(spark, sf).where("error_type = 'invalid_json'").select("offset")


@query("b4_unsupported_version", """
    SELECT "offset" FROM checked WHERE error_type = 'unsupported_schema_version'""", ("checked",))
def _(spark, sf):
    return checked(spark, sf).where("error_type = 'unsupported_schema_version'").select("offset")


@query("b5_schema_errors", """
    SELECT "offset", 'power_w' AS error_field FROM checked WHERE error_type = 'schema_validation_error'""",
       ("checked",))
def _(spark, sf):
    return checked(spark, sf).where("error_type = 'schema_validation_error'").select("offset", "error_field")


@query("b5_valid_readings", """
    SELECT c."offset", t.time, t.device_id, t.voltage_v, t.current_a, t.power_w, t.temperature_c, t.sequence_no
    FROM checked c JOIN telemetry t ON t.sequence_no = c.id
    WHERE c.kind = 'telemetry' AND c.error_type IS NULL""", ("checked", "telemetry"))
def _(spark, sf):
    return validate.valid_readings(checked(spark, sf)).select(
        "offset", "time", "device_id", "voltage_v", "current_a", "power_w", "temperature_c", "sequence_no"
    )


@query("b6_valid_status", """
    SELECT c."offset", s.time, s.device_id, s.status, s.ip_address, s.rssi_dbm, s.reason
    FROM checked c JOIN status s ON s."offset" = c.id
    WHERE c.kind = 'status' AND c.error_type IS NULL""", ("checked", "status"))
def _(spark, sf):
    return validate.valid_status(checked(spark, sf)).select(
        "offset", "time", "device_id", "status", "ip_address", "rssi_dbm", "reason"
    )


@query("b7_valid_device_events", """
    SELECT c."offset", e.device_id, e.event_type, e.severity, e.message
    FROM checked c JOIN device_events e ON e."offset" = c.id
    WHERE c.kind = 'events' AND c.error_type IS NULL""", ("checked", "device_events"))
def _(spark, sf):
    return validate.valid_device_events(checked(spark, sf)).select(
        "offset", "device_id", "event_type", "severity", "message"
    )


@query("b8_device_mismatch", """
    SELECT "offset", device_id AS topic_device FROM checked WHERE error_type = 'device_id_mismatch'""", ("checked",))
def _(spark, sf):
    return checked(spark, sf).where("error_type = 'device_id_mismatch'").select("offset", "topic_device")


@query("b9_out_of_range", """
    SELECT "offset", 'voltage_v=999.0 outside [0.0, 300.0]' AS error_message
    FROM checked WHERE error_type = 'voltage_out_of_range'""", ("checked",))
def _(spark, sf):
    return checked(spark, sf).where(F.col("error_type").endswith("_out_of_range")).select("offset", "error_message")


@query("b10_clock_skew", """
    SELECT "offset", 'timestamp 7199.0s in the future' AS error_message
    FROM checked WHERE error_type = 'timestamp_future_skew'""", ("checked",))
def _(spark, sf):
    return checked(spark, sf).where(F.col("error_type").startswith("timestamp_")).select("offset", "error_message")


@query("b11_classification", """
    SELECT "offset", kind AS message_type, error_type FROM checked""", ("checked",))
def _(spark, sf):
    return checked(spark, sf).select("offset", "message_type", "error_type")


@query("b12_filter_readings", f"""
    SELECT sequence_no, time FROM telemetry WHERE device_id = {DEVICE_SQL} AND {RANGE_SQL}""", ("telemetry",))
def _(spark, sf):
    return series.filter_readings(fx.telemetry(spark, sf), fx.DEVICE, fx.RANGE_START, fx.RANGE_END).select(
        "sequence_no", "time"
    )


@query("b13_filter_events", f"""
    SELECT "offset", rule_name, device_id FROM rule_events
    WHERE event_type = 'OVERLOAD' AND severity = 'CRITICAL' AND {RANGE_SQL}""", ("rule_events",))
def _(spark, sf):
    return series.filter_events(
        fx.rule_events(spark, sf), event_type="OVERLOAD", severity="CRITICAL", start=fx.RANGE_START, end=fx.RANGE_END
    ).select("offset", "rule_name", "device_id")


@query("b14_wildcard_events", f"""
    SELECT "offset", rule_name, severity FROM rule_events WHERE severity = 'WARNING' AND {RANGE_SQL}""",
       ("rule_events",))
def _(spark, sf):
    return series.wildcard_events(
        fx.rule_events(spark, sf), fx.RANGE_START, fx.RANGE_END, severity="WARNING"
    ).select("offset", "rule_name", "severity")


@query("b15_lookup", f"""
    SELECT device_id, location, status FROM stored_devices WHERE device_id = 'house_0009'""", ("stored_devices",))
def _(spark, sf):
    return series.lookup(fx.stored_devices(spark, sf), device_id="house_0009").select("device_id", "location", "status")


POLICIES = {
    "raw": Settings(storage_policy="raw"),
    "hybrid": Settings(storage_policy="hybrid", store_raw_readings=False),
    "event_only": Settings(storage_policy="event_only"),
    "aggregate_only": Settings(storage_policy="aggregate_only"),
    "baseline": Settings(processing_mode="baseline", storage_policy="event_only"),
}
FIRED_SQL = """SELECT *, "offset" IN (SELECT "offset" FROM rule_events) AS fired FROM arrivals"""


@query("b16_storage_decision", f"""
    WITH r AS ({FIRED_SQL})
    SELECT 'raw' AS policy, 'policy_raw' AS reason, TRUE AS store_raw, count(*) AS readings FROM r
    UNION ALL SELECT 'hybrid', CASE WHEN fired THEN 'policy_hybrid_store' ELSE 'policy_hybrid_skip' END, fired, count(*)
    FROM r GROUP BY fired
    UNION ALL SELECT 'event_only', CASE WHEN fired THEN 'policy_event_only_event' ELSE 'policy_event_only_skip' END,
                     fired, count(*) FROM r GROUP BY fired
    UNION ALL SELECT 'aggregate_only', 'policy_aggregate_only_skip', FALSE, count(*) FROM r
    UNION ALL SELECT 'baseline', 'baseline_forces_raw', TRUE, count(*) FROM r""", ("rule_events", "arrivals"))
def _(spark, sf):
    readings = policy.mark_triggering(fx.arrivals(spark, sf), fx.rule_events(spark, sf))
    fired = readings.groupBy("event_triggering").agg(F.count("*").alias("n"))
    out = None
    for name, settings in POLICIES.items():
        part = policy.storage_decision(fired, settings).groupBy(
            F.lit(name).alias("policy"), "reason", "store_raw"
        ).agg(F.sum("n").alias("readings"))
        out = part if out is None else out.unionByName(part)
    return out


@query("b17_retention", f"""
    SELECT sequence_no FROM telemetry WHERE time >= {AS_OF_SQL} - INTERVAL 1 HOUR""", ("telemetry",))
def _(spark, sf):
    return policy.retain(fx.telemetry(spark, sf), fx.AS_OF, 1 / 24).select("sequence_no")


@query("b18_outbox_retention", f"""
    SELECT outbox_id, status FROM outbox
    WHERE NOT (created_at < {AS_OF_SQL} - INTERVAL 1 HOUR AND status IN ('sent', 'discarded'))""", ("outbox",))
def _(spark, sf):
    return policy.retain_outbox(fx.outbox(spark, sf), fx.AS_OF, 1 / 24).select("outbox_id", "status")


@query("b19_escalation_gate", """
    SELECT 'all' AS arm, count(*) AS readings FROM predictions
    UNION ALL SELECT 'flagged', count(*) FROM predictions WHERE is_anomaly
    UNION ALL SELECT 'override', count(*) FROM predictions WHERE anomaly_score >= 0.7
    UNION ALL SELECT 'off', 0""", ("predictions",))
def _(spark, sf):
    scored = fx.predictions(spark, sf)
    arms = {
        "all": policy.escalation_gate(scored, "all"),
        "flagged": policy.escalation_gate(scored, "gated"),
        "override": policy.escalation_gate(scored, "gated", 0.7),
        "off": policy.escalation_gate(scored, "off"),
    }
    out = None
    for name, df in arms.items():
        part = df.agg(F.lit(name).alias("arm"), F.count("*").alias("readings"))
        out = part if out is None else out.unionByName(part)
    return out


@query("b20_alert_policy", """
    SELECT "offset", event_type FROM rule_events WHERE severity = 'CRITICAL'""", ("rule_events",))
def _(spark, sf):
    return policy.alertable(fx.rule_events(spark, sf)).select("offset", "event_type")


@query("b21_reading_response", f"""
    SELECT strftime(time, '%Y-%m-%dT%H:%M:%S') ||
           CASE WHEN epoch_us(time) % 1000000 = 0 THEN '' ELSE strftime(time, '.%f') END || '+00:00' AS time,
           device_id, voltage_v, sequence_no FROM telemetry""", ("telemetry",))
def _(spark, sf):
    return series.response(fx.telemetry(spark, sf), "reading").select("time", "device_id", "voltage_v", "sequence_no")


@query("b21_device_response", """
    SELECT device_id, location, device_type, firmware_version, status, CAST(NULL AS VARCHAR) AS last_seen_at,
           '2023-12-31T00:00:00+00:00' AS created_at, '2023-12-31T00:00:00+00:00' AS updated_at
    FROM stored_devices""", ("stored_devices",))
def _(spark, sf):
    return series.response(fx.stored_devices(spark, sf), "device")


@query("b21_event_response", f"""
    SELECT strftime(time, '%Y-%m-%dT%H:%M:%S') ||
           CASE WHEN epoch_us(time) % 1000000 = 0 THEN '' ELSE strftime(time, '.%f') END || '+00:00' AS time,
           device_id, event_type, severity, rule_name, event_value, threshold_value, acknowledged
    FROM rule_events WHERE {RANGE_SQL}""", ("rule_events",))
def _(spark, sf):
    rows = series.filter_events(fx.rule_events(spark, sf), start=fx.RANGE_START, end=fx.RANGE_END)
    return series.response(rows, "event").drop("event_id", "message", "reading_time", "metadata")


@query("b22_acknowledge", """
    SELECT "offset", rule_name, acknowledged OR "offset" % 5 = 0 AS acknowledged FROM rule_events""", ("rule_events",))
def _(spark, sf):
    events = fx.rule_events(spark, sf)
    ids = events.where("offset % 5 = 0").select("offset")
    return series.acknowledge(events, ids, "offset").select("offset", "rule_name", "acknowledged")


@query("b23_rule_admin", """
    SELECT rule_name, event_type, rule_name <> 'overload' AS enabled, count(e."offset") AS hits
    FROM (SELECT rule_name, event_type FROM rule_list UNION ALL SELECT 'power_spike', 'POWER_SPIKE') r
    LEFT JOIN (SELECT rule_name, "offset" FROM rule_events) e USING (rule_name) GROUP BY 1, 2, 3""",
       ("rule_list", "rule_events"))
def _(spark, sf):
    listed = devices.set_rule_enabled(rules_frame(spark, shipped_rules()), "overload", False)
    hits = fx.rule_events(spark, sf).groupBy("rule_name").agg(F.count("*").alias("hits"))
    return listed.join(hits, "rule_name", "left").select(
        "rule_name", "event_type", "enabled", F.coalesce("hits", F.lit(0)).alias("hits")
    ).orderBy("rule_name")


@query("b24_raw_series", f"""
    SELECT time, temperature_c FROM telemetry WHERE device_id = {DEVICE_SQL} AND {RANGE_SQL}""", ("telemetry",))
def _(spark, sf):
    return series.raw_series(fx.telemetry(spark, sf), fx.DEVICE, "temperature_c", fx.RANGE_START, fx.RANGE_END)


@query("b25_latency_series", """
    SELECT time, metric, round(value, 6) AS value FROM (
        SELECT date_trunc('minute', time) AS time, avg(value) AS a, max(value) AS b FROM stamped GROUP BY 1)
    UNPIVOT (value FOR metric IN (a AS 'avg_ms', b AS 'p99_ms'))""", ("stamped",))
def _(spark, sf):
    per_minute = fx._stamped(spark, sf).groupBy(F.date_trunc("minute", "time").alias("time")).agg(
        F.avg("value").alias("latency.telemetry.avg_ms"), F.max("value").alias("latency.telemetry.p99_ms"),
        F.min("value").alias("latency.status.p99_ms"),
    )
    names = [F.col(f"`{c}`") for c in per_minute.columns if c != "time"]
    metrics = per_minute.unpivot(["time"], names, "metric_name", "metric_value")
    return series.latency_series(metrics, "telemetry", "2023-01-01", "2025-01-01").withColumn(
        "value", F.round("value", 6)
    )


@query("c1_insert_if_absent", """
    SELECT "offset", channel FROM (SELECT DISTINCT event_id AS "offset", channel FROM outbox)
    WHERE ("offset", channel) NOT IN (SELECT (event_id, channel) FROM outbox WHERE status = 'sent')""", ("outbox",))
def _(spark, sf):
    rows = fx.outbox(spark, sf).select("event_id", "channel", "outbox_id")
    held = fx.outbox(spark, sf).where("status = 'sent'")
    out = ingest.insert_if_absent(held, rows, ("event_id", "channel"), "outbox_id")
    return out.select(F.col("event_id").alias("offset"), "channel")


@query("c2_known_devices", """
    SELECT "offset", rule_name, device_id IN (SELECT device_id FROM stored_devices) AS known
    FROM rule_events""", ("rule_events", "stored_devices"))
def _(spark, sf):
    events, known = fx.rule_events(spark, sf), fx.stored_devices(spark, sf)
    yes = devices.known_only(events, known).withColumn("known", F.lit(True))
    no = devices.unknown_only(events, known).withColumn("known", F.lit(False))
    return yes.unionByName(no).select("offset", "rule_name", "known")


@query("c3_threshold_rules", """
    SELECT "offset", device_id, rule_name, event_type, severity, event_value, threshold_value, message
    FROM threshold_hits""", ("threshold_hits",))
def _(spark, sf):
    hits = rules.threshold_hits(fx.arrivals(spark, sf), shipped_rules())
    return hits.select(
        "offset", "device_id", "rule_name", "event_type", "severity", "event_value", "threshold_value", "message"
    )


@query("h2_rule_defaults", """
    SELECT "offset", 'LOW_POWER' AS event_type, 'WARNING' AS severity FROM arrivals WHERE power_w <= 100""",
       ("arrivals",))
def _(spark, sf):
    from ..sources.rules_config import parse_rules

    bare = parse_rules({"rules": {
        "low_power": {"condition": {"field": "power_w", "operator": "le", "value": 100}},
        "no_threshold": {"condition": {"field": "power_w", "operator": "le"}},
        "no_operator": {"condition": {"field": "power_w", "operator": "near", "value": 1}},
        "off": {"enabled": False, "condition": {"field": "power_w", "operator": "ge", "value": 0}},
    }})
    return rules.evaluate(fx.arrivals(spark, sf), bare).select("offset", "event_type", "severity")


@query("c4_channel_fan_out", """
    SELECT "offset", channel FROM rule_events, (VALUES ('console'), ('webhook')) AS c(channel)
    WHERE severity = 'CRITICAL'""", ("rule_events",))
def _(spark, sf):
    return outbox.fan_out(policy.alertable(fx.rule_events(spark, sf)), fx.CHANNELS).select("offset", "channel")


@query("c5_device_state", f"""
    SELECT 'house_0007' AS device_id, coalesce(
        (SELECT status FROM status WHERE device_id = 'house_0007' ORDER BY time DESC LIMIT 1),
        (SELECT status FROM stored_devices WHERE device_id = 'house_0007'), 'unknown') AS value
    UNION ALL SELECT 'none', coalesce((SELECT status FROM status WHERE device_id = 'none'), 'unknown')
    """, ("status", "stored_devices"))
def _(spark, sf):
    history, known = fx.status(spark, sf), fx.stored_devices(spark, sf)
    parts = [
        series.device_state(history, known, d).select(F.lit(d).alias("device_id"), "value")
        for d in ("house_0007", "none")
    ]
    return parts[0].unionByName(parts[1])


@query("c7_two_stage_flags", """
    SELECT p."offset", is_anomaly AS edge, voltage_v < 200 OR power_w > 1500 AS cloud,
           is_anomaly AND (voltage_v < 200 OR power_w > 1500) AS both_stages FROM predictions p""", ("predictions",))
def _(spark, sf):
    from ..operators.evaluation import two_stage

    edge = fx.predictions(spark, sf).select("offset", "is_anomaly")
    cloud = fx.arrivals(spark, sf).select(
        "offset", ((F.col("voltage_v") < 200) | (F.col("power_w") > 1500)).alias("confirmed")
    )
    return two_stage(edge, cloud).select(
        "offset", F.col("is_anomaly").alias("edge"), F.col("confirmed").alias("cloud"), "both_stages"
    )


@query("d18_pipeline_counters", """
    WITH v AS (SELECT c.*, t.voltage_v, t.current_a, t.power_w, t.temperature_c
               FROM checked c JOIN telemetry t ON t.sequence_no = c.id AND c.kind = 'telemetry'
               WHERE c.error_type IS NULL),
    hits AS (SELECT lower(event_type) AS type, lower(severity) AS severity FROM v, rule_list
             WHERE CASE operator WHEN 'lt' THEN CASE field WHEN 'voltage_v' THEN voltage_v END < value
                   ELSE CASE field WHEN 'voltage_v' THEN voltage_v WHEN 'current_a' THEN current_a
                        ELSE temperature_c END > value END)
    SELECT * FROM (
        SELECT 'messages.received' AS name, count(*) AS value FROM checked
        UNION ALL SELECT 'validation.failures', count(error_type) FROM checked
        UNION ALL SELECT 'validation.' || CASE kind WHEN 'events' THEN 'event' ELSE kind END || '.success', count(*)
                  FROM checked WHERE error_type IS NULL GROUP BY kind
        UNION ALL SELECT 'validation.' || CASE kind WHEN 'events' THEN 'event' ELSE kind END || '.failures', count(*)
                  FROM checked WHERE error_type <> 'invalid_json' GROUP BY kind
        UNION ALL SELECT 'messages.' || kind, count(*) FROM checked WHERE error_type IS NULL GROUP BY kind
        UNION ALL SELECT 'readings.stored', count(*) FROM v
        UNION ALL SELECT 'events.' || severity, count(*) FROM hits GROUP BY severity
        UNION ALL SELECT 'events.type.' || type, count(*) FROM hits GROUP BY type)
    WHERE value > 0""", ("checked", "telemetry", "rule_list"))
def _(spark, sf):
    rows = cut_lineage(checked(spark, sf))
    readings = validate.valid_readings(rows)
    hits = rules.threshold_hits(readings, shipped_rules())
    return agg.pipeline_counters(rows, ingest.stored_readings(readings, hits), hits)


@query("d20_throughput", """
    SELECT round((SELECT count(*) FROM checked) / 4320.0, 6) AS messages_per_second,
           round((SELECT count(*) FROM checked WHERE error_type IS NULL AND kind = 'telemetry') / 4320.0, 6)
               AS readings_per_second,
           round((SELECT count(*) FROM rule_events) / 4320.0, 6) AS events_per_second""", ("checked", "rule_events"))
def _(spark, sf):
    counters = _run_counters(spark, sf)
    return agg.throughput(counters, 4320).select(*[
        F.round(c, 6).alias(c) for c in ("messages_per_second", "readings_per_second", "events_per_second")
    ])


@query("d21_data_reduction", """
    WITH c AS (SELECT (SELECT count(*) FROM checked WHERE error_type IS NULL AND kind = 'telemetry') AS s,
                      (SELECT count(*) FROM rule_events) AS e)
    SELECT s AS raw_readings_stored, e AS total_events,
           round(greatest(0, least(1, 1 - e / s)), 6) AS data_reduction_ratio FROM c""", ("checked", "rule_events"))
def _(spark, sf):
    return agg.data_reduction(_run_counters(spark, sf)).withColumn(
        "data_reduction_ratio", F.round("data_reduction_ratio", 6)
    )


def _run_counters(spark, sf, rows=None, events=None):
    """Counters of all messages; ``rows`` (checked messages) and ``events`` if the caller has them."""
    rows = _parsed_once(spark, sf) if rows is None else rows
    readings = validate.valid_readings(rows)
    stored = ingest.dedup_readings(readings).withColumns({"store_raw": F.lit(True), "kept": F.col("copies")})
    return agg.pipeline_counters(rows, stored, _names(fx.rule_events(spark, sf)) if events is None else events)


def _parsed_once(spark, sf):
    """The checked messages in columns, of which each reader takes only its own; the bytes sent stay behind."""
    return stored_once(checked(spark, sf).drop("payload"))


def _names(events):
    """Event type and severity of each event, found once for all counts by them."""
    return stored_once(events.select("event_type", "severity"))


@query("d22_retained_bytes", """
    WITH r AS (SELECT "offset" IN (SELECT "offset" FROM rule_events) AS fired,
                      strlen(device_id) + strlen(CAST(sequence_no AS VARCHAR)) AS size FROM arrivals)
    SELECT 'raw' AS policy, count(*) AS readings, CAST(sum(size) AS BIGINT) AS bytes FROM r
    UNION ALL SELECT 'hybrid', count(*), CAST(sum(size) AS BIGINT) FROM r WHERE fired
    UNION ALL SELECT 'event_only', count(*), CAST(sum(size) AS BIGINT) FROM r WHERE fired
    UNION ALL SELECT 'aggregate_only', 0, 0
    UNION ALL SELECT 'baseline', count(*), CAST(sum(size) AS BIGINT) FROM r""", ("rule_events", "arrivals"))
def _(spark, sf):
    readings = policy.mark_triggering(fx.arrivals(spark, sf), fx.rule_events(spark, sf)).withColumn(
        "raw_payload", F.concat("device_id", F.col("sequence_no").cast("string"))
    )
    return policy.retained_bytes(readings, "raw_payload", POLICIES)


@query("e5_first_arrival", """
    SELECT time, device_id, min("offset") AS "offset", arg_min(voltage_v, "offset") AS voltage_v,
           count(*) AS copies FROM duplicates GROUP BY 1, 2""", ("duplicates",))
def _(spark, sf):
    return ingest.dedup_readings(fx.duplicates(spark, sf)).select("time", "device_id", "offset", "voltage_v", "copies")


@query("e1_spike_hits", """
    SELECT "offset", device_id, time, event_value, round(change, 4) AS change FROM spike_hits""", ("spike_hits",))
def _(spark, sf):
    spike = next(r for r in shipped_rules() if r.type == "percentage_increase")
    hits = rules.spike_hits(fx.arrivals(spark, sf), spike)
    base = rules.spike_baseline(fx.arrivals(spark, sf), "power_w", 60).select("offset", "baseline")
    return hits.join(base, "offset").select(
        "offset", "device_id", "time", "event_value",
        F.round((F.col("event_value") - F.col("baseline")) / F.col("baseline") * 100, 4).alias("change"),
    )


@query("e1_spike_baseline", """
    SELECT "offset", device_id, value, baseline FROM spike_base""", ("spike_base",))
def _(spark, sf):
    return rules.spike_baseline(fx.arrivals(spark, sf), "power_w", 60).select("offset", "device_id", "value", "baseline")


@query("g4_merge_detectors", """
    SELECT 'rules' AS mode, count(*) AS events FROM rule_events
    UNION ALL SELECT 'ml', count(*) FROM predictions WHERE is_anomaly
    UNION ALL SELECT 'hybrid', (SELECT count(*) FROM rule_events) + (SELECT count(*) FROM predictions WHERE is_anomaly)
    """, ("rule_events", "predictions"))
def _(spark, sf):
    from ..operators.scoring import model_hits

    by_rule = rules.evaluate(fx.arrivals(spark, sf), shipped_rules())
    by_model = model_hits(fx.predictions(spark, sf))
    out = None
    for mode in ("rules", "ml", "hybrid"):
        part = ingest.merge_hits(by_rule, by_model, mode).agg(F.lit(mode).alias("mode"), F.count("*").alias("events"))
        out = part if out is None else out.unionByName(part)
    return out


@query("i10_offline_events", """
    SELECT time, device_id, 'DEVICE_FAILURE' AS event_type, 'CRITICAL' AS severity,
           'Device ' || device_id || ' reported offline' AS message,
           CASE WHEN reason IS NULL THEN '{"reason":null}' ELSE '{"reason":"' || reason || '"}' END AS metadata
    FROM status WHERE status = 'offline'""", ("status",))
def _(spark, sf):
    return ingest.offline_events(fx.status(spark, sf)).select(
        "time", "device_id", "event_type", "severity", "message", "metadata"
    )


@query("i11_reported_events", """
    SELECT "offset", device_id, event_type, severity, message, 'device_event' AS rule_name,
           severity = 'CRITICAL' AS alerts FROM device_events""", ("device_events",))
def _(spark, sf):
    rows = ingest.reported_events(fx.device_events(spark, sf))
    alerts = policy.alertable(rows).select("offset", F.lit(True).alias("alerts"))
    return rows.join(alerts, "offset", "left").select(
        "offset", "device_id", "event_type", "severity", "message", "rule_name",
        F.coalesce("alerts", F.lit(False)).alias("alerts"),
    )


DUE_SQL = f"""SELECT outbox_id FROM outbox WHERE status IN ('pending', 'failed')
    AND next_attempt_at <= {END_SQL} ORDER BY next_attempt_at, outbox_id LIMIT 50"""


@query("f5_due_alerts", DUE_SQL, ("outbox",))
def _(spark, sf):
    return outbox.due(fx.outbox(spark, sf), fx.RANGE_END).select("outbox_id")


@query("j2_claim", f"""
    SELECT outbox_id, CASE WHEN due THEN 'processing' ELSE status END AS status,
           CASE WHEN due THEN {END_SQL} ELSE locked_at END AS locked_at
    FROM (SELECT *, outbox_id IN ({DUE_SQL}) AS due FROM outbox)""", ("outbox",))
def _(spark, sf):
    return outbox.claim(fx.outbox(spark, sf), fx.RANGE_END).select("outbox_id", "status", "locked_at")


@query("c6_claimed_ids", f"""
    SELECT outbox_id, channel, event_id FROM outbox WHERE outbox_id IN ({DUE_SQL})""", ("outbox",))
def _(spark, sf):
    held = outbox.claim(fx.outbox(spark, sf), fx.RANGE_END)
    return held.where((F.col("status") == "processing") & (F.col("locked_at") == F.lit(fx.RANGE_END).cast("timestamp"))
                      ).select("outbox_id", "channel", "event_id")


SETTLED_SQL = f"""SELECT o.outbox_id,
    CASE WHEN r.outcome = 'ok' THEN 'sent' WHEN r.outcome IS NULL THEN o.status
         WHEN o.attempts + 1 >= 5 THEN 'discarded' ELSE 'failed' END AS status,
    CASE WHEN r.outcome IN ('error', 'exception') THEN o.attempts + 1 ELSE o.attempts END AS attempts,
    CASE WHEN r.outcome IS NULL OR r.outcome = 'ok' THEN o.next_attempt_at
         WHEN o.attempts + 1 >= 5 THEN {AS_OF_SQL}
         ELSE {AS_OF_SQL} + to_seconds([30, 120, 600, 1800][least(o.attempts + 1, 4)]) END AS next_attempt_at,
    CASE r.outcome WHEN 'error' THEN r.response WHEN 'exception' THEN 'exception: ' || r.response END AS last_error,
    CASE WHEN r.outcome IS NULL THEN o.locked_at END AS locked_at,
    CASE WHEN r.outcome = 'ok' THEN {AS_OF_SQL} ELSE o.sent_at END AS sent_at
    FROM outbox o LEFT JOIN delivery_results r USING (outbox_id)"""
SETTLED = ("outbox_id", "status", "attempts", "next_attempt_at", "last_error", "locked_at", "sent_at")


def settled(spark, sf):
    return outbox.settle(fx.outbox(spark, sf), fx.delivery_results(spark, sf), fx.AS_OF).select(*SETTLED)


@query("j3_sent", f"SELECT * FROM ({SETTLED_SQL}) WHERE status = 'sent'", ("outbox", "delivery_results"))
def _(spark, sf):
    return settled(spark, sf).where("status = 'sent'")


@query("j4_failed", f"SELECT * FROM ({SETTLED_SQL}) WHERE status IN ('failed', 'discarded')",
       ("outbox", "delivery_results"))
def _(spark, sf):
    return settled(spark, sf).where("status IN ('failed', 'discarded')")


@query("j5_deliveries", f"""
    SELECT event_id, channel, CASE WHEN outcome = 'exception' THEN 'error' ELSE outcome END AS status,
           CASE WHEN outcome = 'exception' THEN 'exception: ' || response ELSE response END AS response,
           {AS_OF_SQL} AS sent_at
    FROM outbox JOIN delivery_results USING (outbox_id)""", ("outbox", "delivery_results"))
def _(spark, sf):
    return outbox.deliveries(fx.outbox(spark, sf), fx.delivery_results(spark, sf), fx.AS_OF).drop("alert_id")


@query("j6_alert_texts", """
    SELECT "offset", ':rotating_light: *' || severity || '* `' || event_type || '` on `' || device_id || '`'
           AS first_line FROM rule_events WHERE severity = 'CRITICAL'""", ("rule_events",))
def _(spark, sf):
    alerts = policy.alertable(fx.rule_events(spark, sf))
    return alerts.select("offset", F.substring_index(outbox.chat_text(), "\n", 1).alias("first_line"))





@query("a13_report_lines")
def _(spark, sf):
    from .report import report_lines

    rows, events = _parsed_once(spark, sf), _names(fx.rule_events(spark, sf))
    return report_lines(
        _run_counters(spark, sf, rows, events), agg.latency_summary(fx.latencies(spark, sf)),
        agg.count_by(events, "severity"), agg.count_by(validate.quality_rows(rows), "error_type"),
    )
