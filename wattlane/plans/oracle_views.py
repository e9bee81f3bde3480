"""The derived views of ``plans/fixtures.py`` as DuckDB common table expressions."""
from __future__ import annotations

from .fixtures import AS_OF, BASE_US, COMPRESSION, DEVICE, RANGE_END, RANGE_START

AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
START_SQL = f"TIMESTAMP '{RANGE_START}'"
END_SQL = f"TIMESTAMP '{RANGE_END}'"
DEVICE_SQL = f"'{DEVICE}'"
RANGE_SQL = f"time BETWEEN {START_SQL} AND {END_SQL}"

_D = "CAST({} AS DOUBLE)".format

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "stamped": ((), f"""
        SELECT event_id, event_type, value,
               make_timestamp({BASE_US} + (epoch_us(ts) - {BASE_US}) // {COMPRESSION}) AS time,
               'house_' || lpad(CAST(user_id AS VARCHAR),
                                greatest(4, length(CAST(user_id AS VARCHAR)))::INT, '0') AS device_id
        FROM events"""),
    "telemetry": (("stamped",), f"""
        SELECT event_id AS sequence_no, time, device_id,
               CASE WHEN event_id % 97 = 0 THEN {_D(180)} WHEN event_id % 89 = 0 THEN {_D(260)}
                    ELSE {_D('216.5')} + {_D('event_id * 37 % 700')} / {_D(100)} END AS voltage_v,
               value * {_D(25)} / {_D(220)} AS current_a,
               value * {_D(25)} AS power_w,
               CASE WHEN event_id % 50 = 0 THEN NULL
                    ELSE {_D(25)} + {_D('event_id * 13 % 400')} / {_D(10)} END AS temperature_c
        FROM stamped"""),
    "arrivals": (("telemetry",), """
        SELECT sequence_no AS "offset", time + INTERVAL 1 SECOND AS received_at, * FROM telemetry"""),
    "status": (("stamped",), """
        SELECT event_id AS "offset", time, device_id,
               CASE event_type WHEN 'view' THEN 'online' WHEN 'signup' THEN 'maintenance'
                    ELSE 'offline' END AS status,
               'fw-' || CAST(event_id % 3 AS VARCHAR) AS firmware_version,
               '10.0.0.' || CAST(event_id % 250 AS VARCHAR) AS ip_address,
               CAST(-40 - event_id % 50 AS DOUBLE) AS rssi_dbm,
               CASE WHEN event_id % 4 = 0 THEN 'scheduled' END AS reason
        FROM stamped WHERE event_type IN ('view', 'signup', 'error')"""),
    "device_events": (("stamped",), """
        SELECT event_id AS "offset", time, device_id, 'USER_' || upper(event_type) AS event_type,
               CASE WHEN value > 100 THEN 'CRITICAL' WHEN value > 50 THEN 'WARNING'
                    ELSE 'INFO' END AS severity,
               'value ' || CAST(event_id AS VARCHAR) AS message
        FROM stamped WHERE event_type = 'purchase'"""),
    # Expected outcome of each message, from the id and not from the JSON text.
    "checked": (("telemetry", "status", "device_events"), """
        SELECT id * 2 + parity AS "offset", kind, device_id, time + INTERVAL 1 SECOND AS received_at,
               id, time,
               CASE WHEN id % 50 = 7 THEN 'invalid_json'
                    WHEN id % 50 = 11 THEN 'unsupported_schema_version'
                    WHEN id % 50 = 23 AND kind = 'telemetry' THEN 'schema_validation_error'
                    WHEN id % 50 = 13 THEN 'device_id_mismatch'
                    WHEN id % 50 = 17 AND kind = 'telemetry' THEN 'voltage_out_of_range'
                    WHEN id % 50 = 19 AND kind <> 'events' THEN 'timestamp_future_skew'
               END AS error_type
        FROM (SELECT sequence_no AS id, time, device_id, 'telemetry' AS kind, 0 AS parity
              FROM telemetry
              UNION ALL
              SELECT "offset", time, device_id, 'status', 1 FROM status
              UNION ALL
              SELECT "offset", time, device_id, 'events', 1 FROM device_events)
        WHERE id % 50 NOT IN (29, 31)"""),
    "duplicates": (("arrivals",), """
        SELECT "offset" + c * 1000000000000 AS "offset", received_at, sequence_no, time, device_id,
               voltage_v + c AS voltage_v, current_a, power_w, temperature_c
        FROM arrivals, (VALUES (0), (1)) AS copies(c)
        WHERE c = 0 OR "offset" % 20 = 0"""),
    "system_metrics": (("telemetry",), """
        SELECT time, 'counter.messages.received' AS metric_name,
               CAST(sum(n) OVER (ORDER BY time) AS DOUBLE) AS metric_value
        FROM (SELECT date_trunc('minute', time) AS time, count(*) AS n FROM telemetry GROUP BY 1)"""),
    "latencies": ((), """
        SELECT event_type AS operation, value AS value_ms, event_id AS "offset" FROM events"""),
    "rule_list": ((), """
        SELECT * FROM (VALUES
            ('undervoltage', 'UNDER_VOLTAGE', 'WARNING', 'voltage_v', 'lt', 200),
            ('overvoltage', 'OVER_VOLTAGE', 'WARNING', 'voltage_v', 'gt', 250),
            ('overload', 'OVERLOAD', 'CRITICAL', 'current_a', 'gt', 10),
            ('voltage_anomaly_low', 'VOLTAGE_ANOMALY', 'INFO', 'voltage_v', 'lt', 210),
            ('over_temperature', 'OVER_TEMPERATURE', 'WARNING', 'temperature_c', 'gt', 60))
        AS r(rule_name, event_type, severity, field, operator, value)"""),
    "threshold_hits": (("arrivals", "rule_list"), """
        SELECT "offset", time, device_id, rule_name, event_type, severity, actual AS event_value,
               CAST(value AS DOUBLE) AS threshold_value,
               field || '=' || CAST(actual AS VARCHAR) || ' ' || operator || ' '
                     || CAST(value AS VARCHAR) || ' (rule=' || rule_name || ')' AS message
        FROM (SELECT *, CASE field WHEN 'voltage_v' THEN voltage_v WHEN 'current_a' THEN current_a
                             ELSE temperature_c END AS actual
              FROM arrivals CROSS JOIN rule_list)
        WHERE CASE operator WHEN 'lt' THEN actual < value ELSE actual > value END"""),
    "spike_base": (("arrivals",), """
        SELECT "offset", time, device_id, power_w AS value,
               CASE WHEN first_value("offset") OVER recent <> "offset"
                    THEN first_value(power_w) OVER recent END AS baseline
        FROM arrivals
        WINDOW recent AS (PARTITION BY device_id ORDER BY received_at
                          RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW)"""),
    "spike_hits": (("spike_base",), """
        SELECT "offset", time, device_id, 'power_spike' AS rule_name, 'POWER_SPIKE' AS event_type,
               'WARNING' AS severity, value AS event_value, CAST(30 AS DOUBLE) AS threshold_value,
               (value - baseline) / baseline * 100 AS change
        FROM spike_base WHERE baseline > 0 AND (value - baseline) / baseline * 100 >= 30"""),
    "rule_events": (("threshold_hits", "spike_hits"), """
        SELECT *, "offset" % 3 = 0 AS acknowledged, time AS reading_time FROM (
            SELECT "offset", time, device_id, rule_name, event_type, severity, event_value,
                   threshold_value FROM threshold_hits
            UNION ALL
            SELECT "offset", time, device_id, rule_name, event_type, severity, event_value,
                   threshold_value FROM spike_hits)"""),
    "labelled": (("arrivals",), """
        SELECT *, CASE WHEN voltage_v = 180 THEN 'undervoltage' WHEN voltage_v = 260
                       THEN 'overvoltage' ELSE 'normal' END AS kind FROM arrivals"""),
    "predictions": (("labelled",), """
        SELECT *, anomaly_score > threshold AS is_anomaly FROM (
            SELECT *, CASE WHEN kind = 'normal'
                           THEN CAST(0.30 AS DOUBLE) + CAST(sequence_no * 17 % 300 AS DOUBLE) / CAST(1000 AS DOUBLE)
                           ELSE CAST(0.50 AS DOUBLE) + CAST(sequence_no * 29 % 300 AS DOUBLE) / CAST(1000 AS DOUBLE)
                      END AS anomaly_score,
                   CAST(0.55 AS DOUBLE) AS threshold, 'iforest_v1' AS model_version
            FROM labelled)"""),
    "quality_logs": (("checked",), """
        SELECT received_at AS time, error_type, "offset",
               CASE error_type WHEN 'invalid_json' THEN NULL
                    WHEN 'device_id_mismatch' THEN device_id || 'x' ELSE device_id END AS device_id
        FROM checked WHERE error_type IS NOT NULL"""),
    "waveform": ((), """
        SELECT l_orderkey % 50 AS device_id, l_orderkey AS window_id, l_linenumber AS k,
               2048 + l_partkey % 1000 AS v_raw, 2048 + l_suppkey % 100 AS i_raw
        FROM lineitem"""),
    "outbox": (("rule_events",), """
        SELECT "offset" * 4 + p AS outbox_id, "offset" AS event_id, channel, device_id,
               CASE "offset" % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'processing'
                    ELSE 'sent' END AS status,
               CAST("offset" % 6 AS INTEGER) AS attempts,
               time + to_minutes("offset" % 7) AS next_attempt_at,
               CASE WHEN "offset" % 4 = 2 THEN time END AS locked_at,
               CASE WHEN "offset" % 4 = 3 THEN time END AS sent_at,
               time AS created_at, time AS updated_at
        FROM rule_events, (VALUES (0, 'console'), (1, 'webhook')) AS c(p, channel)
        WHERE severity = 'CRITICAL'"""),
    "delivery_results": (("outbox",), """
        SELECT outbox_id, CASE outbox_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' ELSE 'exception'
               END AS outcome,
               CASE outbox_id % 3 WHEN 1 THEN 'status=500' WHEN 2 THEN 'slack down' END AS response
        FROM outbox WHERE status = 'processing'"""),
    "stored_devices": ((), """
        SELECT 'house_' || lpad(CAST(c_custkey * 3 AS VARCHAR),
                                greatest(4, length(CAST(c_custkey * 3 AS VARCHAR)))::INT, '0') AS device_id,
               CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS location,
               'energy_node' AS device_type,
               CASE WHEN c_custkey % 4 = 0 THEN 'fw-stored' END AS firmware_version,
               'unknown' AS status, CAST(NULL AS TIMESTAMP) AS last_seen_at,
               TIMESTAMP '2023-12-31 00:00:00' AS created_at,
               TIMESTAMP '2023-12-31 00:00:00' AS updated_at
        FROM customer"""),
}


def with_views(sql: str, *needed: str, recursive: bool = False) -> str:
    """``sql`` with the named views (and what they build on) in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in VIEWS[name][0]:
            visit(dep)
        order.append(name)

    for name in needed:
        visit(name)
    ctes = [f"{n} AS MATERIALIZED ({VIEWS[n][1].strip()})" for n in order]
    body = sql.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body.upper().startswith("WITH RECURSIVE "):
        head, body = "WITH RECURSIVE ", "," + body[15:]
    elif body.upper().startswith("WITH "):
        body = "," + body[5:]
    if not ctes:
        return sql
    return head + ",\n".join(ctes) + "\n" + body
