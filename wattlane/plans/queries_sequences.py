"""Cooldown, batch, count-window, heartbeat, alert-queue and forwarding queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import escalation, outbox, policy, rules, sequences
from ..settings import Settings
from . import fixtures as fx
from .oracle_views import AS_OF_SQL
from .registry import query

SETTINGS = Settings(alert_channels=fx.CHANNELS)
BATCH_ROWS, BATCH_MS = 8, 60_000


def _cooldown_sql(source: str) -> str:
    """Recursive picks: the first event, then the first one 300 s or more after the last pick."""
    return f"""WITH RECURSIVE src AS ({source}),
    picks AS (
        SELECT device_id, event_type, severity, min(time) AS t FROM src GROUP BY 1, 2, 3
        UNION ALL
        SELECT * FROM (
            SELECT p.device_id, p.event_type, p.severity,
                   (SELECT min(s.time) FROM src s WHERE s.device_id = p.device_id AND s.event_type = p.event_type
                     AND s.severity = p.severity AND s.time >= p.t + INTERVAL 300 SECOND) AS t FROM picks p)
        WHERE t IS NOT NULL)"""


@query("e6_event_cooldown", _cooldown_sql("SELECT * FROM rule_events") + """
    SELECT device_id, event_type, severity, t AS time FROM picks""", ("rule_events",))
def _(spark, sf):
    out = sequences.cooldown(
        fx.rule_events(spark, sf), ["device_id", "event_type", "severity"], "time", "offset", 300
    )
    return out.select("device_id", "event_type", "severity", "time")


@query("k5_model_events", _cooldown_sql("""
        SELECT device_id, 'ML_ANOMALY' AS event_type, 'WARNING' AS severity, time
        FROM predictions WHERE is_anomaly""") + """
    SELECT device_id, event_type, severity, t AS time FROM picks""", ("predictions",))
def _(spark, sf):
    from ..operators.scoring import model_events

    return model_events(fx.predictions(spark, sf)).select("device_id", "event_type", "severity", "time")


@query("j1_enqueue", _cooldown_sql("SELECT * FROM rule_events WHERE severity = 'CRITICAL'") + f"""
    SELECT e."offset" AS event_id, c.channel, 'pending' AS status, 0 AS attempts, {AS_OF_SQL} AS next_attempt_at
    FROM picks p JOIN src e ON e.device_id = p.device_id AND e.time = p.t AND e.event_type = p.event_type
    CROSS JOIN (VALUES ('console'), ('webhook')) AS c(channel)
    WHERE NOT EXISTS (SELECT 1 FROM outbox o WHERE o.status = 'sent' AND o.event_id = e."offset"
                      AND o.channel = c.channel)""", ("rule_events", "outbox"))
def _(spark, sf):
    events = fx.rule_events(spark, sf).withColumn("event_id", F.col("offset"))
    held = fx.outbox(spark, sf).where("status = 'sent'")
    return outbox.enqueue(held, events, fx.AS_OF, SETTINGS).select(
        "event_id", "channel", "status", "attempts", "next_attempt_at"
    )


@query("e7_count_windows", """
    SELECT "offset", device_id, (k - 1) // 8 AS window_id, CAST((k - 1) % 8 AS INTEGER) AS window_pos
    FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY "offset") AS k,
                 count(*) OVER (PARTITION BY device_id) AS n FROM arrivals)
    WHERE k <= n - n % 8""", ("arrivals",))
def _(spark, sf):
    return sequences.count_windows(fx.arrivals(spark, sf), ["device_id"], "offset", 8).select(
        "offset", "device_id", "window_id", "window_pos"
    )


def _batch_sql(source: str) -> str:
    return f"""WITH RECURSIVE src AS (
        SELECT *, row_number() OVER (PARTITION BY gateway ORDER BY "offset") AS n
        FROM (SELECT *, right(device_id, 1) AS gateway FROM {source})),
    picks AS (
        SELECT DISTINCT gateway, CAST(1 AS BIGINT) AS n, min(received_at) AS t FROM src WHERE n = 1 GROUP BY 1
        UNION ALL
        SELECT q.gateway, q.n, s.received_at FROM (
            SELECT p.gateway, least(p.n + {BATCH_ROWS}, coalesce(
                (SELECT min(s.n) FROM src s WHERE s.gateway = p.gateway
                   AND s.received_at >= p.t + INTERVAL {BATCH_MS} MILLISECOND), p.n + {BATCH_ROWS})) AS n
            FROM picks p) q JOIN src s ON s.gateway = q.gateway AND s.n = q.n),
    owned AS (SELECT s.*, (SELECT max(p.n) FROM picks p WHERE p.gateway = s.gateway AND p.n <= s.n) AS batch_id
              FROM src s)"""


def _flagged(spark, sf):
    rows = policy.escalation_gate(fx.predictions(spark, sf), "gated")
    return rows.withColumn("gateway", F.right("device_id", F.lit(1)))


FLAGGED_SQL = "(SELECT * FROM predictions WHERE is_anomaly)"


@query("e8_micro_batches", _batch_sql("arrivals") + """
    SELECT "offset", gateway, batch_id FROM owned""", ("arrivals",))
def _(spark, sf):
    rows = fx.arrivals(spark, sf).withColumn("gateway", F.right("device_id", F.lit(1)))
    return sequences.batches(rows, ["gateway"], "received_at", "offset", BATCH_ROWS, BATCH_MS).select(
        "offset", "gateway", "batch_id"
    )


@query("a14_envelopes", _batch_sql(FLAGGED_SQL) + """
    SELECT gateway, batch_id, CAST(count(*) AS INTEGER) AS readings FROM owned GROUP BY 1, 2""", ("predictions",))
def _(spark, sf):
    out = escalation.envelopes(_flagged(spark, sf), ["gateway"], "gated", max_rows=BATCH_ROWS, millis=BATCH_MS)
    return out.select("gateway", "batch_id", "readings")


@query("a15_receive", """
    SELECT device_id, power_w, anomaly_score, 'gated' AS mode FROM predictions WHERE is_anomaly""", ("predictions",))
def _(spark, sf):
    out = escalation.envelopes(_flagged(spark, sf), ["gateway"], "gated", max_rows=BATCH_ROWS, millis=BATCH_MS)
    return escalation.receive(out).select("device_id", "power_w", "anomaly_score", "mode")


@query("d29_receiver_counters", _batch_sql(FLAGGED_SQL) + """
    SELECT 'escalations.batches' AS name, count(*) AS value FROM picks
    UNION ALL SELECT 'escalations.readings', count(*) FROM src
    UNION ALL SELECT 'escalations.mode.gated', count(*) FROM src
    UNION ALL SELECT 'escalations.device.' || device_id, count(*) FROM src GROUP BY device_id""", ("predictions",))
def _(spark, sf):
    out = escalation.envelopes(_flagged(spark, sf), ["gateway"], "gated", max_rows=BATCH_ROWS, millis=BATCH_MS)
    return escalation.receiver_counters(out).where("name <> 'escalations.bytes_received'")


def _arms(spark, sf):
    scored = fx.predictions(spark, sf).withColumn("gateway", F.right("device_id", F.lit(1)))
    out = None
    for mode in ("gated", "all"):
        rows = policy.escalation_gate(scored, mode)
        sent = escalation.envelopes(rows, ["gateway"], mode, max_rows=BATCH_ROWS, millis=BATCH_MS)
        part = escalation.arm_totals(sent, mode)
        out = part if out is None else out.unionByName(part)
    return out


@query("c8_arm_comparison", """
    SELECT (SELECT count(*) FROM predictions WHERE is_anomaly) AS readings_gated,
           (SELECT count(*) FROM predictions) AS readings_all""", ("predictions",))
def _(spark, sf):
    return escalation.reduction(_arms(spark, sf)).select("readings_gated", "readings_all")


@query("d27_reduction", """
    SELECT round(100 * (1 - (SELECT count(*) FROM predictions WHERE is_anomaly)
                            / (SELECT count(*) FROM predictions)), 2) AS readings_reduction_pct""", ("predictions",))
def _(spark, sf):
    return escalation.reduction(_arms(spark, sf)).select("readings_reduction_pct")


@query("d27_bytes_reduction")
def _(spark, sf):
    return escalation.reduction(_arms(spark, sf))


@query("d30_verdict_counters", """
    WITH w AS (SELECT abs(power_w - 1000) / 1000 AS e FROM (
        SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY "offset") AS k,
               count(*) OVER (PARTITION BY device_id) AS n FROM predictions WHERE is_anomaly)
        WHERE k <= n - n % 8)
    SELECT count(*) // 8 AS windows, count(*) AS scored, count(*) FILTER (WHERE e > 0.5) AS confirmed,
           count(*) FILTER (WHERE e <= 0.5) AS suppressed, round(avg(e), 6) AS avg_error FROM w""", ("predictions",))
def _(spark, sf):
    windows = sequences.count_windows(_flagged(spark, sf), ["device_id"], "offset", 8)
    verdicts = windows.withColumn("recon_error", F.abs(F.col("power_w") - 1000) / 1000).withColumn(
        "confirmed", F.col("recon_error") > 0.5
    )
    return escalation.verdict_counters(verdicts).withColumn("avg_error", F.round("avg_error", 6))


FAILURES_SQL = f"""WITH RECURSIVE gaps AS (
        SELECT device_id, time AS last_seen, time + INTERVAL 30 SECOND AS a,
               coalesce(lead(time) OVER (PARTITION BY device_id ORDER BY time, "offset"),
                        {AS_OF_SQL} + INTERVAL 1 MICROSECOND) AS b, status FROM status),
    live AS (SELECT * FROM gaps WHERE status NOT IN ('offline', 'maintenance') AND a < b),
    fired AS (
        SELECT device_id, min(a) AS f FROM live GROUP BY 1
        UNION ALL
        SELECT * FROM (
            SELECT p.device_id, (SELECT min(greatest(l.a, p.f + INTERVAL 300 SECOND)) FROM live l
                WHERE l.device_id = p.device_id AND l.a > p.f AND greatest(l.a, p.f + INTERVAL 300 SECOND) < l.b) AS f
            FROM fired p)
        WHERE f IS NOT NULL),
    failures AS (SELECT device_id, f AS offline_at,
                        (SELECT max(last_seen) FROM live l WHERE l.device_id = fired.device_id AND l.a <= f) AS last_seen
                 FROM fired)"""


@query("e9_heartbeat_failures", FAILURES_SQL + """
    SELECT device_id, last_seen, offline_at, (epoch_us(offline_at) - epoch_us(last_seen)) / 1000000 AS age_seconds
    FROM failures""", ("status",))
def _(spark, sf):
    return sequences.heartbeat_failures(fx.status(spark, sf), fx.AS_OF)


@query("e9_heartbeat_events", FAILURES_SQL + """
    SELECT device_id, offline_at AS time, 'DEVICE_FAILURE' AS event_type, 'CRITICAL' AS severity,
           CAST(30 AS DOUBLE) AS threshold_value FROM failures""", ("status",))
def _(spark, sf):
    out = sequences.heartbeat_events(sequences.heartbeat_failures(fx.status(spark, sf), fx.AS_OF))
    return out.select("device_id", "time", "event_type", "severity", "threshold_value")


@query("e10_spike_after_reset", FAILURES_SQL + """,
    epochs AS (SELECT a.*, (SELECT count(*) FROM failures f WHERE f.device_id = a.device_id
                              AND f.offline_at <= a.received_at) AS epoch FROM arrivals a)
    SELECT "offset", device_id, power_w AS value,
           CASE WHEN first_value("offset") OVER recent <> "offset" THEN first_value(power_w) OVER recent END AS baseline
    FROM epochs WINDOW recent AS (PARTITION BY device_id, epoch ORDER BY received_at
                                  RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW)""", ("status", "arrivals"))
def _(spark, sf):
    resets = sequences.heartbeat_failures(fx.status(spark, sf), fx.AS_OF).select(
        "device_id", F.col("offline_at").alias("reset_at")
    )
    return rules.spike_baseline(fx.arrivals(spark, sf), "power_w", 60, resets=resets).select(
        "offset", "device_id", "value", "baseline"
    )
