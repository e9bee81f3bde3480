"""Telemetry-shaped views derived from the given parquet tables.

Each view is a lazy DataFrame over ``events`` or ``lineitem``; nothing is
collected, so the views grow with the tables.  ``plans/oracle_views.py`` states
the same definitions in SQL for the cross-check.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import add_seconds
from ..operators import rules as rule_ops
from ..session import use_utc
from ..sources.rules_config import shipped_rules

# Fixed values of the derived data set.
BASE_US = 1_704_067_200_000_000
COMPRESSION = 600
AS_OF = "2024-01-01 01:15:00"
RANGE_START = "2024-01-01 00:10:00"
RANGE_END = "2024-01-01 00:50:00"
DEVICE = "house_0007"
CHANNELS = ("console", "webhook")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows with compressed time and a device name."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        "value",
        F.expr(
            f"timestamp_micros({BASE_US} + (unix_micros(CAST(ts AS TIMESTAMP)) - {BASE_US})"
            f" DIV {COMPRESSION})"
        ).alias("time"),
        F.expr(
            "concat('house_', lpad(CAST(user_id AS STRING),"
            " greatest(4, length(CAST(user_id AS STRING))), '0'))"
        ).alias("device_id"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(spark, sf_dir).selectExpr(
        "event_id AS sequence_no",
        "time",
        "device_id",
        "CASE WHEN event_id % 97 = 0 THEN 180.0D WHEN event_id % 89 = 0 THEN 260.0D"
        " ELSE 216.5D + (event_id * 37 % 700) / 100.0D END AS voltage_v",
        "value * 25.0D / 220.0D AS current_a",
        "value * 25.0D AS power_w",
        "CASE WHEN event_id % 50 = 0 THEN NULL"
        " ELSE 25.0D + (event_id * 13 % 400) / 10.0D END AS temperature_c",
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with arrival order and arrival time."""
    return telemetry(spark, sf_dir).select(
        F.col("sequence_no").alias("offset"),
        add_seconds("time", 1).alias("received_at"),
        "*",
    )


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _stamped(spark, sf_dir)
        .where(F.col("event_type").isin("view", "signup", "error"))
        .selectExpr(
            "event_id AS offset",
            "time",
            "device_id",
            "CASE event_type WHEN 'view' THEN 'online' WHEN 'signup' THEN 'maintenance'"
            " ELSE 'offline' END AS status",
            "concat('fw-', event_id % 3) AS firmware_version",
            "concat('10.0.0.', event_id % 250) AS ip_address",
            "CAST(-40 - event_id % 50 AS DOUBLE) AS rssi_dbm",
            "CASE WHEN event_id % 4 = 0 THEN 'scheduled' END AS reason",
        )
    )


def device_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _stamped(spark, sf_dir)
        .where(F.col("event_type") == "purchase")
        .selectExpr(
            "event_id AS offset",
            "time",
            "device_id",
            "concat('USER_', upper(event_type)) AS event_type",
            "CASE WHEN value > 100 THEN 'CRITICAL' WHEN value > 50 THEN 'WARNING'"
            " ELSE 'INFO' END AS severity",
            "concat('value ', CAST(event_id AS STRING)) AS message",
        )
    )


def spread(df: DataFrame) -> DataFrame:
    """Deal messages out over all slots, as a topic's partitions would be."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _envelope(view: DataFrame, kind: str, parity: int, body: list[str]) -> DataFrame:
    """JSON messages of one type, some corrupted by fixed rules on the id."""
    r = F.col("id") % 50
    iso_text = F.date_format(
        F.when(r == 19, add_seconds("time", 7200)).otherwise(F.col("time")),
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
    )
    fields = [
        F.when(r == 11, "99.0").otherwise("1.0").alias("schema_version"),
        F.when(r == 13, F.concat(F.col("device_id"), F.lit("x")))
        .otherwise(F.col("device_id"))
        .alias("device_id"),
        iso_text.alias("timestamp"),
    ] + [F.expr(b) for b in body]
    text = F.to_json(F.struct(*fields))
    topic = (
        F.when(r == 31, F.lit("foo/bar"))
        .when(r == 29, F.concat(F.lit("energy/"), F.col("device_id"), F.lit("/commands")))
        .otherwise(F.concat(F.lit("energy/"), F.col("device_id"), F.lit(f"/{kind}")))
    )
    return (
        view.withColumn("_t", text)
        .withColumn("_cut", F.when(r == 7, F.expr("left(_t, length(_t) - 20)")).otherwise(F.col("_t")))
        .select(
            topic.alias("topic"),
            F.encode("_cut", "UTF-8").alias("payload"),
            add_seconds("time", 1).alias("received_at"),
            (F.col("id") * 2 + parity).alias("offset"),
        )
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = _envelope(
        telemetry(spark, sf_dir).withColumnRenamed("sequence_no", "id"),
        "telemetry",
        0,
        [
            "CASE WHEN id % 50 = 17 THEN 999.0D ELSE voltage_v END AS voltage_v",
            "current_a AS current_a",
            "CASE WHEN id % 50 = 23 THEN NULL ELSE power_w END AS power_w",
            "temperature_c AS temperature_c",
            "id AS sequence_no",
        ],
    )
    states = _envelope(
        status(spark, sf_dir).withColumnRenamed("offset", "id"),
        "status",
        1,
        ["status AS status", "firmware_version AS firmware_version", "ip_address AS ip_address",
         "rssi_dbm AS rssi_dbm", "reason AS reason"],
    )
    reports = _envelope(
        device_events(spark, sf_dir).withColumnRenamed("offset", "id"),
        "events",
        1,
        ["event_type AS event_type", "severity AS severity", "message AS message"],
    )
    return spread(readings.unionByName(states).unionByName(reports))


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals plus a later, slightly different copy of every twentieth row."""
    rows = arrivals(spark, sf_dir)
    copies = F.when(
        F.col("offset") % 20 == 0,
        F.array(F.lit(0), F.lit(1)),
    ).otherwise(F.array(F.lit(0)))
    return (
        rows.withColumn("_copy", F.explode(copies))
        .withColumn("offset", F.col("offset") + F.col("_copy") * F.lit(1_000_000_000_000))
        .withColumn("voltage_v", F.col("voltage_v") + F.col("_copy"))
        .drop("_copy")
    )


def system_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running message count, one sample per minute (minutes are few: the span of the data)."""
    from pyspark.sql import Window

    per_minute = (
        telemetry(spark, sf_dir)
        .groupBy(F.date_trunc("minute", "time").alias("time"))
        .agg(F.count("*").alias("_n"))
    )
    running = F.sum("_n").over(Window.partitionBy(F.lit("received")).orderBy("time"))
    return per_minute.select(
        "time",
        F.lit("counter.messages.received").alias("metric_name"),
        running.cast("double").alias("metric_value"),
    )


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("operation"),
        F.col("value").alias("value_ms"),
        F.col("event_id").alias("offset"),
    )


def rule_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the shipped rules on telemetry, as stored events."""
    hits = rule_ops.evaluate(arrivals(spark, sf_dir), shipped_rules())
    return rule_ops.to_events(hits).withColumn("acknowledged", F.col("offset") % 3 == 0)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals(spark, sf_dir).withColumn(
        "kind",
        F.when(F.col("voltage_v") == 180.0, "undervoltage")
        .when(F.col("voltage_v") == 260.0, "overvoltage")
        .otherwise("normal"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic stand-in scores, so that score consumers have an oracle."""
    return labelled(spark, sf_dir).selectExpr(
        "*",
        "CASE WHEN kind = 'normal' THEN 0.30D + (sequence_no * 17 % 300) / 1000.0D"
        " ELSE 0.50D + (sequence_no * 29 % 300) / 1000.0D END AS anomaly_score",
        "0.55D AS threshold",
        "'iforest_v1' AS model_version",
    ).withColumn("is_anomaly", F.col("anomaly_score") > F.col("threshold"))


def quality_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import validate

    checked = validate.validate_messages(validate.route(messages(spark, sf_dir)))
    return validate.quality_rows(checked)


def waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey % 50 AS device_id",
        "l_orderkey AS window_id",
        "l_linenumber AS k",
        "CAST(2048 + l_partkey % 1000 AS INT) AS v_raw",
        "CAST(2048 + l_suppkey % 100 AS INT) AS i_raw",
    )


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critical events times channels, in mixed delivery states."""
    base = F.col("offset")
    return (
        rule_events(spark, sf_dir)
        .where(F.col("severity") == "CRITICAL")
        .select("*", F.posexplode(F.array(*[F.lit(c) for c in CHANNELS])).alias("_p", "channel"))
        .select(
            (base * 4 + F.col("_p")).alias("outbox_id"),
            base.alias("event_id"),
            "channel",
            "device_id",
            F.element_at(
                F.array(*[F.lit(s) for s in ("pending", "failed", "processing", "sent")]),
                (base % 4 + 1).cast("int"),
            ).alias("status"),
            (base % 6).cast("int").alias("attempts"),
            add_seconds("time", (base % 7) * 60).alias("next_attempt_at"),
            F.lit(None).cast("string").alias("last_error"),
            F.when(base % 4 == 2, F.col("time")).alias("locked_at"),
            F.when(base % 4 == 3, F.col("time")).alias("sent_at"),
            F.col("time").alias("created_at"),
            F.col("time").alias("updated_at"),
        )
    )


def delivery_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each claimed row: ok, error or an exception."""
    return outbox(spark, sf_dir).where("status = 'processing'").selectExpr(
        "outbox_id",
        "CASE WHEN outbox_id % 3 = 0 THEN 'ok' WHEN outbox_id % 3 = 1 THEN 'error'"
        " ELSE 'exception' END AS outcome",
        "CASE WHEN outbox_id % 3 = 1 THEN 'status=500' WHEN outbox_id % 3 = 2 THEN 'slack down'"
        " END AS response",
    )


def stored_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices known before this run: a third of all keys, one for each customer, some with nulls."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('house_', lpad(CAST(c_custkey * 3 AS STRING),"
        " greatest(4, length(CAST(c_custkey * 3 AS STRING))), '0')) AS device_id",
        "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS location",
        "'energy_node' AS device_type",
        "CASE WHEN c_custkey % 4 = 0 THEN 'fw-stored' END AS firmware_version",
        "'unknown' AS status",
        "CAST(NULL AS TIMESTAMP) AS last_seen_at",
        "TIMESTAMP '2023-12-31 00:00:00' AS created_at",
        "TIMESTAMP '2023-12-31 00:00:00' AS updated_at",
    )

