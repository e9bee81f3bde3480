"""Table and message schemas (column order follows the data model)."""
from __future__ import annotations

# Message and table columns, enumerations and defaults.
MESSAGE = "topic STRING, payload BINARY, received_at TIMESTAMP, offset BIGINT"
MESSAGE_TYPES = ("telemetry", "status", "events")
STATUS_VALUES = ("online", "offline", "maintenance", "error")
SEVERITIES = ("NORMAL", "INFO", "WARNING", "CRITICAL")
DEFAULT_DEVICE_TYPE = "energy_node"
DEFAULT_DEVICE_STATUS = "unknown"

DEVICES = (
    "device_id STRING, location STRING, device_type STRING, firmware_version STRING, "
    "status STRING, last_seen_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP"
)
READINGS = (
    "time TIMESTAMP, device_id STRING, voltage_v DOUBLE, current_a DOUBLE, power_w DOUBLE, "
    "temperature_c DOUBLE, sequence_no BIGINT, raw_payload STRING, created_at TIMESTAMP"
)
EVENTS = (
    "event_id BIGINT, time TIMESTAMP, device_id STRING, event_type STRING, severity STRING, "
    "rule_name STRING, message STRING, reading_time TIMESTAMP, event_value DOUBLE, "
    "threshold_value DOUBLE, metadata STRING, acknowledged BOOLEAN, created_at TIMESTAMP"
)
QUALITY_LOGS = (
    "log_id BIGINT, time TIMESTAMP, topic STRING, device_id STRING, error_type STRING, "
    "error_message STRING, raw_payload STRING, created_at TIMESTAMP"
)
STATUS_HISTORY = (
    "id BIGINT, time TIMESTAMP, device_id STRING, status STRING, firmware_version STRING, "
    "ip_address STRING, rssi_dbm DOUBLE, metadata STRING, created_at TIMESTAMP"
)
SYSTEM_METRICS = (
    "time TIMESTAMP, metric_name STRING, metric_value DOUBLE, labels STRING, created_at TIMESTAMP"
)
RULES = (
    "rule_name STRING, enabled BOOLEAN, event_type STRING, severity STRING, config STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)
DELIVERIES = (
    "alert_id BIGINT, event_id BIGINT, channel STRING, status STRING, response STRING, "
    "sent_at TIMESTAMP"
)
OUTBOX = (
    "outbox_id BIGINT, event_id BIGINT, channel STRING, payload STRING, status STRING, "
    "attempts INT, next_attempt_at TIMESTAMP, last_error STRING, locked_at TIMESTAMP, "
    "sent_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP"
)
PREDICTIONS = (
    "time TIMESTAMP, device_id STRING, model_version STRING, prediction_type STRING, "
    "anomaly_score DOUBLE, predicted_label STRING, input_window_start TIMESTAMP, "
    "input_window_end TIMESTAMP, metadata STRING, created_at TIMESTAMP"
)
# Mergeable parts of the one-minute table: sums, so that parts of one minute add up.
ROLLUP_PARTS = (
    "bucket TIMESTAMP, device_id STRING, voltage_sum DOUBLE, voltage_count BIGINT, current_sum DOUBLE, "
    "current_count BIGINT, power_sum DOUBLE, power_count BIGINT, max_power_w DOUBLE, min_voltage_v DOUBLE, "
    "sample_count BIGINT"
)
VERDICTS = (
    "time TIMESTAMP, device_id STRING, window_id BIGINT, offset BIGINT, recon_error DOUBLE, "
    "threshold DOUBLE, confirmed BOOLEAN"
)

# Natural keys, used for idempotent appends.
KEYS = {
    "energy_readings": ("time", "device_id"),
    "model_predictions": ("time", "device_id", "model_version", "prediction_type"),
    "alert_outbox": ("event_id", "channel"),
    "events": ("event_id",),
    "data_quality_logs": ("log_id",),
    "device_status_history": ("id",),
    "system_metrics": ("time", "metric_name"),
    "alert_deliveries": ("alert_id",),
    "reading_keys": ("time", "device_id"),
    "verdicts": ("device_id", "window_id", "offset"),
}

# The time column that partitions (by date) and ages each table.
TIME_COLUMNS = {
    "energy_readings": "time",
    "events": "time",
    "data_quality_logs": "time",
    "device_status_history": "time",
    "system_metrics": "time",
    "model_predictions": "time",
    "alert_deliveries": "sent_at",
    "alert_outbox": "created_at",
    "reading_keys": "time",
    "energy_readings_1min": "bucket",
    "verdicts": "time",
    "devices": "updated_at",
}
