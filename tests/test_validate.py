"""Message parsing and validation cases."""
from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

import pytest

from wattlane.operators import validate
from wattlane.settings import Settings

NOW = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)
GOOD = {
    "schema_version": "1.0", "device_id": "house_0001", "timestamp": NOW.isoformat(),
    "voltage_v": 220.0, "current_a": 2.0, "power_w": 440.0,
}
STATUS = {"schema_version": "1.0", "device_id": "house_0001", "timestamp": NOW.isoformat(), "status": "online"}
EVENT = {"schema_version": "1.0", "device_id": "house_0001", "timestamp": NOW.isoformat(), "event_type": "BUTTON"}


def text(base, drop=(), **changes):
    return json.dumps({k: v for k, v in {**base, **changes}.items() if k not in drop})


ABOVE = (NOW + timedelta(hours=2)).isoformat()
BEFORE = (NOW - timedelta(days=10)).isoformat()
# (kind, payload, error_type, error_field)
CASES = {
    "good": ("telemetry", text(GOOD), None, None),
    "version": ("telemetry", text(GOOD, schema_version="99.0"), "unsupported_schema_version", None),
    "no version": ("telemetry", text(GOOD, drop=("schema_version",)), "unsupported_schema_version", None),
    "whole version": ("telemetry", text(GOOD, schema_version=1), "unsupported_schema_version", None),
    "numeric version": ("telemetry", text(GOOD, schema_version=1.0), "schema_validation_error", "schema_version"),
    "voltage": ("telemetry", text(GOOD, voltage_v=999), "voltage_out_of_range", None),
    "voltage bound": ("telemetry", text(GOOD, voltage_v=300), None, None),
    "current": ("telemetry", text(GOOD, current_a=200), "current_out_of_range", None),
    "power": ("telemetry", text(GOOD, power_w=99_999_999), "power_out_of_range", None),
    "temperature": ("telemetry", text(GOOD, temperature_c=300), "temperature_out_of_range", None),
    "cold": ("telemetry", text(GOOD, temperature_c=-20), None, None),
    "null temperature": ("telemetry", text(GOOD, temperature_c=None), None, None),
    "other device": ("telemetry", text(GOOD, device_id="house_0002"), "device_id_mismatch", None),
    "future": ("telemetry", text(GOOD, timestamp=ABOVE), "timestamp_future_skew", None),
    "past": ("telemetry", text(GOOD, timestamp=BEFORE), "timestamp_past_skew", None),
    "skew bounds": ("telemetry", text(GOOD, timestamp=(NOW + timedelta(seconds=60)).isoformat()), None, None),
    "naive time": ("telemetry", text(GOOD, timestamp="2024-05-01T12:00:00"), None, None),
    "offset time": ("telemetry", text(GOOD, timestamp="2024-05-01T14:00:00+02:00"), None, None),
    "epoch time": ("telemetry", text(GOOD, timestamp=int(NOW.timestamp())), None, None),
    "epoch millis": ("telemetry", text(GOOD, timestamp=str(int(NOW.timestamp()) * 1000)), None, None),
    "bad time": ("telemetry", text(GOOD, timestamp="soon"), "schema_validation_error", "timestamp"),
    "no power": ("telemetry", text(GOOD, drop=("power_w",)), "schema_validation_error", "power_w"),
    "null power": ("telemetry", text(GOOD, power_w=None), "schema_validation_error", "power_w"),
    "negative": ("telemetry", text(GOOD, voltage_v=-1), "schema_validation_error", "voltage_v"),
    "number as text": ("telemetry", text(GOOD, voltage_v="220.5"), None, None),
    "word as number": ("telemetry", text(GOOD, voltage_v="high"), "schema_validation_error", "voltage_v"),
    "not a number": ("telemetry", text(GOOD, voltage_v=float("nan")), "schema_validation_error", "voltage_v"),
    "list as number": ("telemetry", text(GOOD, power_w=[1]), "schema_validation_error", "power_w"),
    "fractional sequence": ("telemetry", text(GOOD, sequence_no=1.5), "schema_validation_error", "sequence_no"),
    "whole sequence": ("telemetry", text(GOOD, sequence_no=7.0), None, None),
    "numeric firmware": ("telemetry", text(GOOD, firmware_version=3), "schema_validation_error", "firmware_version"),
    "long device": ("telemetry", text(GOOD, device_id="x" * 65), "schema_validation_error", "device_id"),
    "numeric device": ("telemetry", text(GOOD, device_id=5), "schema_validation_error", "device_id"),
    "first error wins": ("telemetry", text(GOOD, voltage_v=999, current_a=200, timestamp=ABOVE), "voltage_out_of_range", None),
    "extra field": ("telemetry", text(GOOD, note={"a": [1, 2]}), None, None),
    "no json": ("telemetry", "not json", "invalid_json", None),
    "empty": ("telemetry", "", "invalid_json", None),
    "list": ("telemetry", f"[{text(GOOD)}]", "invalid_json", None),
    "word": ("telemetry", '"text"', "invalid_json", None),
    "trailing": ("telemetry", text(GOOD) + " x", "invalid_json", None),
    "two objects": ("telemetry", text(GOOD) + "," + text(GOOD), "invalid_json", None),
    "bracket": ("telemetry", text(GOOD) + "]", "invalid_json", None),
    "status": ("status", text(STATUS, reason="x", rssi_dbm=-60), None, None),
    "status word": ("status", text(STATUS, status="asleep"), "schema_validation_error", "status"),
    "status past": ("status", text(STATUS, timestamp=BEFORE), "timestamp_past_skew", None),
    "event": ("events", text(EVENT, severity="CRITICAL"), None, None),
    "event default": ("events", text(EVENT), None, None),
    "event null severity": ("events", text(EVENT, severity=None), "schema_validation_error", "severity"),
    "event severity": ("events", text(EVENT, severity="LOUD"), "schema_validation_error", "severity"),
    "event past": ("events", text(EVENT, timestamp=BEFORE), None, None),
    "event type": ("events", text(EVENT, drop=("event_type",)), "schema_validation_error", "event_type"),
}


@pytest.fixture(scope="module")
def results(spark):
    rows = [
        (f"energy/house_0001/{kind}", payload.encode(), NOW, i)
        for i, (kind, payload, _, _) in enumerate(CASES.values())
    ]
    df = spark.createDataFrame(rows, "topic STRING, payload BINARY, received_at TIMESTAMP, offset LONG")
    out = validate.validate_messages(validate.route(df), Settings()).collect()
    return {list(CASES)[r.offset]: r for r in out}


@pytest.mark.parametrize("name", list(CASES))
def test_case(results, name):
    _, _, error, field = CASES[name]
    got = results[name]
    assert (got.error_type, got.error_field) == (error, field)
    assert (got.error_message is None) == (error is None)


def test_typed_values(results):
    assert results["number as text"].voltage_v == 220.5
    assert results["whole sequence"].sequence_no == 7
    assert results["event default"].severity == "INFO"
    assert results["list"].error_message == "payload_not_object"
    for name in ("offset time", "epoch time", "epoch millis", "naive time"):
        assert results[name].time.replace(tzinfo=timezone.utc) == NOW


def test_bad_bytes_are_replaced(spark):
    raw = text(GOOD, firmware_version="@").encode().replace(b"@", b"\xff")
    df = spark.createDataFrame(
        [("energy/house_0001/telemetry", raw, NOW, 1)],
        "topic STRING, payload BINARY, received_at TIMESTAMP, offset LONG",
    )
    got = validate.validate_messages(validate.route(df)).first()
    assert got.error_type is None and got.firmware_version == "�"


def test_topics(spark):
    topics = ["energy/house_001/telemetry", "foo/bar", "energy", "", "energy/a/b/telemetry", "energy/h/commands"]
    df = spark.createDataFrame([(t, b"{}", NOW, i) for i, t in enumerate(topics)],
                               "topic STRING, payload BINARY, received_at TIMESTAMP, offset LONG")
    got = {(r.topic_device, r.message_type) for r in validate.parse_topic(df).collect()}
    assert got == {("house_001", "telemetry"), ("h", "commands")}
    assert [r.offset for r in validate.route(df).collect()] == [0]
