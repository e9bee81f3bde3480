"""Each check of a message is made once, and numbers are told from text as before."""
from __future__ import annotations

import json
import re

from wattlane.operators import validate
from wattlane.schemas import MESSAGE

KEY = "spark.sql.debug.maxToStringFields"


def _checked(spark, *bodies):
    rows = [("energy/a/telemetry", bytearray(b, "utf-8"), i) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "topic string, payload binary, offset long").selectExpr(
        "topic", "payload", "timestamp '2024-01-01 00:00:01' AS received_at", "offset")
    assert {f.strip().split()[0] for f in MESSAGE.split(",")} == set(df.columns)
    return validate.validate_messages(validate.route(df))


def _body(**values):
    return json.dumps({"schema_version": "1.0", "device_id": "a", "timestamp": "2024-01-01T00:00:00Z",
                       "voltage_v": 220.0, "current_a": 1.0, "power_w": 220.0} | values)


def test_each_check_is_made_once(spark):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, "100000")
    try:
        plan = _checked(spark, _body())._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(KEY, before)
    assert len(re.findall(r"device_id#\d+ = topic_device#\d+", plan)) == 1


def test_numbers_and_what_looks_like_them(spark):
    values = [1, 1.5, 12345678901234567890123, 1e30, True, "1.5", " 2 ", "1e2", "0x1p3", "1.5f", "", None, [1], {"a": 1}]
    found = {r.offset: (r.temperature_c, r.sequence_no, r.error_type, r.error_field) for r in _checked(
        spark, *[_body(temperature_c=v) for v in values], *[_body(sequence_no=v) for v in values]).collect()}
    n, bad = len(values), "schema_validation_error"
    assert [found[i][0] for i in range(n)] == [1.0, 1.5, 12345678901234567890123.0, 1e30, 1.0, 1.5, 2.0, 100.0, *[None] * 6]
    assert [found[i][2:] for i in (8, 9, 10, 12, 13)] == [(bad, "temperature_c")] * 5 and found[11][2:] == (None, None)
    assert [found[n + i][1] for i in range(n)] == [1, None, None, None, 1, None, 2, 100, *[None] * 6]
    assert [found[n + i][2:] for i in (1, 3, 8, 12, 13)] == [(bad, "sequence_no")] * 5


def test_an_error_has_its_text_and_field(spark):
    found = {r.offset: r for r in _checked(spark, _body(), _body(voltage_v=999), _body(device_id="b"), _body(power_w=None), "no").collect()}
    assert [found[i].error_type for i in range(5)] == [
        None, "voltage_out_of_range", "device_id_mismatch", "schema_validation_error", "invalid_json"]
    assert [found[i].error_field for i in range(5)] == [None, None, None, "power_w", None]
    assert found[0].error_message is None and found[3].error_message == "power_w: missing or malformed"
