"""Message routing and validation: one pass, one error per invalid message.

Bad input never raises.  Every check is a column expression, so the whole
chain is a single projection over the message stream (batch or streaming).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import natural_id, seconds_between, topic_device, topic_type
from ..schemas import MESSAGE_TYPES, SEVERITIES, STATUS_VALUES
from ..settings import Settings

# Message fields by kind, in the order they are checked.
TEXT_FIELDS = ("firmware_version", "ip_address", "reason", "message", "event_type", "severity", "status")
NUMBER_FIELDS = ("voltage_v", "current_a", "power_w", "temperature_c", "rssi_dbm")
FIELD_ORDER = {
    "telemetry": ("schema_version", "device_id", "timestamp", "voltage_v", "current_a", "power_w",
                  "temperature_c", "sequence_no", "firmware_version", "rssi_dbm"),
    "status": ("schema_version", "device_id", "timestamp", "status", "firmware_version",
               "ip_address", "rssi_dbm", "reason"),
    "events": ("schema_version", "device_id", "timestamp", "event_type", "severity", "message"),
}
REQUIRED = ("schema_version", "device_id", "timestamp", "voltage_v", "current_a", "power_w",
            "status", "event_type")
RANGED = (
    ("voltage_v", "voltage", "voltage_range"),
    ("current_a", "current", "current_range"),
    ("power_w", "power", "power_range"),
    ("temperature_c", "temperature", "temperature_range"),
)
# Largest number read as seconds since the epoch; beyond it, milliseconds.
SECONDS_LIMIT = 2e10

_ALL = sorted({f for fields in FIELD_ORDER.values() for f in fields})
#: White space that JSON allows around a document.
JSON_BLANKS = " \t\r\n"
#: Decimal numbers as text; a suffix or a hexadecimal form is no number.
NUMBER_TEXT = r"(?i)^\s*([+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?|[+-]?(nan|inf|infinity)|true|false)\s*$"
_PARSED = "ARRAY<STRUCT<" + ", ".join(f"`{f}` VARIANT" for f in _ALL) + ">>"


def parse_topic(messages: DataFrame) -> DataFrame:
    """Add topic_device and message_type; topics of another shape are dropped."""
    return (
        messages.withColumn("topic_device", topic_device("topic"))
        .withColumn("message_type", topic_type("topic"))
        .where(F.col("topic_device").isNotNull())
    )


def route(messages: DataFrame) -> DataFrame:
    """Keep the supported message types."""
    return parse_topic(messages).where(F.col("message_type").isin(*MESSAGE_TYPES))


def decode(messages: DataFrame) -> DataFrame:
    """Payload bytes to text (bad bytes replaced) and to JSON fields in ``doc``.

    The text is parsed as the only element of an array: that rejects anything
    after the object, and leaves null for text, numbers, arrays and broken JSON.
    Exploding the array keeps the parse in one place of the plan: once per row.
    """
    text = F.make_valid_utf8(F.col("payload").cast("string"))
    parsed = F.from_json(
        F.concat(F.lit("["), F.col("raw_payload"), F.lit("]")), _PARSED, {"allowSingleQuotes": "false"}
    )
    rows = messages.withColumn("raw_payload", text).withColumn("_a", parsed)
    single = F.when((F.size("_a") == 1) & F.rtrim("raw_payload", F.lit(JSON_BLANKS)).endswith("}"), F.col("_a"))
    return rows.select(*messages.columns, "raw_payload", F.explode_outer(single).alias("doc"))


def _kind(v: Column) -> Column:
    """Type name of a JSON value; VOID for null, SQL null if absent."""
    return F.schema_of_variant(v)


def _absent(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def _text(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.variant_get(v, "$", "string"))


def _number(v: Column) -> Column:
    """JSON numbers, booleans and numeric text as double; anything else null."""
    # Only text can look unlike a number and still be cast to one.
    plain = (_kind(v) != "STRING") | F.try_variant_get(v, "$", "string").rlike(NUMBER_TEXT)
    return F.when(plain, F.try_variant_get(v, "$", "double"))


def _whole(v: Column) -> Column:
    number = _number(v)
    exact = F.try_variant_get(v, "$", "bigint")
    return F.when(_kind(v) == "BIGINT", exact).when(number == F.floor(number), F.coalesce(exact, number.try_cast("bigint")))


def _instant(text: Column, number: Column) -> Column:
    """ISO-8601 text (no offset means UTC) or an epoch number, also as text.

    Shapes are tested first: a cast that fails costs far more than a pattern.
    """
    trimmed = F.trim(text)
    digits = F.when(trimmed.rlike(r"^[+-]?\d+(\.\d*)?$"), trimmed.try_cast("double"))
    value = F.coalesce(number, digits)
    seconds = F.when(F.abs(value) <= SECONDS_LIMIT, value).otherwise(value / 1000.0)
    epoch = F.timestamp_micros(F.round(seconds * 1e6).cast("bigint"))
    shaped = trimmed.rlike(
        r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*([Zz]|[+-]\d{2}:?\d{2})?)?$"
    )
    colon = F.when(
        trimmed.rlike(r"[+-]\d{4}$") & (F.length(trimmed) > 10), F.regexp_replace(trimmed, r"(\d{2})$", ":$1")
    ).otherwise(trimmed)
    return F.when(shaped, F.upper(colon).try_cast("timestamp")).otherwise(epoch)


def _well_formed(name: str) -> Column:
    """Condition on the typed column of a present, non-null field."""
    value = F.col(name)
    if name == "schema_version":
        return F.col("_version_is_text")
    if name == "device_id":
        return F.length(value).between(1, 64)
    if name == "status":
        return value.isin(*STATUS_VALUES)
    if name == "severity":
        return value.isin(*SEVERITIES)
    if name in ("voltage_v", "current_a", "power_w"):
        return (value >= 0) & ~F.isnan(value)
    return (F.col("time") if name == "timestamp" else value).isNotNull()


def _field_error(name: str) -> Column:
    bad = ~F.coalesce(_well_formed(name), F.lit(False))
    if name in REQUIRED:
        return bad
    v = F.col(f"doc.{name}")
    # An optional field may be absent or null; a severity may only be absent.
    given = v.isNotNull() if name == "severity" else ~_absent(v)
    return given & bad


def _schema_error() -> Column:
    """Name of the first malformed field for the row's message type, or null."""
    out = None
    for kind, names in FIELD_ORDER.items():
        chain = None
        for name in names:
            cond = _field_error(name)
            chain = F.when(cond, name) if chain is None else chain.when(cond, name)
        test = F.col("message_type") == kind
        out = F.when(test, chain) if out is None else out.when(test, chain)
    return out


def typed(messages: DataFrame) -> DataFrame:
    """Typed columns of all message kinds (null where a field is absent or malformed)."""
    cols = [
        _text(F.col("doc.device_id")).alias("device_id"),
        _text(F.col("doc.timestamp")).alias("_time_text"),
        F.when(_kind(F.col("doc.timestamp")) != "STRING", _number(F.col("doc.timestamp"))).alias("_time_number"),
        *[_number(F.col(f"doc.{n}")).alias(n) for n in NUMBER_FIELDS],
        _whole(F.col("doc.sequence_no")).alias("sequence_no"),
        *[_text(F.col(f"doc.{n}")).alias(n) for n in TEXT_FIELDS if n != "severity"],
        F.when(F.col("doc.severity").isNull(), F.lit("INFO"))
        .otherwise(_text(F.col("doc.severity"))).alias("severity"),
        # A number is compared by its text, which keeps 1.0 apart from 1.
        F.coalesce(
            _text(F.col("doc.schema_version")), F.get_json_object("raw_payload", "$.schema_version"), F.lit("")
        ).alias("schema_version"),
        (_kind(F.col("doc.schema_version")) == "STRING").alias("_version_is_text"),
    ]
    raw = messages.select("*", *cols)
    timed = raw.withColumn("time", _instant(F.col("_time_text"), F.col("_time_number")))
    return timed.withColumn("schema_error", _schema_error()).drop("_version_is_text", "_time_text", "_time_number")


def classify(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """First failing check of each message as error_type, error_field, error_message."""
    is_telemetry = F.col("message_type") == "telemetry"
    skew = seconds_between("received_at", "time")
    verdict = None

    def add(cond: Column, name: str, message: Column) -> None:
        nonlocal verdict
        # Name and text in one value, so each check is made once and only a bad message has its text made.
        found = F.struct(F.lit(name).alias("error_type"), message.alias("error_message"))
        verdict = F.when(cond, found) if verdict is None else verdict.when(cond, found)

    add(F.col("doc").isNull(), "invalid_json",
        F.when(F.try_parse_json("raw_payload").isNull(), "invalid_json").otherwise("payload_not_object"))
    add(~F.col("schema_version").isin(*settings.supported_versions), "unsupported_schema_version",
        F.format_string("schema_version='%s' not in {%s}", "schema_version",
                        F.lit(", ".join(f"'{v}'" for v in settings.supported_versions))))
    add(F.col("schema_error").isNotNull(), "schema_validation_error",
        F.concat(F.col("schema_error"), F.lit(": missing or malformed")))
    add(F.col("device_id") != F.col("topic_device"), "device_id_mismatch",
        F.format_string("topic device_id='%s' != payload device_id='%s'", "topic_device", "device_id"))
    for field, short, setting in RANGED:
        low, high = getattr(settings, setting)
        value = F.col(field)
        add(is_telemetry & value.isNotNull() & ~value.between(low, high), f"{short}_out_of_range",
            F.concat(F.lit(f"{field}="), value.cast("string"), F.lit(f" outside [{low}, {high}]")))
    timed = F.col("message_type").isin("telemetry", "status")
    add(timed & (skew < -settings.max_future_skew_seconds), "timestamp_future_skew",
        F.format_string("timestamp %.1fs in the future", -skew))
    add(timed & (skew > settings.max_past_skew_seconds), "timestamp_past_skew",
        F.format_string("timestamp %.1fs in the past", skew))
    # One row per message; the explode keeps later filters from repeating the checks.
    judged = rows.select("*", F.explode(F.array(verdict)).alias("_v")).select("*", "_v.*").drop("_v")
    return judged.withColumn("error_field", F.when(F.col("error_type") == "schema_validation_error", F.col("schema_error")))


def validate_messages(routed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Decode, type and classify routed messages."""
    return classify(typed(decode(routed)), settings).drop("doc", "schema_error")


def valid(checked: DataFrame, kind: str) -> DataFrame:
    return checked.where(F.col("error_type").isNull() & (F.col("message_type") == kind))


def valid_readings(checked: DataFrame) -> DataFrame:
    return valid(checked, "telemetry").select(
        "offset", "received_at", "time", "device_id", "voltage_v", "current_a", "power_w",
        "temperature_c", "sequence_no", "firmware_version", "raw_payload",
    )


def valid_status(checked: DataFrame) -> DataFrame:
    return valid(checked, "status").select(
        "offset", "received_at", "time", "device_id", "status", "firmware_version",
        "ip_address", "rssi_dbm", "reason",
    )


def valid_device_events(checked: DataFrame) -> DataFrame:
    return valid(checked, "events").select(
        "offset", "received_at", "time", "device_id", "event_type", "severity", "message",
    )


def quality_rows(checked: DataFrame) -> DataFrame:
    """Dead-letter rows of the quality table."""
    return checked.where(F.col("error_type").isNotNull()).select(
        natural_id("topic", "offset", "error_type").alias("log_id"),
        F.col("received_at").alias("time"),
        "topic",
        F.when(F.col("error_type") != "invalid_json", F.col("device_id")).alias("device_id"),
        "error_type", "error_message", "raw_payload",
        F.col("received_at").alias("created_at"),
        "offset",
    )
