"""Column helpers shared by the operators.  All stay in the JVM."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000

# The six comparison names a rule may use.
COMPARISONS = {
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def compare(left: Column, operator: str, right: Column | float) -> Column:
    right = right if isinstance(right, Column) else F.lit(float(right))
    return COMPARISONS[operator](left.cast("double"), right)


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch, exact for any timestamp."""
    return F.unix_micros(col(c))


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(MICROS))


def minutes_between(later: Column | str, earlier: Column | str) -> Column:
    return seconds_between(later, earlier) / F.lit(60.0)


def add_seconds(c: Column | str, seconds: Column | float) -> Column:
    step = seconds * MICROS if isinstance(seconds, Column) else F.lit(int(seconds * MICROS))
    return F.timestamp_micros(micros(c) + step.cast("long"))


def slot(us: Column, width: int) -> Column:
    """Index of the fixed-width slot that holds ``us`` (floor, also below zero)."""
    w = F.lit(int(width)).cast("long")
    return F.call_function("div", us - F.pmod(us, w), w)


def decimal_round(c: Column | str, digits: int = 2) -> Column:
    """Round half up in decimal arithmetic, back to double."""
    return F.round(col(c).cast("decimal(38,10)"), digits).cast("double")


def percent_change(value: Column, base: Column) -> Column:
    return (value - base) / base * F.lit(100.0)


def iso(c: Column | str) -> Column:
    """ISO-8601 text with offset; fraction only when there is one."""
    c = col(c)
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(c, ".SSSSSS")
    return F.concat(
        whole, F.when(fraction == ".000000", F.lit("")).otherwise(fraction), F.lit("+00:00")
    )


def voltage_deviation(voltage: Column | str, nominal: float = 220.0) -> Column:
    return F.abs(col(voltage) - F.lit(float(nominal)))


def power_discrepancy(power: Column | str, voltage: Column | str, current: Column | str) -> Column:
    return col(power) - col(voltage) * col(current)


def natural_id(*parts: Column | str) -> Column:
    """Stable surrogate key: a replay of the same row gets the same id."""
    return F.xxhash64(*[col(p) for p in parts])


def topic_device(topic: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(topic), r"^energy/([^/]+)/([^/]+)$", 1), F.lit(""))


def topic_type(topic: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(topic), r"^energy/([^/]+)/([^/]+)$", 2), F.lit(""))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, zero where the denominator is zero."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))
