"""Ordered per-key primitives that never need all rows of a key in one task.

Rows of a key are cut into fixed slots of the order column (time or offset).
Work inside a slot is a window over (key, slot); what crosses slots goes
through one small row per (key, slot), built with partial aggregation.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import micros, slot

HOUR_US = 3_600_000_000
OFFSET_SPAN = 1 << 20


def first_arrival(df: DataFrame, keys: Sequence[str], order: str, copies: str | None = None) -> DataFrame:
    """First row per key by ``order``; optionally the number of rows seen.

    An aggregate, not a window: copies of one key are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    picked = F.min_by(F.struct(F.col(order), *[F.col(c) for c in rest]), order).alias("_r")
    aggs = [picked] + ([F.count("*").alias(copies)] if copies else [])
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns],
                      *([copies] if copies else []))


def latest(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Last row per key by ``order`` (ties broken by the later columns)."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(o) for o in order])
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), rank).alias("_r"))
    return out.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def _edge(df: DataFrame, keys: Sequence[str], values: Sequence[str], backward: bool) -> DataFrame:
    """Per (key, slot): the nearest edge row of the neighbouring non-empty slot."""
    pick = F.max if backward else F.min
    edge = df.groupBy(*keys, "_slot").agg(
        pick(F.struct(F.col("_t"), F.col("_tie"), *[F.col(v) for v in values])).alias("_e")
    )
    w = Window.partitionBy(*keys).orderBy("_slot")
    return edge.select(*keys, "_slot", (F.lag if backward else F.lead)("_e").over(w).alias("_edge"))


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: str,
    values: Sequence[str],
    *,
    backward: bool = True,
    prefix: str = "previous_",
    slot_us: int = HOUR_US,
) -> DataFrame:
    """``lag``/``lead`` of ``values`` per key in (time, tie) order, cut by time slots."""
    t = micros(time) if dict(df.dtypes)[time].startswith("timestamp") else F.col(time)
    rows = df.withColumn("_t", t).withColumn("_tie", F.col(tie)).withColumn("_slot", slot(F.col("_t"), slot_us))
    w = Window.partitionBy(*keys, "_slot").orderBy("_t", "_tie")
    near = (F.lag if backward else F.lead)(
        F.struct(F.col("_t"), F.col("_tie"), *[F.col(v) for v in values])
    ).over(w)
    joined = rows.withColumn("_near", near).join(_edge(rows, keys, values, backward), [*keys, "_slot"], "left")
    best = F.coalesce(F.col("_near"), F.col("_edge"))
    return joined.select(
        *df.columns, *[best.getField(v).alias(f"{prefix}{v}") for v in values]
    )


def keyed_index(
    df: DataFrame, keys: Sequence[str], seq: str, name: str = "n", *, total: str | None = None,
    span: int = OFFSET_SPAN,
) -> DataFrame:
    """1-based position of each row within its key, in ``seq`` order.

    ``seq`` is a unique number, so a (key, slot) group has at most ``span`` rows.
    """
    rows = df.withColumn("_slot", slot(F.col(seq).cast("long"), span))
    counts = rows.groupBy(*keys, "_slot").agg(F.count("*").alias("_c"))
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *keys, "_slot",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
        *([F.sum("_c").over(per_key).alias(total)] if total else []),
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy(seq))
    return (
        rows.withColumn("_k", local)
        .join(starts.toDF(*[f"_s_{c}" if c in (*keys, "_slot") else c for c in starts.columns]), _same([*keys, "_slot"]))
        .select(*df.columns, (F.col("_before") + F.col("_k")).alias(name), *([total] if total else []))
    )


def _same(keys: Sequence[str]):
    """Join condition of keys with their ``_s_`` copies; null keys are a key of their own."""
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys])


def newest(df: DataFrame, keys: Sequence[str], order: str, n: int, *, salts: int = 64) -> DataFrame:
    """Newest ``n`` rows per key.  Salted first cut, so a final group has at most salts*n rows."""
    salt = F.pmod(F.xxhash64(order), F.lit(salts))
    first = Window.partitionBy(*keys, "_salt").orderBy(F.col(order).desc())
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return (
        df.withColumn("_salt", salt)
        .withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= n)
        .withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= n)
        .drop("_salt", "_k")
    )



def exact_quantiles(
    df: DataFrame, column: str, quantiles: Sequence[float], *, accuracy: int = 100_000
) -> DataFrame:
    """Exact quantiles (linear interpolation) as rows (quantile, value).

    A bounded sketch brackets each quantile; only the distinct values inside a
    bracket (about 4/accuracy of the rows) are then counted and ranked.  A value
    shared by many rows is one counted row.
    """
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull()).select(x.alias("x"))
    n = rows.count()
    if n == 0:
        return rows.select(F.lit(0.0).alias("quantile"), F.col("x").alias("value"))
    margin = 2.0 / accuracy + 2.0 / n
    points = [p for q in quantiles for p in (max(q - margin, 0.0), min(q + margin, 1.0))]
    bounds = rows.agg(F.percentile_approx("x", points, accuracy).alias("b")).first()["b"]
    brackets = [(i, q, bounds[2 * i], bounds[2 * i + 1]) for i, q in enumerate(quantiles)]
    inside = F.filter(
        F.array(*[F.when((F.col("x") >= lo) & (F.col("x") <= hi), F.lit(i)) for i, _, lo, hi in brackets]),
        lambda i: i.isNotNull(),
    )
    counted = rows.select("x", F.explode(inside).alias("i")).groupBy("i", "x").agg(F.count("*").alias("c"))
    below = rows.agg(*[F.count_if(F.col("x") < lo).alias(f"b{i}") for i, _, lo, _ in brackets]).selectExpr(
        f"stack({len(brackets)}, "
        + ", ".join(f"{i}, {q}D, {int((n - 1) * q)}L, {(n - 1) * q - int((n - 1) * q)!r}D, b{i}" for i, q, _, _ in brackets)
        + ") AS (i, quantile, k, f, below)"
    )
    reach = F.sum("c").over(Window.partitionBy("i").orderBy("x")) + F.col("below")
    return (
        counted.join(below, "i")
        .withColumn("reach", reach)
        .groupBy("quantile", "f")
        .agg(
            F.min(F.when(F.col("reach") >= F.col("k") + 1, F.col("x"))).alias("lo"),
            F.min(F.when(F.col("reach") >= F.col("k") + 2, F.col("x"))).alias("hi"),
        )
        .select(
            "quantile",
            (F.col("lo") + F.col("f") * (F.coalesce("hi", "lo") - F.col("lo"))).alias("value"),
        )
    )
