"""Greedy chains: the next pick is the first row a fixed span after the last pick.

Cooldowns and size-or-time batches both have this form, and both depend on the
last *picked* row, so ``lag`` cannot express them.  Folding a whole key in one
task would fail on a hot key.  Instead time is cut into blocks of ``fan`` spans:

* up: each (key, block) is reduced to a step function "first possible pick ->
  last pick in this block".  Only rows in the first span of a block can be its
  first pick, so a level holds about 1/fan of the rows of the level below.
* down: starting from the whole key, each block learns the threshold its first
  pick must reach; at the lowest level the picks themselves come out.

The number of levels is log_fan(time span / chain span).  A group never covers
more than ``fan`` spans of one key, whatever the key's share of the rows, and
``fan`` shrinks to 2 where a key is dense.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import slot
from ..session import cut_lineage
from .groups import sorted_groups

FAN = 16
BLOCK_ROWS = 2_000_000
_NONE = np.iinfo(np.int64).min
_FAR = np.iinfo(np.int64).max


def _find(times, counts, at_time, at_count):
    """Index of the first row that reaches either threshold."""
    by_time = np.searchsorted(times, at_time, side="left")
    by_count = np.searchsorted(counts, at_count, side="left")
    return np.minimum(by_time, by_count)


def _plus(values, step):
    """``values + step`` that saturates where ``step`` means "never"."""
    if step == _FAR:
        return np.full(np.shape(values), _FAR, dtype=np.int64)
    return values + step


def step_function(part: dict, span: int, rows: int, start: int) -> dict:
    """Compose a block's rows (or its children's step functions) into one."""
    et, en, xt, xn = part["et"], part["en"], part["xt"], part["xn"]
    size = len(et)
    here = np.arange(size)
    jump = _find(et, en, xt + span, _plus(xn, rows))
    jump = np.where(jump < size, jump, here)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    first = int(np.searchsorted(et, start + span, side="left")) + 1
    last = jump[:first]
    keep = np.append(last[1:] != last[:-1], True)  # largest entry of each distinct end
    picked = here[: len(last)][keep]
    return {"et": et[picked], "en": en[picked], "xt": xt[last[keep]], "xn": xn[last[keep]]}


def walk_children(part: dict, span: int, rows: int) -> dict:
    """Threshold of every child block, given the threshold of the parent."""
    child, et, en, xt, xn = part["child"], part["et"], part["en"], part["xt"], part["xn"]
    at_time, at_count = int(part["at_time"][0]), int(part["at_count"][0])
    bounds = np.flatnonzero(np.append(True, child[1:] != child[:-1]))
    ends = np.append(bounds[1:], len(child))
    out = []
    for lo, hi in zip(bounds, ends):
        out.append((child[lo], at_time, at_count))
        j = lo + int(_find(et[lo:hi], en[lo:hi], at_time, at_count))
        if j < hi:
            at_time = int(xt[j]) + span
            at_count = _FAR if rows == _FAR else int(xn[j]) + rows
    columns = np.array(out, dtype=np.int64).T
    return {"child": columns[0], "at_time": columns[1], "at_count": columns[2]}


def walk_rows(times, counts, span: int, rows: int, at_time: int, at_count: int) -> np.ndarray:
    """Index of the pick each row belongs to; -1 for a pick in an earlier block."""
    owner = np.full(len(times), -1, dtype=np.int64)
    j = int(_find(times, counts, at_time, at_count))
    while j < len(times):
        nxt = int(_find(times, counts, times[j] + span, _FAR if rows == _FAR else counts[j] + rows))
        owner[j:nxt] = j
        j = nxt
    return owner


def chains(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    span: int,
    *,
    index: str | None = None,
    rows: int | None = None,
    fan: int = FAN,
) -> DataFrame:
    """Each (keys, time[, index]) with the time and index of the pick it belongs to.

    ``time`` is a long (microseconds).  With ``rows``, a pick also ends after
    that many rows, and ``index`` is the row's position within its key.
    Without ``rows``, ``index`` is only carried along, and equal times of a key
    must be reduced to one row beforehand.
    """
    cap = _FAR if rows is None else rows
    names = [f"k{i}" for i in range(len(keys))]
    narrow = df.select(
        *[F.col(k).cast("string").alias(n) for k, n in zip(keys, names)],
        F.col(time).cast("long").alias("t"),
        (F.col(index) if index else F.lit(0)).cast("long").alias("n"),
    )
    narrow = cut_lineage(narrow)
    low, high, densest = (
        narrow.groupBy(*names, slot(F.col("t"), span))
        .agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("c"))
        .agg(F.min("a"), F.max("b"), F.max("c")).first()
    )
    # Narrower blocks for a dense key: a block should stay near BLOCK_ROWS rows.
    fan = max(2, min(fan, BLOCK_ROWS // max(densest or 1, 1)))
    key_schema = ", ".join(f"{n} string" for n in names)
    if low is None or high - low < span * fan:  # one block holds every key's rows
        base = narrow.withColumn("b0", F.lit(0).cast("long"))
        return _rows(base, names, list(keys), key_schema, span, cap, None)
    widths = [span * fan]
    while (high - low) // widths[-1] >= fan:
        widths.append(widths[-1] * fan)

    # Up: one level of step functions per block width.
    base = narrow.select(*names, "t", "n", slot(F.col("t"), widths[0]).alias("b0"))
    levels: list[DataFrame] = []
    below = base.select(*names, F.col("t").alias("et"), F.col("n").alias("en"),
                        F.col("t").alias("xt"), F.col("n").alias("xn"), F.col("b0").alias("block"))
    for depth, width in enumerate(widths):
        levels.append(_compose(below, names, key_schema, span, cap, width))
        if depth + 1 < len(widths):
            # Each level feeds the level above and its own walk down: keep it.
            levels[-1] = cut_lineage(levels[-1])
            below = levels[-1].withColumn("block", slot(F.col("block") * F.lit(width), widths[depth + 1]))

    # Down: the whole key starts with an open threshold.
    seeds = None
    for level in reversed(levels):
        seeds = _descend(level, names, key_schema, span, cap, seeds, fan)
    return _rows(base, names, list(keys), key_schema, span, cap, seeds)


def _open_count(cap: int) -> Column:
    return F.lit(_FAR if cap == _FAR else _NONE)


def _compose(below: DataFrame, names, key_schema, span, cap, width) -> DataFrame:
    return sorted_groups(
        below, [*names, "block"], ["et", "en"],
        lambda key, part: step_function(part, span, cap, int(key[-1]) * width),
        f"{key_schema}, block long, et long, en long, xt long, xn long",
    )


def _descend(level: DataFrame, names, key_schema, span, cap, seeds, fan) -> DataFrame:
    """Thresholds of the blocks of ``level`` from those of their parents."""
    kids = level.withColumnRenamed("block", "child")
    walked = f"{key_schema}, parent long, child long, at_time long, at_count long"
    if seeds is None:
        kids = kids.withColumn("parent", F.lit(0).cast("long")).withColumn("at_time", F.lit(_NONE)).withColumn(
            "at_count", _open_count(cap)
        )
    else:
        kids = kids.withColumn("parent", slot(F.col("child"), fan)).join(
            seeds.withColumnRenamed("child", "parent"), [*names, "parent"]
        )
    return sorted_groups(
        kids, [*names, "parent"], ["et", "en"], lambda key, part: walk_children(part, span, cap), walked
    ).drop("parent")


def _rows(base: DataFrame, names, keys, key_schema, span, cap, seeds) -> DataFrame:
    if seeds is None:
        tagged = base.withColumn("at_time", F.lit(_NONE)).withColumn("at_count", _open_count(cap))
    else:
        tagged = base.join(seeds.withColumnRenamed("child", "b0"), [*names, "b0"])

    def walk(key, part):
        t, n = part["t"], part["n"]
        at_time, at_count = int(part["at_time"][0]), int(part["at_count"][0])
        owner = walk_rows(t, n, span, cap, at_time, at_count)
        earlier_t = at_time - span if at_time != _NONE else 0
        earlier_n = at_count - cap if cap != _FAR and at_count != _NONE else 0
        return {
            "t": t, "n": n,
            "pick_t": np.where(owner >= 0, t[owner], earlier_t),
            "pick_n": np.where(owner >= 0, n[owner], earlier_n),
        }

    out = sorted_groups(
        tagged, [*names, "b0"], ["t", "n"], walk,
        f"{key_schema}, b0 long, t long, n long, pick_t long, pick_n long",
    )
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "t", "n", "pick_t", "pick_n")
