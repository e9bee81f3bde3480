"""Cooldowns over intervals: something fires at ``max(start, ready)`` if that is before ``until``.

``ready`` is one cooldown after the last firing, so each decision depends on the ones before.
Each interval is a function from the old ``ready`` to the new one, and so is a row of intervals:
it is made of pieces, on each of which the result is either constant or the argument plus a
number. Such functions compose, so no device is folded in one task:

* up: the intervals of each block of time (``fan`` cooldowns of one key) become one function,
  then the functions of ``fan`` blocks become one, up to the whole span;
* down: from the open start, each block gets the ``ready`` it begins with; at the lowest level
  the firings come out.

Intervals of a key are disjoint and at least a timeout apart, so a block holds a bounded number
of them, whatever share of the rows the key has.
"""
from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import slot
from ..session import cut_lineage
from .groups import sorted_groups

FAN = 16
OPEN = np.iinfo(np.int64).min
#: (from, whether the argument is added, number); each piece reaches to the next one's start.
Piece = tuple[int, bool, int]
_END = np.iinfo(np.int64).max


def _merged(pieces: list[Piece]) -> list[Piece]:
    out: list[Piece] = []
    for piece in pieces:
        if not out or out[-1][1:] != piece[1:]:
            out.append(piece)
    return out


def apply(pieces: list[Piece], ready: int) -> int:
    _, moves, number = pieces[bisect_right(pieces, ready, key=lambda p: p[0]) - 1]
    return ready + number if moves else number


def then(first: list[Piece], second: list[Piece]) -> list[Piece]:
    """The pieces of ``second`` after ``first``."""
    out: list[Piece] = []
    for k, (low, moves, number) in enumerate(first):
        if not moves:
            out.append((low, False, apply(second, number)))
            continue
        high = first[k + 1][0] if k + 1 < len(first) else _END
        at = bisect_right(second, low + number if low != OPEN else OPEN, key=lambda p: p[0]) - 1
        for start, further, more in second[at:]:
            begin = low if start == OPEN else max(low, start - number)
            if begin >= high:
                break
            out.append((begin, True, number + more) if further else (begin, False, more))
    return _merged(out)


def of_interval(start: int, until: int, cooldown: int) -> list[Piece]:
    return [(OPEN, False, start + cooldown), (start + 1, True, cooldown), (until, True, 0)]


def block_pieces(part: dict, cooldown: int) -> list[Piece]:
    """The function of a row of intervals.

    An earlier firing lies before the first start, as intervals are disjoint, so ``ready`` is
    less than a cooldown after it; beyond that the function is not needed.
    """
    pieces: list[Piece] = [(OPEN, True, 0)]
    first = int(part["start"][0])
    for start, until in zip(part["start"].tolist(), part["until"].tolist(), strict=True):
        pieces = [p for p in then(pieces, of_interval(start, until, cooldown)) if p[0] <= first + cooldown]
    return pieces


def _columns(pieces: list[Piece]) -> dict:
    low, moves, number = zip(*pieces, strict=True)
    return {"low": np.array(low, np.int64), "moves": np.array(moves, bool), "number": np.array(number, np.int64)}


def _children(part: dict) -> list[tuple[int, list[Piece]]]:
    """The functions of the blocks in a group, in order of time."""
    out: list[tuple[int, list[Piece]]] = []
    for child, low, moves, number in zip(*(part[c].tolist() for c in ("child", "low", "moves", "number")), strict=True):
        if not out or out[-1][0] != child:
            out.append((child, []))
        out[-1][1].append((low, moves, number))
    return out


def _join(part: dict) -> dict:
    children = _children(part)
    pieces = children[0][1]
    for _, more in children[1:]:
        pieces = then(pieces, more)
    return _columns(pieces)


def _hand_down(part: dict) -> dict:
    ready, out = int(part["ready"][0]), []
    for child, pieces in _children(part):
        out.append((child, ready))
        ready = apply(pieces, ready)
    child, at = np.array(out, np.int64).T
    return {"child": child, "ready": at}


def fire(part: dict, cooldown: int) -> dict:
    """The firings of one block's intervals: positions and times."""
    ready, rows, at = int(part["ready"][0]), [], []
    for i, (start, until) in enumerate(zip(part["start"].tolist(), part["until"].tolist(), strict=True)):
        when = max(start, ready)
        if when < until:
            rows.append(i)
            at.append(when)
            ready = when + cooldown
    return {"start": part["start"][rows], "until": part["until"][rows], "at": np.array(at, np.int64)}


def firings(df: DataFrame, key: str, cooldown: int, *, fan: int = FAN) -> DataFrame:
    """(key, start, until, at): the intervals (key, start, until) that fire, and when.

    Times are long integers. Intervals of a key must be disjoint.
    """
    base = cut_lineage(df.select(F.col(key).cast("string").alias("k"), "start", "until"))
    low, high = base.agg(F.min("start"), F.max("start")).first()
    widths = [max(1, cooldown) * fan]
    while low is not None and (high - low) // widths[-1] >= fan:
        widths.append(widths[-1] * fan)

    blocks = base.withColumn("block", slot(F.col("start"), widths[0]))
    pieces = "k string, block long, low long, moves boolean, number long"
    levels = [cut_lineage(sorted_groups(
        blocks, ["k", "block"], ["start"], lambda _, part: _columns(block_pieces(part, cooldown)), pieces))]
    for below, width in zip(widths, widths[1:], strict=False):
        grouped = levels[-1].withColumnRenamed("block", "child").withColumn("block", slot(F.col("child") * F.lit(below), width))
        levels.append(cut_lineage(sorted_groups(grouped, ["k", "block"], ["child", "low"], lambda _, part: _join(part), pieces)))

    # The topmost blocks of a key, at most ``fan`` and one, are handed down from the open start.
    ready = None
    for level, width, above in zip(reversed(levels), reversed(widths), [None, *reversed(widths[1:])], strict=True):
        kids = level.withColumnRenamed("block", "child")
        if ready is None:
            kids = kids.withColumn("parent", F.lit(0).cast("long")).withColumn("ready", F.lit(OPEN))
        else:
            kids = kids.withColumn("parent", slot(F.col("child") * F.lit(width), above)).join(
                ready.withColumnRenamed("child", "parent"), ["k", "parent"])
        ready = sorted_groups(kids, ["k", "parent"], ["child", "low"], lambda _, part: _hand_down(part),
                              "k string, parent long, child long, ready long").drop("parent")
    begun = blocks.join(ready.withColumnRenamed("child", "block"), ["k", "block"])
    out = sorted_groups(begun, ["k", "block"], ["start"], lambda _, part: fire(part, cooldown),
                        "k string, block long, start long, until long, at long")
    return out.select(F.col("k").alias(key), "start", "until", "at")
