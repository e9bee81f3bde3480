"""Cooldowns over intervals against a fold."""
from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wattlane.operators import intervals


def fold(rows, cooldown, ready=intervals.OPEN):
    out = []
    for start, until in sorted(rows):
        at = max(start, ready)
        if at < until:
            out.append((start, until, at))
            ready = at + cooldown
    return out, ready


def _intervals(rng, n, gap, length, start=0):
    out, t = [], start
    for _ in range(n):
        t += rng.randrange(1, gap)
        until = t + rng.randrange(1, length)
        out.append((t, until))
        t = until
    return out


steps = st.lists(st.tuples(st.integers(1, 30), st.integers(1, 60)), min_size=1, max_size=25)


@settings(max_examples=300, deadline=None)
@given(steps, st.integers(1, 80), st.integers(0, 200), st.integers(0, 25))
def test_functions_of_parts_compose(rows, cooldown, ready, cut):
    made, t = [], 0
    for gap, length in rows:
        made.append((t + gap, t + gap + length))
        t += gap + length
    import numpy as np

    def pieces(part):
        return intervals.block_pieces({"start": np.array([r[0] for r in part]), "until": np.array([r[1] for r in part])}, cooldown)

    ready = min(ready, made[0][0] + cooldown - 1)
    want = fold(made, cooldown, ready)[1]
    assert intervals.apply(pieces(made), ready) == want
    if 0 < cut < len(made):
        assert intervals.apply(intervals.then(pieces(made[:cut]), pieces(made[cut:])), ready) == want


@pytest.mark.parametrize("seed,fan,cooldown", [(1, 2, 50), (2, 3, 17), (3, 16, 300), (4, 2, 1)])
def test_firings_over_all_levels(spark, seed, fan, cooldown):
    rng = random.Random(seed)
    keys = {f"d{i}": _intervals(rng, 30, 40, 80, -500) for i in range(5)}
    keys["hot"] = _intervals(rng, 800, 20, 60)  # most of all rows
    rows = [(k, a, b) for k, v in keys.items() for a, b in v]
    df = spark.createDataFrame(rows, "device string, start long, until long").repartition(4)
    got = intervals.firings(df, "device", cooldown, fan=fan).collect()
    want = [(k, *x) for k, v in keys.items() for x in fold(v, cooldown)[0]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_no_group_is_larger_than_a_block(spark, monkeypatch):
    """A device that never rests: each group holds the intervals of one block of time."""
    sizes = spark.sparkContext.accumulator(0)
    counted = spark.sparkContext.accumulator(0)

    whole = intervals.block_pieces

    def block_pieces(part, cooldown):
        n = len(part["start"])
        assert n <= 4 * 100 // 10 + 1
        counted.add(1)
        sizes.add(n)
        return whole(part, cooldown)

    monkeypatch.setattr(intervals, "block_pieces", block_pieces)
    df = spark.range(3_000).selectExpr("'hot' AS device", "id * 10 AS start", "id * 10 + 5 AS until")
    got = intervals.firings(df, "device", 100, fan=4).collect()
    assert sizes.value >= 3_000 and counted.value >= 75
    assert sorted(map(tuple, got)) == [("hot", *x) for x in fold([(i * 10, i * 10 + 5) for i in range(3_000)], 100)[0]]


def test_empty(spark):
    assert intervals.firings(spark.createDataFrame([], "device string, start long, until long"), "device", 10).count() == 0
