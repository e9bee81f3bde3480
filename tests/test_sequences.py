"""Sequence operators against brute force, with small blocks to force every level."""
from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wattlane.operators import greedy, ordered, rules, sequences
from wattlane.sources.rules_config import shipped_rules

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(4)


def emitted(times, cooldown):
    out, last = [], None
    for t in sorted(times):
        if last is None or t - last >= cooldown:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("seed,keys,n,spread", [(1, 3, 400, 20_000), (2, 1, 600, 3_000), (3, 8, 200, 200_000)])
def test_cooldown_equals_fold_over_all_levels(spark, seed, keys, n, spread):
    rng = random.Random(seed)
    rows = [(f"d{rng.randrange(keys)}", at(rng.randrange(spread)), i) for i in range(n)]
    rows += [("d0", at(i * 7), n + i) for i in range(200)]  # a dense key
    df = frame(spark, rows, "device_id STRING, time TIMESTAMP, offset LONG")
    got = sequences.cooldown(df, ["device_id"], "time", "offset", 100, fan=3).collect()
    want = []
    for key in {r[0] for r in rows}:
        want += [(key, t) for t in emitted({r[1] for r in rows if r[0] == key}, timedelta(seconds=100))]
    assert sorted((r.device_id, r.time.replace(tzinfo=timezone.utc)) for r in got) == sorted(want)


def test_cooldown_fixed_case_and_null_key(spark):
    rows = [(None, at(s), i) for i, s in enumerate((0, 200, 310, 500, 610))]
    df = frame(spark, rows, "device_id STRING, time TIMESTAMP, offset LONG")
    got = sequences.cooldown(df, ["device_id"], "time", "offset", 300).select("offset").collect()
    assert sorted(r.offset for r in got) == [0, 2, 4]


def batch_ids(times, size, millis):
    ids, start, first, count = [], None, None, 0
    for i, t in enumerate(times, 1):
        if start is None or count >= size or t - first >= millis:
            start, first, count = i, t, 0
        ids.append(start)
        count += 1
    return ids


@pytest.mark.parametrize("seed,size,millis,gap", [(1, 4, 50, 30), (2, 100, 50, 4), (3, 3, 1000, 1), (4, 5, 20, 200)])
def test_batches_equal_fold_over_all_levels(spark, seed, size, millis, gap):
    rng = random.Random(seed)
    rows, want = [], {}
    for key in ("a", "b"):
        t, times = 0, []
        for _ in range(300):
            t += rng.randrange(gap)
            times.append(t)
        ids = batch_ids(times, size, millis)
        for i, (ms, b) in enumerate(zip(times, ids)):
            offset = i * 2 + (key == "b")
            rows.append((key, at(ms / 1000), offset))
            want[offset] = b
    df = frame(spark, rows, "source STRING, received_at TIMESTAMP, offset LONG")
    got = sequences.batches(df, ["source"], "received_at", "offset", size, millis, fan=3, index_span=64).collect()
    assert {r.offset: r.batch_id for r in got} == want


def test_chain_levels_are_used(spark):
    df = spark.range(0, 5000, 1).select(F.lit("k").alias("k"), (F.col("id") * 10).alias("t"))
    got = greedy.chains(df, ["k"], "t", 95, fan=4).where("t = pick_t").count()
    assert got == 500


def test_keyed_index_crosses_slots(spark):
    rows = [("a" if i % 3 else "b", i * 5) for i in range(200)]
    df = frame(spark, rows, "k STRING, seq LONG")
    got = ordered.keyed_index(df, ["k"], "seq", total="all", span=16).collect()
    for key in ("a", "b"):
        mine = sorted((r for r in got if r.k == key), key=lambda r: r.seq)
        assert [r.n for r in mine] == list(range(1, len(mine) + 1))
        assert {r["all"] for r in mine} == {len(mine)}


@pytest.mark.parametrize("backward", [True, False])
def test_neighbour_crosses_slots(spark, backward):
    rng = random.Random(5)
    rows = sorted((rng.randrange(100_000), i) for i in range(120))
    df = frame(spark, [("k", at(t), i) for t, i in rows], "k STRING, time TIMESTAMP, offset LONG")
    got = ordered.neighbour(
        df, ["k"], "time", "offset", ["offset"], backward=backward, prefix="near_", slot_us=500_000_000
    ).collect()
    order = [i for _, i in rows]
    for r in got:
        j = order.index(r.offset) + (-1 if backward else 1)
        assert r.near_offset == (order[j] if 0 <= j < len(order) else None)


def test_newest_and_quantiles(spark):
    df = spark.range(1000).select(F.lit("op").alias("operation"), F.col("id").alias("offset"))
    assert {r.offset for r in ordered.newest(df, ["operation"], "offset", 7, salts=3).collect()} == set(range(993, 1000))
    skewed = spark.range(999).select(F.when(F.col("id") < 400, 5).otherwise(F.col("id")).alias("x"))
    import numpy as np

    values = [5 if i < 400 else i for i in range(999)]
    got = {r.quantile: r.value for r in ordered.exact_quantiles(skewed, "x", [0.1, 0.5, 0.95, 1.0]).collect()}
    for q, v in got.items():
        assert v == pytest.approx(np.quantile(values, q))


def test_first_arrival_counts_copies(spark):
    df = frame(spark, [("a", 3, None), ("a", 1, 1.0), ("a", 2, 2.0), ("b", 9, 5.0)], "k STRING, offset LONG, v DOUBLE")
    got = {(r.k, r.offset, r.v, r.copies) for r in ordered.first_arrival(df, ["k"], "offset", "copies").collect()}
    assert got == {("a", 1, 1.0, 3), ("b", 9, 5.0, 1)}


def test_count_windows_drop_the_tail(spark):
    df = spark.range(19).select(F.lit("d").alias("device_id"), F.col("id").alias("offset"))
    got = sequences.count_windows(df, ["device_id"], "offset", 8, span=5).collect()
    assert len(got) == 16
    assert {(r.offset, r.window_id, r.window_pos) for r in got} == {(i, i // 8, i % 8) for i in range(16)}


def brute_baseline(rows, window, resets=()):
    out = {}
    for d, t, o, x in rows:
        cleared = max((r for k, r in resets if k == d and r <= t), default=None)
        lower = t - window if cleared is None else max(t - window, cleared)
        near = sorted((s, so, v) for k, s, so, v in rows if k == d and lower <= s <= t)
        first = near[0]
        out[o] = None if first[1] == o else first[2]
    return out


@pytest.mark.parametrize("with_resets", [False, True])
def test_spike_baseline_equals_scan(spark, with_resets):
    rng = random.Random(11)
    rows, seen = [], set()
    for o in range(500):
        d, t = f"d{rng.randrange(3)}", rng.randrange(2000)
        if (d, t) not in seen:
            seen.add((d, t))
            rows.append((d, t, o, rng.uniform(0, 10)))
    resets = [("d0", 300), ("d0", 301), ("d1", 60), ("d1", 1250)] if with_resets else []
    df = frame(
        spark, [(o, at(t), at(t), d, x) for d, t, o, x in rows],
        "offset LONG, time TIMESTAMP, received_at TIMESTAMP, device_id STRING, power_w DOUBLE",
    )
    marks = frame(spark, [(d, at(t)) for d, t in resets], "device_id STRING, reset_at TIMESTAMP") if resets else None
    got = {r.offset: r.baseline for r in rules.spike_baseline(df, "power_w", 60, resets=marks).collect()}
    assert got == brute_baseline(rows, 60, resets)


def test_spike_cases(spark):
    schema = "offset LONG, time TIMESTAMP, received_at TIMESTAMP, device_id STRING, power_w DOUBLE"
    spike = next(r for r in shipped_rules() if r.name == "power_spike")

    def hits(*samples):
        df = frame(spark, [(i, at(t), at(t), "d", x) for i, (t, x) in enumerate(samples)], schema)
        return rules.spike_hits(df, spike).collect()

    assert [h.event_value for h in hits((100, 200.0), (105, 400.0))] == [400.0]
    assert hits((100, 200.0), (105, 240.0)) == []
    assert len(hits((100, 200.0), (160, 260.0))) == 1  # both window bounds are included
    assert hits((100, 200.0), (161, 400.0)) == []
    assert hits((100, 0.0), (105, 400.0)) == []


def test_heartbeat_waits_for_cooldown(spark):
    rows = [
        (0, at(0), "d", "online"), (1, at(100), "d", "online"), (2, at(120), "d", "maintenance"),
        (3, at(200), "d", "online"), (4, at(600), "d", "error"), (5, at(10), "m", "offline"),
    ]
    df = frame(spark, rows, "offset LONG, time TIMESTAMP, device_id STRING, status STRING")
    got = sequences.heartbeat_failures(df, "2024-01-01 00:20:00", slot_us=50_000_000).collect()
    # 30 s after 0; then silent from 230 but held back until 330; then 630.
    assert sorted((r.offline_at - T0.replace(tzinfo=None)).total_seconds() for r in got) == [30, 330, 630]
