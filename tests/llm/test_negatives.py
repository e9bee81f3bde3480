"""Hard negatives against plain Python."""
from __future__ import annotations

import math
import random
from fractions import Fraction

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattlane.llm import negatives
from wattlane.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, shard string, score int"


def _rows(n=900, dims=6):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(8)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        out.append((i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in c], rng.randrange(10)))
    same = [float(np.float32(x)) for x in centres[0]]
    out += [(n + i, same, i % 2) for i in range(300)]  # a quarter of all rows: one vector
    out += [(5_000, None, 1), (5_100, [0.1, float("nan")] + [0.0] * (dims - 2), 1), (5_200, [float("inf")] * dims, 1), (5_300, same, None),
            (None, same, 1), (5_400, [0.5], 1), (5_500, [], 1), (5_600, [None] * dims, 1), (5_700, [0.0] * dims, 2), (5_800, [100_000.0] * dims, 3)]
    return out


def _run(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 1, "s", 2) for r in rows], SCHEMA).repartition(4)
    got = negatives.hard_negatives(table, F.col("id") % 100 == 0, **options).collect()
    assert all(r.anchor_id is not None for r in got)
    return sorted(map(tuple, got))


@pytest.mark.parametrize("shard,blocks,at_once", [(8_192, 8_192, 256), (100, 3, 4)])
def test_negatives(spark, monkeypatch, shard, blocks, at_once):
    monkeypatch.setattr(negatives, "SHARD_ROWS", shard)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", blocks)
    monkeypatch.setattr(negatives, "AT_ONCE", at_once)
    rows = _rows()
    got = _run(spark, rows)
    assert got == brute.hard_negatives(rows) and len(got) > 200
    assert {r[2] for r in got} == set(range(1, 11))


def test_repeated_rows_are_one(spark):
    rows = _rows(200)
    assert _run(spark, rows + rows[:50] * 3) == _run(spark, rows)


def test_scores_beyond_floating_point(spark, monkeypatch):
    monkeypatch.setattr(negatives, "EXACT", 1)
    rows = _rows(200)
    assert _run(spark, rows) == brute.hard_negatives(rows)


def test_options(spark):
    rows = _rows(300)
    got = _run(spark, rows, positives=2, negatives=3, window=(0, 100))
    assert got == brute.hard_negatives(rows, 2, 3, 0, 100)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(empty, F.col("id") % 100 == 0).count() == 0
    assert _run(spark, [(1, [0.5, 0.5], 1), (2, [0.5, 0.5], 2)]) == []
    assert _run(spark, [(100, [0.5, 0.5], 1)]) == []
    assert _run(spark, [(100, None, 1), (200, [0.5], None)]) == []


def test_walk_is_certified_and_skips():
    """Bounds hold for every row, and a clear winner ends the walk early."""
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.integers(-20, 20, (2_000, 8)), rng.integers(90, 110, (30, 8))])
    books = [negatives.k_means(rows[:, :4], 16), negatives.k_means(rows[:, 4:], 16)]
    shard = negatives.Shard(np.arange(len(rows)), np.array(["a"] * len(rows), object), rows, books)
    anchor = np.full(8, 100)
    scores = shard.rows @ anchor
    last, seen = np.inf, 0
    for bound, least, at in shard.walk(anchor):
        assert bound <= last and scores[at].max() <= bound and scores[at].min() >= least
        last, seen = bound, seen + len(at)
    assert seen == len(rows)
    visited = []
    whole = shard.batches
    shard.batches = lambda *a: (visited.append(len(x[1])) or x for x in whole(*a))
    best = shard.positives(-1, "a", anchor, 5)
    assert [s for s, _ in best] == sorted(scores.tolist())[-5:][::-1] and sum(visited) < len(rows) / 2


def _contract(rows):
    """The contract in Python's integers, components of whatever size."""
    use = [(i, [math.floor(Fraction(x) * 256) for x in v], (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    out = []
    for a, v, label in use:  # each copy of a row is a row
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, lab) for i, w, lab in use if i != a) if a % 100 == 0 else []
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            wrong = [(t, i) for t, i, lab in scored if lab != label and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(a, p, k, i, -s, -t) for k, (t, i) in enumerate(wrong[:10], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [100_000.0, 300_000.0])
def test_query_takes_components_of_any_size(spark, tmp_path, scale):
    """Components over 2^14 and scores over 2^53, of which a hundredfold is more than 64 bits hold."""
    rng = random.Random(9)
    rows = [(i, [float(np.float32((0.7 + rng.gauss(0, 0.3)) * (scale if i % 2 else 1.0))) for _ in range(6)], rng.randrange(3)) for i in range(400)]
    rows += [(400 + i, [float(np.float32(scale * 10 ** rng.uniform(0, 1)))] * 6, i % 3) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, QUERIES["op13_hard_negatives"](spark, str(tmp_path)).collect()))
    want = _contract(rows)
    assert max(r[4] for r in want) > 1 << 53 and got == want


def test_scores_beyond_64_bits():
    """They keep their order, and a component of 64 bits or more its value."""
    rows = negatives._matrix(pa.array([[2.0**70, 1.0], [2.0**70, 2.0], [1.0, 5.0], [0.0, 7.0]]), 2)
    shard = negatives.Shard(np.arange(4), np.array(["a", "a", "b", "b"], object), rows, [np.zeros((1, 1)), np.zeros((1, 1))])
    assert shard.positives(9, "a", rows[0], 2) == [(2**140 + 2, 1), (2**140 + 1, 0)]
    assert shard.positives(9, "b", np.array([0, 3]), 2) == [(21, 3), (15, 2)]


def test_query_counts_each_copy_of_a_row(spark, tmp_path):
    """Repeated positives, negatives and anchors, and one id with two vectors."""
    rows = [r for r in _rows(500) if None not in r and None not in r[1] and len(r[1]) == 6 and all(abs(x) < 9 for x in r[1])]
    rows += rows[::7] + rows[100:101] + rows[::3] * 2 + [(200, rows[4][1], 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, QUERIES["op13_hard_negatives"](spark, str(tmp_path)).collect()))
    assert got == _contract(rows) and len(set(got)) < len(got)
