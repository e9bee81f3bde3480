"""Components of long chains, and what their rounds leave behind."""
from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from wattlane.llm import components as comp
from wattlane.llm.tables import shared_folder


def _chains(spark):
    names = random.Random(5).sample(range(-10**12, 10**12), 600)
    edges = [(names[i], names[i + 1]) for i in range(599) if i % 40 != 39]
    roots = {x: min(names[i // 40 * 40:i // 40 * 40 + 40]) for i, x in enumerate(names)}
    return spark.createDataFrame(edges + [(b, a) for a, b in edges[::7]] + [(names[0], names[0])], "a bigint, b bigint"), roots


def test_size_estimate_does_not_grow_with_the_rounds(spark):
    """Each join of a round multiplies the optimizer's sizes; kept over rounds they filled the driver."""
    edges, roots = _chains(spark)
    labels = comp.components(edges)
    assert {r.node: r.root for r in labels.collect()} == roots and labels.count() == len(roots)
    assert labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 30


def test_tables_of_the_rounds_go(spark):
    folder = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    held = lambda: {x for x in os.listdir(folder) if x.startswith("components-")} if os.path.isdir(folder) else set()
    before = held()
    edges, roots = _chains(spark)
    labels = comp.components(edges)
    assert held() == before
    assert labels.where(F.col("node") == F.col("root")).count() == len(set(roots.values()))


def test_no_edges(spark):
    assert comp.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
    assert comp.components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).collect() == []
