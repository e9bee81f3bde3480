"""Lines of many wanted keys are found without a broadcast of the keys."""
from __future__ import annotations

import random

from pyspark.sql import functions as F

from wattlane.llm import lines, tables


def test_wanted_rows_pass_and_few_others(spark):
    rng = random.Random(5)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(6_000)] + [-1, 0, 1, (1 << 63) - 1, -(1 << 63), 1 << 15, (1 << 15) - 1]
    rows = spark.createDataFrame([(k, str(i)) for i, k in enumerate(keys + keys[:100])], "k bigint, v string").repartition(7)
    own = set(keys[:2_000] + keys[6_000:])
    wanted = spark.createDataFrame([(k,) for k in own], "k bigint")
    found = tables.perhaps_in(rows, "k", wanted, len(own)).collect()
    assert sum(r.k in own for r in found) == len(own) + 100
    assert sum(r.k not in own for r in found) < 4_000 / 8
    assert tables.perhaps_in(rows, "k", wanted.where("false"), 0).count() == 0


def test_lines_are_found_without_a_broadcast_of_their_keys(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_LINES", 10)
    asked = []
    monkeypatch.setattr(lines, "perhaps_in", lambda *a: asked.append(a[3]) or tables.perhaps_in(*a))
    table = spark.range(500).select(F.concat(F.lit("line "), (F.col("id") % 300).cast("string")).alias("line")).select(
        F.xxhash64("line").alias("k1"), "line")
    keys = table.where("line like '%7%'").select("k1").distinct()
    found = lines.line_texts(keys, table)
    assert sorted(r.line for r in found.collect()) == sorted(f"line {i}" for i in range(300) if "7" in str(i))
    assert asked == [found.count()]
