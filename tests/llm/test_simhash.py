"""SimHash groups against plain Python."""
from __future__ import annotations

import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlane.llm import simhash

SCHEMA = "doc_id long, text string, fp string, tile int, root string"


def _docs():
    rng = random.Random(11)
    word = lambda: f"{rng.choice('abcdefg')}{rng.randrange(40)}"
    base = [word() for _ in range(200)]
    out = [None, "", " \n\t ", "one", "ONE", "one two", "A b\x0bC", "a B c", "a b c d", "É é e f", "x" * 5_000, "ab " * 3_000]
    for edits in (0, 0, 0, 1, 1, 2, 3, 5, 9, 40):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(200)] = word()
        out.append(" ".join(copy))
    out += [" ".join(word() for _ in range(n)) for n in range(1, 150)]
    return [(5 * i + 3, t) for i, t in enumerate(out)]


def test_fingerprints_match_plain_python(monkeypatch):
    long_text = " ".join(f"w{i % 977}" for i in range(20_000))
    texts = [t for _, t in _docs()] + [long_text]
    want = [brute.fingerprint(t) for t in texts]
    for piece in (simhash.PIECE, 7, 1):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert [simhash.fingerprint((t or "").encode()) % 2**64 for t in texts] == want


@pytest.mark.parametrize("parts", [1, 2, 4, 8, 16])
def test_steps_reach_every_neighbour(parts):
    rng = random.Random(parts)
    base, width = simhash._base(parts, 2), 64 // parts
    tile = lambda x: sum(bin(x >> (k * width) & ((1 << width) - 1)).count("1") * base**k for k in range(parts))
    reach = set(simhash.steps(parts))
    for _ in range(500):
        x = rng.choice([0, 2**64 - 1, rng.getrandbits(64)])
        y = x ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.5 and 1 << rng.randrange(64))
        assert abs(tile(x) - tile(y)) in reach


@pytest.mark.parametrize("parts,block", [(None, 4_096), (1, 5), (8, 3)])
def test_groups(spark, monkeypatch, parts, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CELLS", 64)
    docs = _docs()
    rows = [(i, t, "x", 1, "y") for i, t in [*docs, docs[14], docs[14], (None, "one row without an id")]]
    got = simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA).repartition(5), parts=parts).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    want = {i: (f"{f:016x}", c) for i, f, c in brute.simhash(docs)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == want
    sizes = Counter(c for _, c in want.values())
    assert sizes.most_common(1)[0][1] >= 5


def test_crowd_of_near_fingerprints(spark, monkeypatch):
    """Thousands of fingerprints in reach of each other give one group and few links."""
    monkeypatch.setattr(simhash, "BLOCK", 100)
    rng = np.random.default_rng(1)
    crowd = {0} | {(1 << int(a)) | (1 << int(b)) for a, b in rng.integers(0, 63, (3_000, 2))}
    table = spark.createDataFrame([(x,) for x in crowd], "fp long")
    links = simhash.near_links(table)
    assert links.count() <= 40 * len(crowd)
    parent = {x: x for x in crowd}
    for r in links.collect():
        assert bin((r.a ^ r.b) % 2**64).count("1") <= 2
        parent[brute.find(parent, r.a)] = brute.find(parent, r.b)
    assert len({brute.find(parent, x) for x in crowd}) == 1


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_groups(empty).count() == 0
    only = spark.createDataFrame([(None, None, "", 1, ""), (7, "", "", 1, "")], SCHEMA)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(only).collect()} == {(None, "0" * 16, 7), (7, "0" * 16, 7)}


def test_one_fingerprint_on_a_third_of_all_rows(spark):
    table = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same few words").otherwise(
        F.concat(F.lit("row number "), F.col("id").cast("string"))).alias("text"))
    got = simhash.simhash_groups(table).where("doc_id % 3 = 0").select("fingerprint", "component_id").distinct().collect()
    assert len(got) == 1 and got[0].component_id == 0
