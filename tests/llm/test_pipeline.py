"""The pipeline: its stages keep clean documents and apply their decisions."""
from __future__ import annotations

import brute
import corpus_pipeline
import pytest

import __spark_entry__ as entry_points
import oracle
from wattlane.llm import queries
from wattlane.llm.tables import stored


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, small), name)
        sizes.append(docs.count())
        if name == "near_dedup":
            want = {i for i, _, c in brute.near_duplicates([(r.doc_id, r.text) for r in before.collect()]) if i == c}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            found = brute.contamination([(r.doc_id, r.text) for r in before.collect()], items)
            assert {r.doc_id for r in docs.collect()} == {i for i, n, hit, *_ in found if not hit or 20 * hit < n}
        if name != "mixing":
            assert docs.columns == columns
    assert all(sizes) and {"doc_id", "source", "epoch", "position"} <= set(docs.columns)


def test_registered():
    names = set(entry_points.queries())
    assert {"pipeline"} | set(queries.QUERIES) <= names
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in queries.QUERIES}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, small, name):
    assert oracle.difference(queries.QUERIES[name](spark, small), oracle.connect(small), queries.ORACLES[name]) is None
