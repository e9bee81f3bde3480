"""Shuffles of the sinks have partitions in proportion to the batch, not the session's 200."""
from __future__ import annotations

from types import SimpleNamespace

from wattlane.sources.rules_config import shipped_rules
from wattlane.streaming import ingest

KEY = "spark.sql.shuffle.partitions"


def test_sinks_of_a_small_batch_have_few_partitions(spark, tmp_path, monkeypatch):
    rows = spark.sql("SELECT 'energy/a/status' AS topic, CAST('{}' AS BINARY) AS payload, timestamp '2024-01-01' AS received_at, 1L AS offset")
    rows.write.parquet(str(tmp_path / "in"))
    before, seen, sink = spark.conf.get(KEY), [], ingest.TableStore.append

    def append(store, *args):
        seen.append(int(store.spark.conf.get(KEY)))
        assert int(spark.conf.get(KEY)) == 5000  # other queries of the caller are left alone
        assert store.spark.conf.get("wattlane.test.own") == "set later"
        return sink(store, *args)

    monkeypatch.setattr(ingest.TableStore, "append", append)
    spark.conf.set(KEY, "5000")
    spark.conf.set("wattlane.test.own", "set later")
    try:
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        # The caller's own number is back as soon as the stream has started.
        ingest.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), shipped_rules).awaitTermination()
        assert spark.conf.get(KEY) == "5000"
    finally:
        spark.conf.set(KEY, before)
        spark.conf.unset("wattlane.test.own")
    assert seen and set(seen) == {ingest.SINK_PARTITIONS}
    assert spark.read.parquet(str(tmp_path / "out" / "data_quality_logs")).count() == 1


def test_partitions_grow_with_the_batch(spark):
    def of(*counts):
        return ingest.sink_partitions(SimpleNamespace(counts=dict(enumerate(counts))))

    assert of() == of(1, 2) == ingest.SINK_PARTITIONS
    assert of(30 * ingest.SINK_ROWS, 10 * ingest.SINK_ROWS + 1) == 41
    before = spark.conf.get(KEY)
    with ingest.at_most_partitions(spark, 10**6):  # but never beyond the caller's
        assert spark.conf.get(KEY) == before
