"""What a micro-batch costs beside its rows."""
from __future__ import annotations

import threading
import time

import pytest

from wattlane.schemas import MESSAGE
from wattlane.sources.rules_config import shipped_rules
from wattlane.streaming import ingest


def test_sinks_run_with_adaptive_execution(spark, tmp_path, monkeypatch):
    spark.createDataFrame([], MESSAGE).write.parquet(str(tmp_path / "in"))
    spark.sql("SELECT 'energy/a/status' AS topic, CAST('{}' AS BINARY) AS payload, timestamp '2024-01-01' AS received_at, 1L AS offset").write.mode(
        "append").parquet(str(tmp_path / "in"))
    seen = []

    def process(store, messages, *rest):
        messages.write.format("noop").mode("overwrite").save()
        seen.append(store.spark.conf.get("spark.sql.adaptive.enabled"))

    monkeypatch.setattr(ingest, "process_batch", process)
    stream = spark.readStream.schema(MESSAGE).parquet(str(tmp_path / "in"))
    ingest.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), shipped_rules).awaitTermination()
    assert seen and set(seen) == {spark.conf.get("spark.sql.adaptive.enabled")} == {"true"}


def test_state_has_few_partitions(spark, tmp_path):
    """A partition of the state costs a task and a commit in each batch, with or without rows."""
    rows = spark.sql("SELECT 'a' AS device_id, timestamp '2024-01-01' AS received_at")
    rows.write.parquet(str(tmp_path / "in"))
    key, wide = "spark.sql.shuffle.partitions", 10 * max(ingest.STATE_PARTITIONS, spark.sparkContext.defaultParallelism)
    before = spark.conf.get(key)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    spark.conf.set(key, str(wide))
    try:
        with ingest.at_most_partitions(spark, 3):
            query = stream.groupBy("device_id").count().writeStream.outputMode("complete").format("noop").option(
                "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert spark.conf.get(key) == str(wide)  # the caller keeps its own
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numShufflePartitions"] == 3
    finally:
        spark.conf.set(key, before)


def test_ingest_starts_with_few_partitions(spark, tmp_path, monkeypatch):
    spark.createDataFrame([], MESSAGE).write.parquet(str(tmp_path / "in"))
    key, seen = "spark.sql.shuffle.partitions", []
    whole = ingest.together

    def together(*parts):
        seen.append(int(spark.conf.get(key)))
        return whole(*parts)

    monkeypatch.setattr(ingest, "together", together)
    before = spark.conf.get(key)
    spark.conf.set(key, "5000")
    try:
        stream = spark.readStream.schema(MESSAGE).parquet(str(tmp_path / "in"))
        ingest.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), shipped_rules).awaitTermination()
    finally:
        spark.conf.set(key, before)
    assert seen == [max(ingest.STATE_PARTITIONS, ingest.PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism)]


def test_sinks_run_side_by_side(spark):
    """Each waits for the other, so one after the other they would not end."""
    meet = threading.Barrier(2, timeout=60)

    def sink(n):
        meet.wait()
        return spark.range(n).count()

    assert ingest.at_once(spark, a=lambda: sink(3), b=lambda: sink(5)) == {"a": 3, "b": 5}
    assert ingest.at_once(spark) == {}


def test_a_batch_fails_when_its_other_sinks_have_ended(spark):
    ended, failed = [], threading.Event()

    def fail():
        failed.set()
        raise ValueError("sink")

    def slow():
        assert failed.wait(60)
        time.sleep(0.5)
        ended.append(True)

    with pytest.raises(ValueError, match="sink"):
        ingest.at_once(spark, bad=fail, good=slow)
    assert ended
