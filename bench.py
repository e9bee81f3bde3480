"""Time the headline queries and the whole ingest; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local threads.
"""
from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

HEADLINE = (
    "d1_device_buckets", "d2_minute_rollup", "d8_quality_summary", "d9_event_summary", "d10_affected_devices",
    "d16_latest_total_load", "d19_latency_summary", "d26_operating_points", "d31_window_metrics",
    "b11_classification", "b5_valid_readings", "c3_threshold_rules", "d18_pipeline_counters",
    "e1_spike_baseline", "e2_counter_rate", "e3_latest_by_device", "e5_first_arrival", "e6_event_cooldown",
    "e7_count_windows", "e8_micro_batches", "e9_heartbeat_failures", "e10_spike_after_reset",
    "j1_enqueue", "j4_failed", "a14_envelopes", "k3_scores", "k6_window_verdicts",
)


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def run_ingest(spark, sf_dir: str) -> tuple[float, int]:
    """All sinks of one batch of messages, from JSON through the device machine to tables."""
    from wattlane.plans import fixtures as fx
    from wattlane.session import use_utc
    from wattlane.sources.rules_config import shipped_rules
    from wattlane.sources.messages import stream_messages
    from wattlane.streaming.ingest import start_ingest

    use_utc(spark)
    work = tempfile.mkdtemp(prefix="wattlane-bench-")
    fx.messages(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{work}/messages")
    messages = spark.read.parquet(f"{work}/messages")
    count = messages.count()
    start = time.perf_counter()
    start_ingest(stream_messages(spark, f"{work}/messages"), f"{work}/tables", f"{work}/checkpoint", shipped_rules).awaitTermination()
    return round(time.perf_counter() - start, 3), count


def main() -> None:
    from wattlane.plans import registry
    from wattlane.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.load()
    readings = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    run(queries["d2_minute_rollup"].plan, spark, sf_dir)  # start the workers
    times = {}
    for name in HEADLINE:
        times[name] = run(queries[name].plan, spark, sf_dir)
        print(name, times[name], file=sys.stderr, flush=True)
    ingest_seconds, messages = run_ingest(spark, sf_dir)
    times["ingest_all_sinks"] = ingest_seconds
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total seconds of headline queries and full ingest",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else None,
        "readings": readings,
        "readings_per_second": {n: round(readings / t) for n, t in times.items() if t > 0 and n != "ingest_all_sinks"},
        "ingest_messages_per_second": round(messages / ingest_seconds),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
