"""The report query over rows of its own."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wattlane.operators import aggregates as agg
from wattlane.plans import fixtures as fx
from wattlane.plans import registry


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    rows = spark.range(400).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 3000).alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.element_at(F.array(*map(F.lit, ("view", "purchase", "error", "signup"))), (F.col("id") % 4 + 1).cast("int")).alias("event_type"),
        ((F.col("id") * 37) % 120).cast("double").alias("value"), F.lit("{}").alias("props"))
    rows.unionByName(rows.limit(20)).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def test_messages_are_parsed_and_rules_judged_once(spark, events):
    plan = registry.load()["a13_report_lines"].plan(spark, events)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "schema_of_variant" not in plan  # read from where the one parse was written
    assert "lag(" not in plan and "windowspecdefinition(device_id" not in plan


def test_sections_count_all_rows(spark, events):
    lines = [r["line"] for r in registry.load()["a13_report_lines"].plan(spark, events).collect()]
    by_severity = agg.count_by(fx.rule_events(spark, events), "severity").collect()
    by_error = agg.count_by(fx.quality_logs(spark, events), "error_type").collect()
    assert by_severity and by_error
    assert {f"| {r['severity']} | {r['count']} |" for r in by_severity} <= set(lines)
    assert {f"| `{r['error_type']}` | {r['count']} |" for r in by_error} <= set(lines)
    assert f"| `validation.failures` | {sum(r['count'] for r in by_error)} |" in lines
    assert f"| `messages.received` | {fx.messages(spark, events).count() - _unrouted(spark, events)} |" in lines


def _unrouted(spark, events) -> int:
    return fx.messages(spark, events).where("topic NOT RLIKE '^energy/[^/]+/(telemetry|status|events)$'").count()
