"""Run report: a JSON snapshot and Markdown tables, built as DataFrames."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _section(order: int, title: str, header: str, rule: str, rows: DataFrame, line: Column, key: str) -> DataFrame:
    """Heading lines (position 0-5) and one line per row, sorted by ``key``."""
    spark = rows.sparkSession
    heads = spark.createDataFrame(
        [(order, i, "", t) for i, t in enumerate((f"## {title}", "", header, rule))],
        "section INT, position INT, name STRING, line STRING",
    )
    tail = spark.createDataFrame([(order, 9, "", "")], "section INT, position INT, name STRING, line STRING")
    body = rows.select(
        F.lit(order).alias("section"), F.lit(5).alias("position"), F.col(key).cast("string").alias("name"), line.alias("line")
    )
    return heads.unionByName(body).unionByName(tail)


def report_lines(counters: DataFrame, latencies: DataFrame, severities: DataFrame, errors: DataFrame) -> DataFrame:
    """Markdown lines of a run, in order (section, position, name)."""
    parts = [
        _section(1, "Counters", "| Counter | Value |", "| --- | ---: |", counters,
                 F.format_string("| `%s` | %d |", "name", "value"), "name"),
        _section(2, "Latencies (ms)", "| Operation | Count | Avg | p50 | p95 | p99 |",
                 "| --- | ---: | ---: | ---: | ---: | ---: |", latencies,
                 F.format_string("| `%s` | %d | %.2f | %.2f | %.2f | %.2f |", "operation", "count", "avg_ms",
                                 "p50_ms", "p95_ms", "p99_ms"), "operation"),
        _section(3, "Events by severity", "| Severity | Count |", "| --- | ---: |", severities,
                 F.format_string("| %s | %d |", "severity", "count"), "severity"),
        _section(4, "Validation errors by type", "| Error type | Count |", "| --- | ---: |", errors,
                 F.format_string("| `%s` | %d |", "error_type", "count"), "error_type"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("section", "position", "name")


def write_report(lines: DataFrame, path: str) -> None:
    """One Markdown text file; the report has a line per counter, not per reading."""
    lines.coalesce(1).sortWithinPartitions("section", "position", "name").select("line").write.mode("overwrite").text(path)


def snapshot(counters: DataFrame, latencies: DataFrame, severities: DataFrame, errors: DataFrame, at: str) -> DataFrame:
    """One JSON document of the same figures (each list has a row per name)."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name)).withColumn("k", F.lit(1))

    out = listed(counters, "counters")
    for df, name in ((latencies, "latencies"), (severities, "events_by_severity"), (errors, "quality_by_type")):
        out = out.join(listed(df, name), "k")
    return out.select(F.to_json(F.struct(
        F.lit(at).alias("captured_at"), "counters", "latencies", "events_by_severity", "quality_by_type"
    )).alias("snapshot"))
