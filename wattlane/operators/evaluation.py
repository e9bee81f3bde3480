"""Two-stage evaluation: edge flag, then confirmation by the verifier."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import confusion, recall_by_kind


def two_stage(edge: DataFrame, cloud: DataFrame, key: str = "offset") -> DataFrame:
    """Align edge and cloud flags per reading; both must hold."""
    return edge.join(cloud, key).withColumn("both_stages", F.col("is_anomaly") & F.col("confirmed"))


def report(rows: DataFrame) -> DataFrame:
    """Quality of the edge stage alone and of both stages, with what the second stage removed.

    ``rows`` carry kind, is_anomaly and both_stages.
    """
    truth = F.col("kind") != "normal"
    parts = [
        confusion(rows, truth, F.col(flag)).withColumn("stage", F.lit(name))
        for name, flag in (("edge_only", "is_anomaly"), ("two_stage", "both_stages"))
    ]
    dropped = rows.agg(
        F.count_if(~truth & F.col("is_anomaly") & ~F.col("both_stages")).alias("false_positives_suppressed"),
        F.count_if(truth & F.col("is_anomaly") & ~F.col("both_stages")).alias("true_anomalies_dropped"),
        F.lit("two_stage").alias("stage"),
    )
    return parts[0].unionByName(parts[1]).join(dropped, "stage", "left")


def recall_report(rows: DataFrame) -> DataFrame:
    return recall_by_kind(
        rows, {"edge_recall": F.col("is_anomaly"), "two_stage_recall": F.col("both_stages")}
    )
