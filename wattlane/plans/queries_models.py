"""Model queries: features, forest, scores, verifier, evaluation."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import evaluation, forest, rules, scoring, verifier
from ..sources.rules_config import shipped_rules
from . import fixtures as fx
from .registry import query


@query("k1_features", """
    SELECT sequence_no, voltage_v, current_a, power_w, temperature_c,
           round(abs(voltage_v - 220), 6) AS voltage_deviation,
           round(power_w - voltage_v * current_a, 6) AS power_discrepancy
    FROM telemetry WHERE temperature_c IS NOT NULL""", ("telemetry",))
def _(spark, sf):
    return forest.feature_rows(fx.telemetry(spark, sf)).select(
        "sequence_no", "voltage_v", "current_a", "power_w", "temperature_c",
        F.round("voltage_deviation", 6).alias("voltage_deviation"),
        F.round("power_discrepancy", 6).alias("power_discrepancy"),
    )


def _normal(spark, sf):
    return fx.labelled(spark, sf).where("kind = 'normal'")


#: One reading in five is held out of training; anomalies never train.
_HELD = "pmod(xxhash64(device_id, time), 5) = 0"


def _forest(spark, sf):
    return forest.fit(_normal(spark, sf).where(f"NOT {_HELD}"))


def _judged(spark, sf):
    return fx.labelled(spark, sf).where(f"kind <> 'normal' OR {_HELD}")


@query("k2_forest")
def _(spark, sf):
    model = forest.fit(_normal(spark, sf))
    return model.nodes.groupBy("tree").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("feature") < 0).alias("leaves"),
        F.round(F.max("path"), 6).alias("longest_path"),
    ).withColumn("threshold", F.lit(round(model.threshold, 6)))


@query("k3_scores")
def _(spark, sf):
    return forest.score(fx.labelled(spark, sf), _forest(spark, sf)).select(
        "offset", "device_id", "kind", F.round("anomaly_score", 9).alias("anomaly_score"), "threshold", "is_anomaly"
    )


@query("k3_quality")
def _(spark, sf):
    from ..operators.aggregates import confusion

    scored = forest.score(_judged(spark, sf), _forest(spark, sf)).where("anomaly_score IS NOT NULL")
    return confusion(scored, F.col("kind") != "normal", F.col("is_anomaly"))


@query("k4_prediction_rows", """
    SELECT "offset", time, device_id, anomaly_score,
           CASE WHEN is_anomaly THEN 'anomaly' ELSE 'normal' END AS predicted_label,
           '{"threshold":0.55,"features":["voltage_v","current_a","power_w","temperature_c"],"rule_triggered":' ||
           CASE WHEN "offset" IN (SELECT "offset" FROM threshold_hits) THEN 'true' ELSE 'false' END || '}' AS metadata
    FROM predictions""", ("predictions", "threshold_hits"))
def _(spark, sf):
    hits = rules.threshold_hits(fx.arrivals(spark, sf), shipped_rules())
    return scoring.prediction_rows(fx.predictions(spark, sf), hits).select(
        "offset", "time", "device_id", "anomaly_score", "predicted_label", "metadata"
    )


def _fixed_weights(hidden: int = 16) -> dict[str, np.ndarray]:
    """Repeatable weights for the sequence form, which is not trained here."""
    rng = np.random.default_rng(42)

    def draw(*shape):
        return rng.uniform(-1, 1, shape) / np.sqrt(hidden)

    return {
        "enc_w_ih": draw(4 * hidden, verifier.WIDTH), "enc_w_hh": draw(4 * hidden, hidden),
        "enc_b_ih": draw(4 * hidden), "enc_b_hh": draw(4 * hidden),
        "dec_w_ih": draw(4 * hidden, hidden), "dec_w_hh": draw(4 * hidden, hidden),
        "dec_b_ih": draw(4 * hidden), "dec_b_hh": draw(4 * hidden),
        "out_w": draw(verifier.WIDTH, hidden), "out_b": draw(verifier.WIDTH),
    }


@query("k6_window_verdicts")
def _(spark, sf):
    rows = fx.arrivals(spark, sf)
    # The weights are fixed and untrained; scale and threshold come from the data.
    model = verifier.fit_to(_normal(spark, sf), verifier.sequence_autoencoder(_fixed_weights()))
    return verifier.verdicts(rows, model).withColumn("recon_error", F.round("recon_error", 9))


@query("k7_linear_verifier")
def _(spark, sf):
    model = verifier.train_linear(_normal(spark, sf))
    return verifier.verdicts(fx.arrivals(spark, sf), model).groupBy("confirmed").agg(
        F.count("*").alias("readings"), F.round(F.avg("recon_error"), 6).alias("avg_error"),
        F.round(F.max("threshold"), 6).alias("threshold"),
    )


def _two_stage(spark, sf):
    edge = forest.score(_judged(spark, sf), _forest(spark, sf)).where("anomaly_score IS NOT NULL")
    model = verifier.train_linear(_normal(spark, sf).where(f"NOT {_HELD}"))
    confirmed = verifier.verdicts(fx.arrivals(spark, sf), model).select("offset", "confirmed")
    return evaluation.two_stage(edge.select("offset", "kind", "is_anomaly"), confirmed)


@query("k8_two_stage_report")
def _(spark, sf):
    return evaluation.report(_two_stage(spark, sf))


@query("k8_two_stage_recall")
def _(spark, sf):
    return evaluation.recall_report(_two_stage(spark, sf))


@query("d24_two_stage_confusion", """
    WITH r AS (SELECT kind <> 'normal' AS truth, is_anomaly AS edge,
                      is_anomaly AND (voltage_v < 200 OR power_w > 1500) AS both_stages FROM predictions),
    s AS (SELECT 'edge_only' AS stage, truth, edge AS flag FROM r UNION ALL SELECT 'two_stage', truth, both_stages FROM r),
    c AS (SELECT stage, count(*) FILTER (WHERE truth AND flag) AS tp, count(*) FILTER (WHERE NOT truth AND flag) AS fp,
                 count(*) FILTER (WHERE truth AND NOT flag) AS fn,
                 count(*) FILTER (WHERE NOT truth AND NOT flag) AS tn FROM s GROUP BY 1)
    SELECT c.*, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall,
           round(2.0 * tp / (2 * tp + fp + fn), 4) AS f1, round(fp / (fp + tn), 4) AS false_positive_rate,
           CASE stage WHEN 'two_stage' THEN (SELECT count(*) FROM r WHERE NOT truth AND edge AND NOT both_stages) END
               AS false_positives_suppressed,
           CASE stage WHEN 'two_stage' THEN (SELECT count(*) FROM r WHERE truth AND edge AND NOT both_stages) END
               AS true_anomalies_dropped
    FROM c""", ("predictions",))
def _(spark, sf):
    edge = fx.predictions(spark, sf).select("offset", "kind", "is_anomaly")
    cloud = fx.arrivals(spark, sf).select(
        "offset", ((F.col("voltage_v") < 200) | (F.col("power_w") > 1500)).alias("confirmed")
    )
    return evaluation.report(evaluation.two_stage(edge, cloud))
