"""Electrical quantities from raw samples of AC windows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_metrics(
    samples: DataFrame, v_scale: float, i_scale: float, keys: Sequence[str] = ("device_id", "window_id")
) -> DataFrame:
    """RMS voltage and current, real and apparent power and power factor per window.

    Samples are ADC integers; the mean of a window is its DC part.  Plain sums
    are exact for integers and add up in any order, so one partial aggregate
    gives the centred moments.  An empty window (only null samples) gives zeros.
    """
    v, i = F.col("v_raw").cast("long"), F.col("i_raw").cast("long")
    both = v.isNotNull() & i.isNotNull()

    def total(x):
        return F.sum(F.when(both, x)).cast("double")

    sums = samples.groupBy(*keys).agg(
        F.count_if(both).cast("double").alias("n"), total(v).alias("sv"), total(i).alias("si"),
        total(v * v).alias("svv"), total(i * i).alias("sii"), total(v * i).alias("svi"),
    )
    zero, n = F.lit(0.0), F.col("n")

    def or_zero(x):
        return F.coalesce(F.when(n > 0, x), zero)

    power = sums.select(
        *keys,
        or_zero(F.sqrt(F.greatest(n * F.col("svv") - F.col("sv") * F.col("sv"), zero)) / n * v_scale).alias("voltage_v"),
        or_zero(F.sqrt(F.greatest(n * F.col("sii") - F.col("si") * F.col("si"), zero)) / n * i_scale).alias("current_a"),
        or_zero(
            (n * F.col("svi") - F.col("sv") * F.col("si")) / (n * n) * v_scale * i_scale
        ).alias("power_w"),
    )
    apparent = F.col("voltage_v") * F.col("current_a")
    return power.withColumn("apparent_va", apparent).withColumn(
        "power_factor", F.when(F.col("apparent_va") > 1e-6, F.col("power_w") / F.col("apparent_va")).otherwise(zero)
    )


def publish_average(metrics: DataFrame, device: str, window: str, per_period: int) -> DataFrame:
    """Mean of the window metrics of each publish period (``per_period`` window ids)."""
    period = F.floor(F.col(window) / per_period).cast("long")
    return metrics.groupBy(device, period.alias("period")).agg(
        F.avg("voltage_v").alias("voltage_v"), F.avg("current_a").alias("current_a"),
        F.avg("power_w").alias("power_w"), F.count("*").alias("windows"),
    )
