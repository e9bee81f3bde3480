"""Second-stage verification of fixed-size windows by reconstruction error.

A window is one row with its readings as an array, so reconstruction runs on
batches of windows.  Two reconstructors are provided: a sequence autoencoder
from given weights, and a linear one that is trained here with Spark ML.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import power_discrepancy, voltage_deviation
from ..session import cut_lineage
from .ordered import exact_quantiles
from .sequences import count_windows

WIDTH = 6
Reconstruct = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Verifier:
    mean: tuple[float, ...]
    std: tuple[float, ...]
    reconstruct: Reconstruct  # standardised windows (n, window, 6) -> same shape
    threshold: float
    window: int = 8


def window_rows(readings: DataFrame, window: int = 8, nominal_voltage: float = 220.0) -> DataFrame:
    """One row per complete window and device: offsets and features in arrival order."""
    return gathered(count_windows(
        readings.select("device_id", "offset", _features(nominal_voltage).alias("x")), ["device_id"], "offset", window))


def _features(nominal_voltage: float = 220.0) -> Column:
    return F.array(
        "voltage_v", "current_a", "power_w", F.coalesce("temperature_c", F.lit(0.0)),
        voltage_deviation("voltage_v", nominal_voltage),
        power_discrepancy("power_w", "voltage_v", "current_a"),
    )


def gathered(rows: DataFrame) -> DataFrame:
    """The window rows of readings with window and place in it (``count_windows``)."""
    return rows.groupBy("device_id", "window_id").agg(
        F.array_sort(F.collect_list(F.struct("window_pos", "offset", "x"))).alias("r")  # ``window`` items
    ).select("device_id", "window_id", F.col("r.offset").alias("offsets"), F.flatten("r.x").alias("x"))


def _errors(windows: DataFrame, model: Verifier) -> DataFrame:
    mean, std, size, rebuild = np.array(model.mean), np.array(model.std), model.window, model.reconstruct

    @F.pandas_udf("array<double>")
    def errors(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        z = (np.stack(x.to_numpy()).reshape(len(x), size, WIDTH) - mean) / std
        return pd.Series(list(np.mean((rebuild(z) - z) ** 2, axis=2)))

    return windows.withColumn("e", errors("x"))


def verdicts(readings: DataFrame, model: Verifier) -> DataFrame:
    """Per reading of each complete window: reconstruction error and confirmed (strictly above)."""
    return _judged(window_rows(readings, model.window), model)


def verdicts_of(numbered: DataFrame, model: Verifier) -> DataFrame:
    """The verdicts on readings whose windows are known (``count_windows``)."""
    return _judged(gathered(numbered.select("device_id", "offset", "window_id", "window_pos", _features().alias("x"))), model)


def _judged(windows: DataFrame, model: Verifier) -> DataFrame:
    scored = _errors(windows, model)
    pairs = F.arrays_zip(F.col("offsets").alias("offset"), F.col("e").alias("recon_error"))
    return scored.select("device_id", "window_id", F.explode(pairs).alias("p")).select(
        "device_id", "window_id", "p.offset", "p.recon_error",
        F.lit(model.threshold).alias("threshold"),
        (F.col("p.recon_error") > F.lit(model.threshold)).alias("confirmed"),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _recurrent(steps: np.ndarray, into: np.ndarray, back: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """LSTM over a batch (n, time, input) -> hidden states (n, time, hidden).

    Gate blocks are ordered input, forget, cell, output.
    """
    hidden = back.shape[1]
    h = np.zeros((len(steps), hidden))
    c = np.zeros_like(h)
    out = np.empty((len(steps), steps.shape[1], hidden))
    for t in range(steps.shape[1]):
        gates = steps[:, t] @ into.T + h @ back.T + bias
        enter, forget, cell, leave = np.split(gates, 4, axis=1)
        c = _sigmoid(forget) * c + _sigmoid(enter) * np.tanh(cell)
        h = _sigmoid(leave) * np.tanh(c)
        out[:, t] = h
    return out


def sequence_autoencoder(weights: Mapping[str, np.ndarray]) -> Reconstruct:
    """Encoder, last state repeated, decoder, linear output; weights by name."""
    w = {k: np.asarray(v, dtype=float) for k, v in weights.items()}

    def rebuild(z: np.ndarray) -> np.ndarray:
        code = _recurrent(z, w["enc_w_ih"], w["enc_w_hh"], w["enc_b_ih"] + w["enc_b_hh"])[:, -1:]
        steps = np.repeat(code, z.shape[1], axis=1)
        states = _recurrent(steps, w["dec_w_ih"], w["dec_w_hh"], w["dec_b_ih"] + w["dec_b_hh"])
        return states @ w["out_w"].T + w["out_b"]

    return rebuild


def load_sequence_verifier(path: str, threshold: float | None = None, window: int = 8) -> Verifier:
    """Verifier from an ``.npz`` artifact with weights, mean, std and threshold."""
    data = np.load(path, allow_pickle=False)
    return Verifier(
        tuple(data["mean"].tolist()), tuple(data["std"].tolist()), sequence_autoencoder(data_arrays(data)),
        float(data["threshold"]) if threshold is None else float(threshold), window,
    )


def data_arrays(data: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
    prefixes = ("enc_", "dec_", "out_")
    return {k: data[k] for k in data.keys() if k.startswith(prefixes)}


def _linear(center: np.ndarray, axes: np.ndarray) -> Reconstruct:
    def rebuild(z: np.ndarray) -> np.ndarray:
        flat = z.reshape(len(z), -1) - center
        return (flat @ axes @ axes.T + center).reshape(z.shape)

    return rebuild


def scale_of(windows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature over all readings of the windows."""
    item = windows.select(F.posexplode("x").alias("i", "v")).groupBy((F.col("i") % WIDTH).alias("f")).agg(
        F.avg("v").alias("m"), F.stddev_pop("v").alias("s")
    )
    stats = sorted(item.collect(), key=lambda r: r["f"])  # six rows
    if not stats:
        raise ValueError("no complete window")
    return np.array([r["m"] for r in stats]), np.array([r["s"] for r in stats]) + 1e-8


def with_threshold(windows: DataFrame, model: Verifier, quantile: float = 0.95) -> Verifier:
    """The model with the quantile of its errors over the windows as threshold."""
    errors = _errors(windows, model).select(F.explode("e").alias("e"))
    cut = exact_quantiles(errors, "e", [quantile]).first()["value"]
    return Verifier(model.mean, model.std, model.reconstruct, float(cut), model.window)


def fit_to(readings: DataFrame, reconstruct: Reconstruct, *, window: int = 8, threshold_quantile: float = 0.95) -> Verifier:
    """A verifier of given weights, with scale and threshold from (normal) readings."""
    windows = cut_lineage(window_rows(readings, window))
    mean, std = scale_of(windows)
    return with_threshold(windows, Verifier(tuple(mean), tuple(std), reconstruct, float("inf"), window), threshold_quantile)


def train_linear(
    readings: DataFrame, *, components: int = 16, window: int = 8, threshold_quantile: float = 0.95,
) -> Verifier:
    """Linear autoencoder (principal components of standardised windows) from normal readings.

    Training makes several passes over all windows, kept in the checkpoint folder.
    """
    windows = cut_lineage(window_rows(readings, window))
    mean, std = scale_of(windows)
    shift = F.array(*[F.lit(float(v)) for v in np.tile(mean, window)])
    scale = F.array(*[F.lit(float(v)) for v in np.tile(std, window)])
    z = F.transform(F.arrays_zip("x", shift.alias("m"), scale.alias("s")), lambda p: (p["x"] - p["m"]) / p["s"])
    vectors = windows.select(array_to_vector(z).alias("z"), z.alias("a"))
    axes = PCA(k=components, inputCol="z", outputCol="p").fit(vectors).pc.toArray()
    center_rows = vectors.select(F.posexplode("a").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).collect()
    center = np.array([r["m"] for r in sorted(center_rows, key=lambda r: r["i"])])
    model = Verifier(tuple(mean), tuple(std), _linear(center, axes), float("inf"), window)
    return with_threshold(windows, model, threshold_quantile)
