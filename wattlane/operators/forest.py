"""Isolation forest as Spark jobs (Liu, Ting, Zhou 2008).

Rows are assigned to trees by a seeded hash, each tree grows in its own task
from at most ``samples`` rows, and the model is a table of tree nodes.  Scoring
sends the node arrays to the executors once: their size is bounded by
trees * 2 * samples nodes, whatever the number of readings.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import power_discrepancy, voltage_deviation
from ..session import cut_lineage
from ..settings import Settings
from .ordered import exact_quantiles
from .scoring import FEATURES

NODES = "tree INT, node INT, feature INT, split DOUBLE, below INT, above INT, path DOUBLE"
EULER = 0.5772156649015329
_HASH_RANGE = 1 << 30


def feature_columns(nominal_voltage: float = 220.0) -> list[Column]:
    """Base features and the two physics features, in model order."""
    return [
        *[F.col(f).cast("double").alias(f) for f in FEATURES],
        voltage_deviation("voltage_v", nominal_voltage).alias("voltage_deviation"),
        power_discrepancy("power_w", "voltage_v", "current_a").alias("power_discrepancy"),
    ]


FEATURE_NAMES = (*FEATURES, "voltage_deviation", "power_discrepancy")


def feature_rows(readings: DataFrame, nominal_voltage: float = 220.0) -> DataFrame:
    """Feature vector of each reading; a reading with a null feature gets none."""
    keep = [c for c in readings.columns if c not in FEATURE_NAMES]
    return readings.dropna(subset=list(FEATURES)).select(*keep, *feature_columns(nominal_voltage))


def average_path(n):
    """Mean depth of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    path = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, path))


def grow_tree(x: np.ndarray, rng: np.random.Generator, depth_limit: int) -> list[tuple]:
    """Nodes (feature, split, below, above, path) of one random tree; leaves have feature -1."""
    nodes: list[tuple] = []
    todo = [(np.arange(len(x)), 0, None, False)]
    while todo:
        rows, depth, parent, is_above = todo.pop()
        me = len(nodes)
        if parent is not None:
            f, s, b, a, p = nodes[parent]
            nodes[parent] = (f, s, b, me, p) if is_above else (f, s, me, a, p)
        part = x[rows]
        low, high = (part.min(axis=0), part.max(axis=0)) if len(rows) else (None, None)
        choices = np.flatnonzero(low < high) if len(rows) > 1 and depth < depth_limit else []
        if len(choices) == 0:
            nodes.append((-1, 0.0, me, me, depth + float(average_path(len(rows)))))
            continue
        feature = int(rng.choice(choices))
        split = float(rng.uniform(low[feature], high[feature]))
        nodes.append((feature, split, -1, -1, 0.0))
        goes_below = part[:, feature] <= split
        todo.append((rows[~goes_below], depth + 1, me, True))
        todo.append((rows[goes_below], depth + 1, me, False))
    return nodes


@dataclass(frozen=True)
class Forest:
    nodes: DataFrame
    mean: tuple[float, ...]
    std: tuple[float, ...]
    samples: int
    threshold: float
    version: str
    nominal_voltage: float


def _pool(features: DataFrame, total: int, rows: int, seed: int) -> tuple[DataFrame, int]:
    """Rows that the trees are drawn from: a hash sample of about ``rows``."""
    share = 1.0 if total <= rows else rows / total
    keyed = features.select(
        F.xxhash64("device_id", "time", F.lit(seed)).alias("row_id"), *FEATURE_NAMES
    )
    if share < 1.0:
        keyed = keyed.where(F.pmod("row_id", F.lit(_HASH_RANGE)) < int(share * _HASH_RANGE))
    pool = cut_lineage(keyed)
    return pool, pool.count()


def _tree_rows(pool: DataFrame, pool_size: int, trees: int, samples: int, seed: int, slots: int) -> DataFrame:
    """Exactly ``samples`` distinct pool rows per tree (all of a smaller pool)."""
    ticket = F.pmod(F.xxhash64("row_id", "tree", F.lit(seed)), F.lit(_HASH_RANGE))
    spread = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("ticket", ticket)
    if pool_size > samples:
        # Filter before the shuffle to a little more than needed, then cut exactly.
        share = min(1.0, (samples + 10 * math.sqrt(samples) + 10) / pool_size)
        spread = spread.where(F.col("ticket") < int(share * _HASH_RANGE) + 1)
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("ticket", "row_id"))
    return spread.repartition(slots, "tree").withColumn("rank", rank).where(F.col("rank") <= samples)


def fit(
    readings: DataFrame, *, trees: int = 200, samples: int = 1024, seed: int = 42,
    train_rows: int = 50_000, threshold_quantile: float = 0.90, settings: Settings = Settings(),
) -> Forest:
    """Scaler, forest and threshold from (normal) readings with device_id and time.

    Scaler and threshold come from all rows; only the rows that trees are drawn from are
    bounded, to about ``train_rows``.
    """
    features = feature_rows(readings, settings.nominal_voltage)
    stats = features.agg(
        F.count("*").alias("n"),
        *[F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURE_NAMES)],
        *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(FEATURE_NAMES)],
    ).first()
    if not stats["n"]:
        raise ValueError("no reading has all features")
    pool, size = _pool(features, stats["n"], train_rows, seed)
    width = len(FEATURE_NAMES)
    mean = tuple(stats[f"m{i}"] for i in range(width))
    std = tuple(stats[f"s{i}"] or 1.0 for i in range(width))
    used = min(samples, size)
    limit = int(math.ceil(math.log2(max(used, 2))))

    def grow(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        x = (frame[list(FEATURE_NAMES)].to_numpy() - np.array(mean)) / np.array(std)
        nodes = grow_tree(x, np.random.default_rng([seed, int(key[0])]), limit)
        out = pd.DataFrame(nodes, columns=["feature", "split", "below", "above", "path"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", int(key[0]))
        return out

    # Little data but much work per tree: spread the trees over all slots.
    slots = max(1, min(trees, readings.sparkSession.sparkContext.defaultParallelism))
    rows = _tree_rows(pool, size, trees, samples, seed, slots)
    nodes = cut_lineage(rows.groupBy("tree").applyInPandas(grow, NODES))
    forest = Forest(nodes, mean, std, used, math.inf, settings.model_version, settings.nominal_voltage)
    scored = cut_lineage(features.select(_score_column(forest).alias("anomaly_score")))
    cut = exact_quantiles(scored, "anomaly_score", [threshold_quantile]).first()["value"]
    return Forest(nodes, mean, std, used, float(cut), settings.model_version, settings.nominal_voltage)


def _score_column(forest: Forest) -> Column:
    """Anomaly score of the feature columns; higher is more anomalous."""
    table = forest.nodes.toPandas().sort_values(["tree", "node"])  # trees * 2 * samples rows at most
    packed = [
        tuple(part[c].to_numpy() for c in ("feature", "split", "below", "above", "path"))
        for _, part in table.groupby("tree")
    ]
    shared = forest.nodes.sparkSession.sparkContext.broadcast(packed)
    mean, std = np.array(forest.mean), np.array(forest.std)
    limit = int(math.ceil(math.log2(max(forest.samples, 2))))
    scale = max(float(average_path(forest.samples)), 1e-9)

    def depths(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, below, above, path in shared.value:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(limit):
                # A leaf points to itself, and its feature -1 picks a column that is ignored.
                at = np.where(x[rows, feature[at]] <= split[at], below[at], above[at])
            total += path[at]
        return total / len(shared.value)

    @F.pandas_udf("double")
    def score(
        a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series
    ) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=float) for s in (a, b, c, d, e, f)])
        known = ~np.isnan(x).any(axis=1)
        out = np.full(len(x), np.nan)
        if known.any():
            out[known] = np.power(2.0, -depths((x[known] - mean) / std) / scale)
        return pd.Series(out).where(known, None)

    return score(*[F.col(f) for f in FEATURE_NAMES])


class Scorer:
    """A forest whose nodes are at the executors: many batches can be scored by it."""

    def __init__(self, forest: Forest) -> None:
        self.forest = forest
        self.column = _score_column(forest)

    def score(self, readings: DataFrame, *, threshold: float | None = None) -> DataFrame:
        """Readings with anomaly_score, threshold, is_anomaly (strictly above) and model_version.

        A reading with a missing feature keeps its row and gets no score.
        """
        cut = self.forest.threshold if threshold is None else float(threshold)
        extra = feature_columns(self.forest.nominal_voltage)[len(FEATURES):]
        scored = readings.select("*", *extra).withColumn("anomaly_score", self.column)
        return scored.drop("voltage_deviation", "power_discrepancy").select(
            "*", F.lit(cut).alias("threshold"),
            (F.col("anomaly_score") > F.lit(cut)).alias("is_anomaly"),
            F.lit(self.forest.version).alias("model_version"),
        )


def score(readings: DataFrame, forest: Forest, *, threshold: float | None = None) -> DataFrame:
    return Scorer(forest).score(readings, threshold=threshold)
