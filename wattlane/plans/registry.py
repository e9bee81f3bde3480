"""Registry of queries: name -> (Spark plan, DuckDB cross-check)."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import use_utc
from .oracle_views import with_views

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    plan: Plan
    oracle: str | None


QUERIES: dict[str, Query] = {}


def _portable(df: DataFrame) -> DataFrame:
    """Timestamps without zone (UTC), so a client's zone cannot shift them."""
    return df.select(*[
        F.col(f"`{n}`").cast("timestamp_ntz").alias(n) if t == "timestamp" else F.col(f"`{n}`")
        for n, t in df.dtypes
    ])


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Register a plan; ``oracle`` may use the derived ``views`` by name."""
    def add(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            return _portable(plan(spark, sf_dir))

        QUERIES[name] = Query(run, with_views(oracle, *views) if oracle else None)
        return plan

    return add


def load() -> dict[str, Query]:
    from . import queries_analytics, queries_ingest, queries_models, queries_sequences, queries_stream  # noqa: F401

    return QUERIES
