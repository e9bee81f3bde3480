"""Compare a Spark result with its DuckDB cross-check."""
from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NULL"
        return repr(value + 0.0) if value != int(value) or abs(value) > 1e15 else str(int(value))
    return str(value)


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None if equal, else a short description."""
    got = spark_df.collect()
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(spark_df.columns) != sorted(columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(columns)}"
    a = normal_rows(spark_df.columns, [tuple(r) for r in got])
    b = normal_rows(columns, want)
    if a == b:
        return None if a else "both empty"
    only_a, only_b = list(set(a) - set(b))[:3], list(set(b) - set(a))[:3]
    return f"rows {len(a)} vs {len(b)}; only spark {only_a}; only duckdb {only_b}"
