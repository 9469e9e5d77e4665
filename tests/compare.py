"""Order-insensitive comparison of a Spark result with its DuckDB statement."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

from claimweave.registry import ALL_TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in ALL_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    got_columns, got = _bag(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want_columns, want = _bag(columns, result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} against {want_columns}"
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"{sum(got.values())} against {sum(want.values())} rows; only here {extra}; only there {missing}"
    return None
