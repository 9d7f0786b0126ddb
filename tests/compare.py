"""Comparison of Spark results with DuckDB results."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(value(r[i]) for i in order) for r in rows)


def spark_bag(df) -> tuple[list[str], Counter]:
    return sorted(df.columns), bag(df.columns, [tuple(r) for r in df.collect()])


def duck_bag(con, sql: str) -> tuple[list[str], Counter]:
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), bag(columns, cur.fetchall())
