"""Runs SQL text over the given tables in DuckDB and compares rows in any order."""

from __future__ import annotations

import datetime as dt
import os

import duckdb


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in os.listdir(d):
        path = f"{d}/{t}" + ("/*.parquet" if os.path.isdir(f"{d}/{t}") else "")
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{path}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (float,)):
        return f"{v + 0.0:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v) if not isinstance(v, dt.datetime) else v.isoformat()


def rows(columns: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)
