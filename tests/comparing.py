"""Run a query and its SQL over the same tables and compare the rows."""

from __future__ import annotations

import math
import os

import duckdb

DATA = os.environ.get("FURROW_TEST_DATA", "/root/testdata/sf0.001")


def database(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for name in os.listdir(folder):
        path = f"{folder}/{name}" + ("/*.parquet" if os.path.isdir(f"{folder}/{name}") else "")
        con.sql(f"create view {name.split('.')[0]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return tuple(plain(x) for x in (v.tolist() if hasattr(v, "tolist") else v))
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return v


def rows_of(df) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    return cols, sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
