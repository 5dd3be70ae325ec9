"""Holds a query's rows against its SQL in DuckDB over the same tables."""

from __future__ import annotations

import os

import duckdb


def rows(df) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df.where(df.notna(), None).values.tolist()), key=str)


def differing(spark, query, sql: str, folder: str) -> str:
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"create view {name.split('.')[0]} as select * from '{folder}/{name}'")
    want, got = con.sql(sql).df(), query(spark, folder).toPandas()
    if sorted(want.columns) != sorted(got.columns):
        return f"columns {sorted(got.columns)} instead of {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    return "" if a == b else f"{len(a)} rows instead of {len(b)}; first difference {next(((x, y) for x, y in zip(a, b) if x != y), None)}"
