"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def normal(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple("null" if r[k] is None else f"{r[k]:.9g}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows]
    return sorted(out)


def same_rows(df, con, sql: str) -> None:
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert normal(df.collect(), df.columns) == normal(want.fetchall(), want.columns)
