"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def _value(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    x = x.tolist() if hasattr(x, "tolist") else x
    return round(float(x), 6) if isinstance(x, float) else int(x) if isinstance(x, bool) else x


def rows(frame: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(map(_value, r)) for r in frame.itertuples(index=False)), key=repr)


def assert_same(spark, sf_dir: str, query, sql: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), connection(sf_dir).execute(sql).df()
    assert len(got) == len(want)
    got, want = rows(got), rows(want)
    assert got[0] == want[0]
    assert got[1] == want[1]
