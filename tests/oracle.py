"""Spark results against DuckDB on the same Parquet tables."""

import os

import duckdb
import pandas as pd


def _cell(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    if isinstance(v, bool) or hasattr(v, "dtype") and v.dtype == bool:
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return float(v)
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(_cell(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{path}')")
    return con


def same(spark, sf_dir: str, query, sql: str) -> None:
    got = query(spark, sf_dir).toPandas()
    want = connect(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
