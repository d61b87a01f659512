"""Holds a Spark result against DuckDB's on the same tables, whatever the order of rows and columns."""

from __future__ import annotations

import glob
import os

import duckdb


def canonical(frame) -> list[tuple]:
    def cell(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if x is None or x != x:
            return "NULL"
        return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, row)) for row in frame.itertuples(index=False))


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con.sql(sql).df()


def check(spark, sf_dir: str, query, sql: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), duck(sf_dir, sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
