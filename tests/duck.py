"""Comparison of a Spark result with DuckDB's, as multisets of rows over sorted columns."""

import os

import duckdb
import pandas as pd


def duck(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con.execute(sql).df()


def rows(frame):
    def cell(x):
        if x is None or x is pd.NA or x != x:
            return "null"
        return repr(round(float(x), 9)) if isinstance(x, float) else str(x)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist())
