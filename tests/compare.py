"""Rows of Spark and DuckDB side by side, regardless of order and of how numbers are typed."""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np
import pandas as pd


def plain(v: object) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if float(v).is_integer() else repr(round(float(v), 9))
    if isinstance(v, (list, np.ndarray)):
        return str([plain(x) for x in v])
    return str(v)[:10] if hasattr(v, "year") else str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def tables(folder: str):
    con = duckdb.connect()
    for t in os.listdir(folder):
        if t.endswith(".parquet"):
            con.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{folder}/{t}'")
    return con
