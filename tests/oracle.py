"""Runs a query and its SQL on the same tables and compares rows, whatever their order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame, columns):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v) or v != v:
            return "~"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(value(v) for v in r) for r in frame[columns].itertuples(index=False))


def same(spark_frame, sql_frame):
    columns = sorted(spark_frame.columns)
    assert columns == sorted(sql_frame.columns)
    assert rows(spark_frame, columns) == rows(sql_frame, columns)
