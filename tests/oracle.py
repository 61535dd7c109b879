"""Side-by-side comparison of a registered query with its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows in a total order, one spelling per value."""
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        if pd.api.types.is_datetime64_any_dtype(frame[name]):
            frame[name] = frame[name].astype("datetime64[us]").astype(str)
        frame[name] = frame[name].map(lambda v: "null" if pd.isna(v) else repr(float(v)) if not isinstance(v, str) else v)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> list[str]:
    """Empty when the two results are the same multiset of rows."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return [f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"]
    if len(spark_frame) != len(sql_frame):
        return [f"rows {len(spark_frame)} != {len(sql_frame)}"]
    left, right = canonical(spark_frame), canonical(sql_frame)
    unequal = (left != right).any(axis=1)
    return [f"{left[unequal].head(3).to_dict('records')} != {right[unequal].head(3).to_dict('records')}"] if unequal.any() else []
