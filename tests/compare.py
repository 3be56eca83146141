"""Runs registered queries and their SQL on one folder and compares the rows."""

import os

import duckdb
import pandas as pd


def oracle_connection(folder):
    con = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")
    return con


def normalized(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if pd.api.types.is_float_dtype(frame[c]):
            frame[c] = frame[c].map(lambda x: None if pd.isna(x) else repr(float(x)))
        elif pd.api.types.is_datetime64_any_dtype(frame[c]):
            frame[c] = frame[c].astype("datetime64[us]").astype(str)
        else:
            frame[c] = frame[c].map(lambda x: None if x is None or (isinstance(x, float) and pd.isna(x)) else str(x))
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def kind(column):
    """The kind of a column's values.  Pandas may hold integers beside nulls as floats, and nulls alone as anything."""
    values = column.dropna()
    if not len(values):
        return None
    whole = len(values) < len(column) and column.dtype.kind == "f" and (values == values.round()).all()
    return "i" if whole else column.dtype.kind


def differences(spark_frame, sql_frame):
    """Text describing the first difference, or None."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"{len(spark_frame)} rows != {len(sql_frame)} rows"
    kinds = {c: (kind(spark_frame[c]), kind(sql_frame[c])) for c in spark_frame.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and None not in k}
    a, b = normalized(spark_frame), normalized(sql_frame)
    if a.equals(b):
        return f"kinds differ: {odd}" if odd else None
    unequal = (a.fillna("~") != b.fillna("~")).any(axis=1)
    first = unequal.idxmax()
    return f"{int(unequal.sum())} rows differ, first {a.loc[first].to_dict()} != {b.loc[first].to_dict()}"
