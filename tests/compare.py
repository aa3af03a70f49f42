"""Comparison of Spark and DuckDB results as the driver makes it: columns by name, rows in any order."""

import math
import os

import duckdb
import pandas as pd


def connection(folder: str):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for name in os.listdir(folder):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{folder}/{name}'")
    return c


def text(v) -> str:
    if v is None or v is pd.NaT:
        return "None"
    if isinstance(v, float):
        return "None" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    return str(v)


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted("|".join(text(v) for v in r) for r in frame.itertuples(index=False))


def same(spark_frame: pd.DataFrame, connection, sql: str) -> tuple[bool, str]:
    names = [x[0] for x in connection.sql("describe " + sql).fetchall()]
    other = pd.DataFrame(connection.sql(sql).fetchall(), columns=names)
    if sorted(names) != sorted(spark_frame.columns):
        return False, f"columns {sorted(spark_frame.columns)} and {sorted(names)}"
    a, b = rows(spark_frame), rows(other)
    return a == b, f"only Spark {sorted(set(a) - set(b))[:3]}, only SQL {sorted(set(b) - set(a))[:3]}"
