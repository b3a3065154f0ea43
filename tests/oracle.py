"""Compares queries with their SQL in DuckDB: rows sorted by name-ordered columns."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple(None if v is None or v != v else (float(v) if isinstance(v, (float, int)) and not isinstance(v, bool) else v) for v in r) for r in df.itertuples(index=False, name=None)]
    rows = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows]
    return sorted(rows, key=repr)


def differences(spark_df, con, sql: str) -> str:
    a, b = spark_df.toPandas(), con.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    x, y = normal(a), normal(b)
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows"
    bad = [(p, q) for p, q in zip(x, y) if p != q]
    return f"{len(bad)} of {len(x)} rows, first {bad[0]}" if bad else ""
