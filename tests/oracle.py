"""Side-by-side comparison of a query with its SQL on the same parquet tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(f"{sf}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float)):
        return float(value) + 0.0
    return str(value)


def difference(spark_rows, spark_cols, sql_rows, sql_cols) -> str | None:
    if sorted(spark_cols) != sorted(sql_cols):
        return f"columns differ: {sorted(spark_cols)} / {sorted(sql_cols)}"
    order_a = sorted(range(len(spark_cols)), key=lambda i: spark_cols[i])
    order_b = sorted(range(len(sql_cols)), key=lambda i: sql_cols[i])
    a = Counter(tuple(_plain(r[i]) for i in order_a) for r in spark_rows)
    b = Counter(tuple(_plain(r[i]) for i in order_b) for r in sql_rows)
    if a == b:
        return None
    only_a, only_b = list((a - b).elements()), list((b - a).elements())
    key = lambda t: tuple(str(x) for x in t)
    return (
        f"rows {sum(a.values())} / {sum(b.values())}, {len(only_a)} differ; {sorted(spark_cols)}\n"
        f"  spark {sorted(only_a, key=key)[:3]}\n  sql   {sorted(only_b, key=key)[:3]}"
    )
