"""Compare a Spark result with the same query in DuckDB, row by row."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
from pyspark.sql import DataFrame

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def kind(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return "date"
    return type(value).__name__


def keyed(rows: list[tuple], order: list[int]) -> list[tuple]:
    picked = [tuple(r[i] for i in order) for r in rows]
    return sorted(picked, key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, oracle: str) -> list[str]:
    """Empty when columns, row count and every value agree exactly."""
    cursor = con.execute(oracle)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    actual = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    found = []
    if len(actual) != len(expected):
        found.append(f"rows {len(actual)} != {len(expected)}")
    ordered = sorted(names)
    a = keyed(actual, [df.columns.index(c) for c in ordered])
    b = keyed(expected, [names.index(c) for c in ordered])
    if any(isinstance(v, decimal.Decimal) for r in b for v in r):
        found.append("decimal in oracle")
    only_a, only_b = set(a) - set(b), set(b) - set(a)
    if only_a or only_b or (a != b and not found):
        found.append(f"columns {ordered}")
        found += [f"spark {r}" for r in sorted(only_a, key=str)[:3]]
        found += [f"sql   {r}" for r in sorted(only_b, key=str)[:3]]
    else:
        for x, y in zip(a, b):
            if [kind(v) for v in x] != [kind(v) for v in y]:
                found.append(f"types {[kind(v) for v in x]} != {[kind(v) for v in y]}")
                break
    return found
