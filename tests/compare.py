"""Run named queries on Spark and their SQL twins on DuckDB and compare whole results."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    found = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both sides agree, else a short account of the difference."""
    spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    duck_rows = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} <> {sorted(names)}"
    if len(spark_rows) != len(duck_rows):
        return f"{len(spark_rows)} rows <> {len(duck_rows)}; only spark {[r for r in spark_rows if r not in set(duck_rows)][:2]}, only sql {[r for r in duck_rows if r not in set(spark_rows)][:2]}"
    left, right = set(spark_rows), set(duck_rows)
    wrong = [(a, b) for a, b in zip([r for r in spark_rows if r not in right], [r for r in duck_rows if r not in left])]
    if wrong or left != right:
        return f"{len(wrong)} rows differ, columns {sorted(names)}: {wrong[:2]}"
    types = [type(v) for v in (spark_rows[0] if spark_rows else ())]
    other = [type(v) for v in (duck_rows[0] if duck_rows else ())]
    return None if types == other or not spark_rows else f"types {types} <> {other}"
