"""Run a plan in Spark and its SQL twin in DuckDB over the same tables, and compare all rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


SQL_TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when both sides have the same columns and the same rows."""
    relation = con.execute(sql)
    sql_columns = [d[0] for d in relation.description]
    sql_rows = relation.fetchall()
    if sorted(spark_df.columns) != sorted(sql_columns):
        return [f"columns {sorted(spark_df.columns)} against {sorted(sql_columns)}"]
    sql_types = {d[0]: str(d[1]) for d in relation.description}
    for field in spark_df.schema:
        expected = SQL_TYPES[field.dataType.simpleString()]
        if sql_types[field.name] != expected:
            return [f"{field.name} is {expected} against {sql_types[field.name]}"]
    left = _rows(spark_df.columns, spark_df.collect())
    right = _rows(sql_columns, sql_rows)
    if left == right:
        return []
    only_left, only_right = left - right, right - left
    return [
        f"{left.total()} rows against {right.total()}",
        f"only in Spark ({only_left.total()}): {list(only_left)[:3]}",
        f"only in SQL ({only_right.total()}): {list(only_right)[:3]}",
    ]
