"""Run queries in Spark and their SQL in DuckDB and compare the rows.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

SQL_TYPES = {"long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}


def duckdb_on(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _sorted_rows(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    ordered = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(ordered, key=repr)


def differences(spark: SparkSession, connection: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> str:
    """Empty if the query and its SQL give the same columns and rows; else the first difference."""
    df = QUERIES[name](spark, sf_dir)
    names, rows = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(ORACLE[name])
    expected_names, expected = _sorted_rows([d[0] for d in result.description], result.fetchall())
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    kinds = {f.name: SQL_TYPES.get(f.dataType.typeName()) for f in df.schema.fields}
    expected_kinds = {d[0]: str(d[1]) for d in result.description}
    if kinds != expected_kinds:
        return f"types {sorted(set(kinds.items()) ^ set(expected_kinds.items()))}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}"
    for ours, theirs in zip(rows, expected, strict=True):
        if repr(ours) != repr(theirs):
            return f"{ours} != {theirs}"
    return "" if rows else "no rows"


if __name__ == "__main__":
    from grapevine.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb_on(sf_dir)
    for name in sys.argv[2:] or list(ORACLE):
        start = time.time()
        try:
            found = differences(spark, connection, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on to the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:26} {time.time() - start:6.2f}s  {found or 'ok'}", flush=True)
