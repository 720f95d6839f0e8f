"""Side-by-side run of a Spark query and its SQL oracle in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    if hasattr(value, "asDict"):
        return _cell(list(value))
    if isinstance(value, dict):
        return _cell(list(value.values()))
    return str(value)


def _kind(value):
    return {int: "int", float: "float", bool: "bool", str: "str"}.get(type(value), type(value).__name__)


def compare(frame, connection, sql: str) -> list[str]:
    """Differences between both results; empty when they agree."""
    spark_names = sorted(frame.columns)
    cursor = connection.execute(sql)
    sql_columns = [c[0] for c in cursor.description]
    if spark_names != sorted(sql_columns):
        return [f"columns {spark_names} != {sorted(sql_columns)}"]
    at = [sql_columns.index(n) for n in spark_names]
    want_rows = [[row[i] for i in at] for row in cursor.fetchall()]
    got_rows = [list(row) for row in frame.select(*spark_names).collect()]
    got = sorted("|".join(_cell(v) for v in row) for row in got_rows)
    want = sorted("|".join(_cell(v) for v in row) for row in want_rows)
    problems = []
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    for i, name in enumerate(spark_names):
        a = {_kind(r[i]) for r in got_rows[:2000] if r[i] is not None}
        b = {_kind(r[i]) for r in want_rows[:2000] if r[i] is not None}
        if a != b:
            problems.append(f"type of {name}: {a} != {b}")
    if got != want:
        missing = sorted(set(want) - set(got))[:3]
        surplus = sorted(set(got) - set(want))[:3]
        problems.append(f"values: spark only {surplus}; sql only {missing}")
    return problems
