"""Key-range scans: option building for JDBC and the same ranges over files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def range_count(parallelism: int, lowest: int = 8, highest: int = 1000) -> int:
    return min(highest, max(lowest, 2 * parallelism))


_NAMED = re.compile(r"(?is)(.+)\s+as\s+(\w+)\s*")


def column_name(column: str) -> str:
    """The name of a column or of ``expression AS name``."""
    named = _NAMED.fullmatch(column)
    return named[2] if named else column


def _selected(column: str) -> str:
    named = _NAMED.fullmatch(column)
    return f'{named[1].strip()} AS "{named[2]}"' if named else f'"{column}"'


def jdbc_options(
    url: str,
    table: str,
    driver: str,
    columns: list[str] | None = None,
    where: str | None = None,
    key: str = "primary_key",
    bounds: tuple[int, int] | None = None,
    parallelism: int = 4,
    fetch_size: int = 1000,
) -> dict[str, str]:
    """Options of a partitioned JDBC read; without bounds it is a single read.

    A column is a name or ``expression AS name``; an expression is computed by the database. The key
    is read along for partitioning even if it was not asked for.
    """
    if columns:
        wanted = [*columns, key] if bounds and key not in map(column_name, columns) else columns
        listed = ", ".join(_selected(c) for c in wanted)
    else:
        listed = "*"
    condition = f" WHERE {where}" if where else ""
    options = {
        "url": url,
        "driver": driver,
        "dbtable": f"(SELECT {listed} FROM {table}{condition}) AS src",
        "fetchsize": str(fetch_size),
    }
    if bounds:
        options.update(
            partitionColumn=key,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(range_count(parallelism)),
        )
    return options


def read_jdbc(spark: SparkSession, columns: list[str] | None = None, key: str = "primary_key", **kwargs) -> DataFrame:
    """Partitioned table read. Bounds come from one query unless they are given."""
    if "bounds" not in kwargs:
        edges = jdbc_options(key=key, **kwargs)
        source = edges["dbtable"]
        edges["dbtable"] = f'(SELECT min("{key}") AS lo, max("{key}") AS hi FROM {source}) AS edges'
        low, high = spark.read.format("jdbc").options(**edges).load().first()
        kwargs["bounds"] = None if low is None else (int(low), int(high))
    frame = spark.read.format("jdbc").options(**jdbc_options(columns=columns, key=key, **kwargs)).load()
    return frame.select(*map(column_name, columns)) if columns else frame


def key_range_scan(
    frame: DataFrame, columns: list[str], key: str, where=None, ranges: int = 8
) -> DataFrame:
    """Projected and filtered rows with the number of their key range.

    Bounds are a scalar subquery; the projection and filter reach the file scan.
    """
    picked = frame if where is None else frame.where(where)
    wanted = list(dict.fromkeys([*columns, key]))
    picked = picked.select(*wanted)
    edges = picked.agg(F.struct(F.min(key).alias("lo"), F.max(key).alias("hi"))).scalar()
    slot = (F.col(key) - edges["lo"]) * F.lit(ranges)
    return picked.withColumn("range_id", F.floor(slot / (edges["hi"] - edges["lo"] + 1)).cast("long"))
