"""Collects the query definitions of all topics."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from wakefold.plans.tables import Tables

TOPICS = [
    "events",
    "joining",
    "metrics",
    "sliding",
    "streams",
    "text_forms",
    "reading",
    "storing",
    "profiling",
    "sampling",
    "rasters",
    "training",
]


class Topic:
    """Queries of one topic: a builder over ``Tables`` and, where possible, SQL."""

    def __init__(self):
        self.builders: dict[str, Callable[[Tables], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def register(builder):
            self.builders[name] = builder
            if sql is not None:
                self.sql[name] = sql
            return builder

        return register


def _topics() -> list[Topic]:
    return [import_module(f"wakefold.plans.{name}").topic for name in TOPICS]


def _over_folder(builder: Callable[[Tables], DataFrame]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return builder(Tables(spark, folder))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _over_folder(b) for topic in _topics() for name, b in topic.builders.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for topic in _topics() for name, sql in topic.sql.items()}
