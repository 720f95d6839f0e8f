"""Composite-event labels: categories, vessel pairs, bounds and the global event number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakefold.schemas import FLUENT_CATEGORY, LABELS
from wakefold.sources.shared import ensure_checkpoint_dir


def keep_known_fluents(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("FluentName").isin(list(FLUENT_CATEGORY)))


def categorize(labels: DataFrame) -> DataFrame:
    """Known fluents with their category; epoch seconds become timestamps."""
    mapping = F.create_map(*[F.lit(x) for pair in FLUENT_CATEGORY.items() for x in pair])
    return (
        keep_known_fluents(labels)
        .withColumn("T_start", F.timestamp_seconds("T_start"))
        .withColumn("T_end", F.timestamp_seconds("T_end"))
        .withColumn("Category", mapping[F.col("FluentName")])
    )


def rename_partner(events: DataFrame) -> DataFrame:
    return events.withColumnRenamed("Argument", "MMSI_2")


def split_by_category(events: DataFrame) -> dict[str, DataFrame]:
    return {label: events.where(F.col("Category") == label) for label in LABELS}


def vessel_pairs(events: DataFrame) -> DataFrame:
    return events.select("MMSI", "MMSI_2").distinct()


def event_bounds(annotated: DataFrame) -> DataFrame:
    """Earliest point time and its category per event and vessel."""
    return annotated.groupBy("event_index", "id").agg(
        F.min("ts").alias("event_time_ms"),
        F.min_by("Category", F.struct("ts", "Category")).alias("Category"),
    )


def assign_event_index(events: DataFrame, order: list[str]) -> DataFrame:
    """Number all rows 1..n in ``order`` (which must be unique) without a one-task window.

    Rows are range-partitioned by the order itself, which stays balanced whatever single
    values are frequent; each partition is numbered on its own and shifted by the row count of
    the partitions before it. The partitioned rows are checkpointed first, so a lost executor
    cannot move a row to another partition between counting and numbering.
    """
    spark = events.sparkSession
    ensure_checkpoint_dir(spark)
    placed = (
        events.repartitionByRange(*order)
        .withColumn("part", F.spark_partition_id())
        .checkpoint(eager=True)
    )
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    # One row per shuffle partition: a running sum over it is small by construction.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy(*order)
    return (
        placed.withColumn("at", F.row_number().over(inside))
        .join(F.broadcast(offsets), "part")
        .withColumn("event_index", (F.col("offset") + F.col("at")).cast("long"))
        .drop("part", "at", "offset")
    )


def latest_events(events: DataFrame, n: int = 5) -> DataFrame:
    return events.orderBy(F.desc("T_end"), F.desc("event_index")).limit(n)
