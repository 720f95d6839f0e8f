"""Image queries on trajectories of several parts and on labels with many trajectories."""

import pytest
from compare import compare, oracle_connection
from pyspark.sql import functions as F

import __spark_entry__
from wakefold.operators import raster
from wakefold.operators.tracks import trajectory_arrays
from wakefold.plans import tables

FOLDER = "/root/testdata/sf0.001"


class InParts(tables.Tables):
    """Tables whose trajectories are stored in parts of three points."""

    @property
    def stored(self):
        points = self.event_points.withColumnRenamed("Category", "behavior_type_label")
        return trajectory_arrays(points, ["event_index", "id", "behavior_type_label"], self.segment_ms, 3)


def test_multimodal_rows_hold_all_parts(spark, monkeypatch):
    name = "multimodal_dataset"
    assert InParts(spark, FOLDER).stored.where("part > 0").count() > 0
    monkeypatch.setattr(tables.Tables, "stored", InParts.stored)
    assert compare(__spark_entry__.queries()[name](spark, FOLDER), oracle_connection(FOLDER), __spark_entry__.oracle_sql()[name]) == []


def test_image_folders_hold_every_trajectory(spark, tmp_path):
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).cast("timestamp_ntz")
    events = spark.range(803).select(
        F.col("id").alias("event_id"), at.alias("ts"), (1000 + F.col("id")).alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(4.0).alias("value"), F.lit('{"k": 7}').alias("props"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    rows = __spark_entry__.queries()["raster_dataset"](spark, str(tmp_path)).collect()
    assert rows and {r["images"] for r in rows} == {803}


def test_lines_of_a_long_trajectory_are_dealt_apart(spark, monkeypatch):
    name = "trajectory_raster"
    monkeypatch.setattr(raster, "LINES_PER_SHARE", 2)
    assert compare(__spark_entry__.queries()[name](spark, FOLDER), oracle_connection(FOLDER), __spark_entry__.oracle_sql()[name]) == []
