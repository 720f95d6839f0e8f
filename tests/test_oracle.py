"""Every query against its oracle at the smallest scale, and again on skewed events."""

import shutil

import pytest
from compare import TABLES, compare, oracle_connection
from pyspark.sql import functions as F

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()
ORACLES = __spark_entry__.oracle_sql()
SKEWED = [
    "loitering_sliding", "window_topn", "interval_join", "interval_join_bucketed", "transshipment_features",
    "non_transshipment_features", "open_ended_join", "point_deltas", "trajectory_wkt", "cover_else_within",
    "event_index", "pixel_projection", "stratified_split", "upsert_trajectories",
]


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, connection, name):
    assert compare(QUERIES[name](spark, FOLDER), connection, ORACLES[name]) == []


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """The same tables with one user owning a third of all events."""
    folder = tmp_path_factory.mktemp("skewed")
    for name in TABLES:
        if name != "events":
            shutil.copy(f"{FOLDER}/{name}.parquet", folder / f"{name}.parquet")
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    hot = events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(4)).otherwise(F.col("user_id")))
    hot.write.parquet(str(folder / "events.parquet"))
    # DuckDB reads a single path, so the folder written by Spark is read with a glob.
    connection = oracle_connection(FOLDER)
    connection.execute(
        f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')"
    )
    return str(folder), connection


@pytest.mark.parametrize("name", SKEWED)
def test_matches_oracle_on_skewed_events(spark, skewed, name):
    folder, connection = skewed
    assert compare(QUERIES[name](spark, folder), connection, ORACLES[name]) == []


@pytest.mark.parametrize("name", ["raster_dataset", "objective_history", "model_roundtrip"])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
