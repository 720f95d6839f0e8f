"""Sinks, samples and column lists."""

import pytest

from wakefold.operators import profiling
from wakefold.sources import ranges, readers, shared, writers


def test_columns_may_be_expressions():
    part = ranges.jdbc_options("jdbc:x", "s.t", "d", ["mmsi", "ST_AsText(trajectory) AS trajectory"], None, "pk", (1, 9))
    assert part["dbtable"] == '(SELECT "mmsi", ST_AsText(trajectory) AS "trajectory", "pk" FROM s.t) AS src'
    named = ranges.jdbc_options("jdbc:x", "s.t", "d", ["a + 1 as pk"], None, "pk", (1, 9))
    assert named["dbtable"] == '(SELECT a + 1 AS "pk" FROM s.t) AS src'
    assert ranges.column_name("ST_AsText(trajectory) AS way") == "way" and ranges.column_name("basic") == "basic"


def test_labels_are_read_by_header(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("T_end|MMSI|FluentName|Note\n20|7|stopped|x\n|8|loitering|\n")
    rows = readers.read_labels(spark, str(tmp_path)).collect()
    assert sorted((r.MMSI, r.FluentName, r.T_start, r.T_end, r.Value) for r in rows) == [
        ("7", "stopped", None, 20, None), ("8", "loitering", None, None, None),
    ]


def test_single_file_does_not_narrow_what_comes_before(spark):
    path = shared.new_path(spark, "test-single")
    writers.write_csv(spark.range(0, 100, numPartitions=7), path, single=True)
    back = spark.read.option("header", True).csv(path)
    assert back.count() == 100 and len(back.inputFiles()) == 1


def test_log_keeps_other_runs(spark):
    path = shared.new_path(spark, "test-log")
    rows = spark.createDataFrame([("a", 1.0, 1)], "metric string, value double, step long")
    for run in ("x", "y", "x"):
        writers.append_metrics(rows, path, run)
    assert sorted(r.run for r in spark.read.parquet(path).collect()) == ["x", "y"]


def test_json_keeps_nulls(spark):
    path = shared.new_path(spark, "test-json")
    writers.write_json(spark.createDataFrame([("a", None)], "feature string, std double"), path)
    assert spark.read.json(path).columns == ["feature", "std"]


@pytest.mark.parametrize("fraction", [0.0, 0.3, 1.0])
def test_hash_sample_is_repeatable(spark, fraction):
    frame = spark.range(0, 5000, numPartitions=3)
    one = {r.id for r in writers.hash_sample(frame, ["id"], fraction).collect()}
    other = {r.id for r in writers.hash_sample(frame.repartition(5), ["id"], fraction).collect()}
    assert one == other and abs(len(one) - 5000 * fraction) < 200
    assert fraction in (0.0, 1.0) or one != {r.id for r in writers.hash_sample(frame, ["id"], fraction, 7).collect()}


def test_profile_of_any_columns(spark):
    frame = spark.createDataFrame(
        [(None, [1], "b"), (2, None, "a")], "`a.b` int, list array<int>, text string"
    )
    rows = profiling.profile_columns(frame).orderBy("position").collect()
    assert [tuple(r) for r in rows] == [
        ("a.b", 0, "int", 2, 1, "2", "2"), ("list", 1, "array<int>", 2, 1, None, None), ("text", 2, "string", 2, 2, "a", "b"),
    ]
    empty = profiling.profile_columns(frame.limit(0)).first()
    assert (empty.rows, empty["count"], empty["min"]) == (0, 0, None)
