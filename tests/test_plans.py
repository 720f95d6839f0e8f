"""Physical plans hold no operator that would not scale."""

import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
# Queries whose plan needs no training or image writing to be built.
NAMES = [
    "loitering_sliding", "window_features", "interval_join", "pair_interval_join", "cover_else_within",
    "transshipment_features", "non_transshipment_features", "open_ended_join", "trajectory_arrays", "point_deltas",
    "trajectory_raster", "upsert_trajectories", "balanced_sample", "stratified_split", "kfold_assign",
    "impute_median", "standard_scale", "vessel_semi_filter", "key_range_scan", "profile_distinct", "limit_per_label",
]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_plan(spark, name):
    plan = plan_of(__spark_entry__.queries()[name](spark, FOLDER))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas"):
        assert unwanted not in plan
    lines = plan.splitlines()
    for at, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            above = " ".join(lines[max(0, at - 3) : at])
            assert "Window" not in above, "a window runs in one task"


def test_filter_and_columns_reach_the_scan(spark):
    plan = plan_of(__spark_entry__.queries()["key_range_scan"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,25.0)]" in plan
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and all("l_comment" not in s and "l_shipdate" not in s for s in scans)


def test_window_and_grouping_share_one_shuffle(spark):
    from wakefold.operators.segments import segment_summaries

    points = spark.createDataFrame(
        [("a", 1, 1.0, 1.0, 1.0, 1.0, 1)],
        "id string, ts long, lon double, lat double, sog double, cog double, pos_key long",
    )
    assert plan_of(segment_summaries(points, ["id"])).count("Exchange") == 1
