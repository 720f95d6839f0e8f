"""Points of trajectories are shuffled once, and only chosen trajectories are taken apart."""

import re

from compare import compare, oracle_connection

import __spark_entry__
from wakefold.operators.tracks import with_parts
from wakefold.plans import sliding, tables

FOLDER = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_stored_trajectories_shuffle_their_points_by_trajectory_only(spark):
    plan = plan_of(tables.Tables(spark, FOLDER).trajectories)
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert dealt and not any("seg#" in keys for keys in dealt)
    assert len({keys.split("#")[0] for keys in dealt if "event_index" in keys}) == 1


def test_long_tracks_are_still_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(tables.Tables, "whole_tracks", property(lambda self: False))
    assert "seg#" in plan_of(tables.Tables(spark, FOLDER).trajectories)


def test_parts_are_the_same_either_way(spark):
    rows = [("a", t, k) for t in range(40) for k in range(1 + t % 3)] + [("b", 7, 1)]
    points = spark.createDataFrame([(*r, r[1] * 10 + r[2]) for r in rows], "k string, ts long, n long, pos_key long")
    cut = with_parts(points, ["k"], 2_000_000, 3).select("k", "pos_key", "part").collect()
    whole = with_parts(points, ["k"], 2_000_000, 3, whole=True).select("k", "pos_key", "part").collect()
    assert sorted(map(tuple, cut)) == sorted(map(tuple, whole)) and {r["part"] for r in whole if r["k"] == "a"} > {0}


def test_only_chosen_trajectories_are_taken_apart(spark):
    plan = plan_of(sliding.request_points(tables.Tables(spark, FOLDER)))
    assert "Generate" in plan and re.search(r"Generate.*posexplode[\s\S]*Join", plan)
    assert not re.search(r"Join[\s\S]*Generate posexplode", plan)


def test_first_window_matches_its_sql(spark):
    name = "first_window"
    assert compare(__spark_entry__.queries()[name](spark, FOLDER), oracle_connection(FOLDER), __spark_entry__.oracle_sql()[name]) == []
