"""Sliding windows and loitering equations on hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from wakefold.operators import cells, loitering, windows

SCHEMA = (
    "id string, ts_s long, lon double, lat double, sog double, cog double, event_index long, pos long, "
    "primary_key long, behavior_type_label string, total_area_time double, stagnation_time double, "
    "low_speed_percentage double, average_time_diff_between_consecutive_points double"
)


def frame(spark, points):
    return spark.createDataFrame(
        [(*p, 1, "NORMAL", 10.0, 1.0, 50.0, 5.0) for p in points], SCHEMA
    )


def test_edge_point_is_in_both_windows(spark):
    points = frame(spark, [("a", 100, 0.0, 0.0, 1.0, 0.0, 1, 0)])
    placed = windows.assign_windows(points, F.lit(0).cast("long"), 50, 50)
    assert sorted(r["window_index"] for r in placed.collect()) == [1, 2]


def test_gap_between_windows_is_in_none(spark):
    points = frame(spark, [("a", 30, 0.0, 0.0, 1.0, 0.0, 1, 0)])
    assert windows.assign_windows(points, F.lit(0).cast("long"), 20, 50).count() == 0


@pytest.mark.parametrize("size,step", [(50, 50), (60, 20), (50, 30), (20, 50)])
def test_limit_equals_brute_force(spark, size, step):
    rnd = random.Random(size + step)
    points = [("a" if i % 3 else "b", rnd.randrange(0, 200), 0.0, 0.0, 1.0, 0.0, rnd.randrange(3), i) for i in range(400)]
    kept = windows.window_points(frame(spark, points), ["id"], F.lit(0).cast("long"), size, step, 5)
    got = {(r["id"], r["window_index"], r["pos"]) for r in kept.collect()}
    want = set()
    for vessel in ("a", "b"):
        for k in range(0, 200 // step + 1):
            inside = [p for p in points if p[0] == vessel and k * step <= p[1] <= k * step + size]
            inside.sort(key=lambda p: (p[1], p[6], p[7]))
            want |= {(vessel, k, p[7]) for p in inside[:5]}
    assert got == want


def test_array_and_scalar_equations_agree(spark):
    rnd = random.Random(2)
    points = []
    for i in range(200):
        lon, lat = round(rnd.uniform(0, 1), 4), round(rnd.uniform(40, 41), 4)
        if rnd.random() < 0.1:
            lon = None
        points.append((f"v{i % 7}", rnd.randrange(0, 300), lon, lat, rnd.uniform(0, 9), rnd.uniform(0, 360), 1, i))
    points += [("flat", t, 1.0, 40.0, 1.0, 0.0, 1, 900 + t) for t in (1, 2, 3)]
    placed = windows.window_points(frame(spark, points), ["id"], F.lit(0).cast("long"), 100, 50)
    blocks = windows.window_features(placed, ["id"])
    geometry = cells.window_geometry(frame(spark, points), ["id"], F.lit(0), 100, 50, 7)
    for equation, by_array in (("zhang", loitering.loitering_zhang), ("wn", loitering.loitering_wn)):
        whole = {(r["id"], r["window_index"]): r["trajectory_redundancy"] for r in by_array(blocks).collect()}
        parts = {
            (r["id"], r["window_index"]): r["trajectory_redundancy"]
            for r in loitering.classify_geometry(geometry, equation).collect()
        }
        assert whole.keys() == parts.keys()
        for key, value in whole.items():
            assert value == pytest.approx(parts[key], abs=1e-9)
        assert whole[("flat", 0)] == 0.0


def test_one_point_has_no_sample_deviation(spark):
    block = windows.window_features(
        windows.window_points(frame(spark, [("a", 10, 1.0, 2.0, 3.0, 4.0, 1, 0)]), ["id"], F.lit(0).cast("long"), 50, 50),
        ["id"],
    ).first()
    assert block["std_dev_speed"] is None
    assert block["trajectory"] == "LINESTRING(1.0 2.0)"
    assert block["distance_in_kilometers"] == 0.0


def test_plan_limits_before_the_shuffle(spark):
    points = frame(spark, [("a", 10, 1.0, 2.0, 3.0, 4.0, 1, 0)])
    kept = windows.window_points(points, ["id"], F.lit(0).cast("long"), 50, 50, 250)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "PythonUDF" not in plan


@pytest.mark.parametrize("size,step,part", [(50, 50, None), (240, 10, None), (240, 10, 3), (50, 30, 1), (20, 50, 7)])
def test_cells_equal_ordered_windows(spark, size, step, part):
    rnd = random.Random(size + step)
    rows = []
    for i in range(500):
        missing = rnd.random()
        rows.append((
            "hot" if i % 3 else f"v{i % 5}", rnd.randrange(-20, 300), None if missing < 0.1 else rnd.uniform(0, 1),
            None if missing < 0.05 else rnd.uniform(40, 41), None if 0.1 < missing < 0.2 else rnd.uniform(0, 9),
            None if 0.2 < missing < 0.3 else rnd.uniform(0, 360), rnd.randrange(3), i, rnd.randrange(3),
            rnd.choice(["A", "B", None]), 10.0, None if missing > 0.9 else 1.0, 50.0, None if missing > 0.95 else rnd.uniform(0, 5),
        ))
    rows += [("still", t, 1.0, 40.0, 1000 + t * 1e-5, 7.0, 1, 900 + t, 1, "A", 1.0, 1.0, 1.0, 1.0) for t in range(40)]
    points = spark.createDataFrame(rows, SCHEMA)
    start = F.lit(0).cast("long")
    want = windows.window_features(windows.window_points(points, ["id"], start, size, step), ["id"])
    got = cells.window_scalars(points, ["id"], start, size, step, part)
    names = got.columns
    assert set(names) == set(want.columns) - {"trajectory", "timestamp_array", "sog_array", "cog_array"}
    left = {(r["id"], r["window_index"]): r for r in got.collect()}
    right = {(r["id"], r["window_index"]): r for r in want.select(names).collect()}
    assert left.keys() == right.keys() and len(left) > 10
    for key, row in left.items():
        for name in names:
            a, b = row[name], right[key][name]
            assert a == (pytest.approx(b, rel=1e-6, abs=1e-9) if isinstance(b, float) else b), (key, name)


def test_points_are_shuffled_once_and_not_copied(spark):
    rows = [("hot", k, k / 1000, 2.0, 1.0, 4.0, 1, k) for k in range(1000)]
    points = frame(spark, rows)
    folded = cells.cell_summaries(points, ["id"], F.lit(0), 240, 10, 5)
    assert folded.count() >= 200 and folded.agg(F.sum("n")).first()[0] == 1000
    geometry = {r.window_index: r for r in cells.window_geometry(points, ["id"], F.lit(0), 1000, 1000, 10).collect()}
    assert geometry[0].n_points == 1000 and abs(geometry[0].max_lon - 0.999) < 1e-9
    plan = cells.window_geometry(points, ["id"], F.lit(0), 240, 10)._jdf.queryExecution().executedPlan().toString()
    before = plan.split("Generate explode")[-1]
    assert "Generate explode" in plan and before.count("Window [") >= 2
