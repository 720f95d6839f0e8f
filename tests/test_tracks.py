"""Segmented track arithmetic against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wakefold.operators import features, segments, tracks
from wakefold.schemas import FEATURES

POINTS = "id string, ts long, lon double, lat double, sog double, cog double, pos_key long"


def haversine(a, b):
    (lon1, lat1), (lon2, lat2) = a, b
    if None in (lon1, lat1, lon2, lat2):
        return None
    p1, p2 = math.radians(lat1), math.radians(lat2)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def expected(rows):
    """The sixteen features of (ts, lon, lat, sog, cog, key) rows."""
    rows = sorted(rows, key=lambda r: (r[0], r[5]))
    n = len(rows)
    sog = [r[3] for r in rows if r[3] is not None]
    cog = [r[4] for r in rows if r[4] is not None]
    pairs = list(zip(rows, rows[1:]))
    dts = [b[0] - a[0] for a, b in pairs]
    span = sum(dts)
    kms = [haversine(a[1:3], b[1:3]) for a, b in pairs]
    km = None if None in kms else sum(kms)

    def stats(values):
        if not values:
            return 0.0, None, None, 0.0
        mean = sum(values) / len(values)
        return mean, min(values), max(values), math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))

    s, c = stats(sog), stats(cog)
    bearing = None
    if km is not None:
        bearing = sum(
            ((math.degrees(math.atan2(b[1] - a[1], b[2] - a[2])) + 360) % 360) * (b[0] - a[0]) for a, b in pairs
        )
    turns = sum(1 for a, b in pairs if None not in (a[4], b[4]) and abs(b[4] - a[4]) > 10)
    straight = haversine(rows[0][1:3], rows[-1][1:3])
    return {
        "average_speed": s[0], "min_speed": s[1], "max_speed": s[2], "std_dev_speed": s[3],
        "average_heading": c[0], "min_heading": c[1], "max_heading": c[2], "std_dev_heading": c[3],
        "total_area_time": float(span),
        "low_speed_percentage": 100.0 * sum(1 for v in sog if v < 2) / n,
        "stagnation_time": sum(1 for v in sog if v < 0.5) * span / n,
        "distance_in_kilometers": km,
        "average_time_diff_between_consecutive_points": span / len(dts) if dts else 0.0,
        "displacement_ratio": straight / km if km else 0.0,
        "cog_unit_range": 0.0 if span == 0 else None if bearing is None else bearing / span / 360,
        "cog_ratio": turns / (n - 1) if n > 1 else 0.0,
    }


def make_rows(seed, gaps):
    rnd = random.Random(seed)
    rows = []
    for key in range(300):
        vessel = "hot" if key % 3 == 0 else f"v{rnd.randrange(12)}"
        ts = rnd.randrange(0, 40) * 500
        value = lambda low, high: round(rnd.uniform(low, high), 3)
        lon, lat = value(-5, 5), value(40, 50)
        sog, cog = value(0, 5), value(0, 360)
        if gaps and rnd.random() < 0.1:
            lon, lat = (None, lat) if rnd.random() < 0.5 else (None, None)
        if gaps and rnd.random() < 0.2:
            sog = None
        if gaps and rnd.random() < 0.2:
            cog = None
        rows.append((vessel, ts, lon, lat, sog, cog, key))
    rows.append(("single", 77, 1.0, 2.0, 3.0, 4.0, 1000))
    rows += [("still", 100 * i, 1.0, 2.0, 0.1, 359.0 if i % 2 else 1.0, 2000 + i) for i in range(4)]
    return rows


def check(got, want):
    for name in FEATURES:
        if want[name] is None:
            assert got[name] is None, name
        else:
            assert got[name] == pytest.approx(want[name], abs=1e-6), name


@pytest.mark.parametrize("segment_ms", [1, 900, 10**12])
@pytest.mark.parametrize("gaps", [False, True])
def test_features_do_not_depend_on_segments(spark, segment_ms, gaps):
    rows = make_rows(5, gaps)
    frame = spark.createDataFrame(rows, POINTS)
    found = {r["id"]: r for r in features.trajectory_features(frame, ["id"], segment_ms).collect()}
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row[1:])
    assert set(found) == set(groups)
    for vessel, points in groups.items():
        check(found[vessel], expected(points))


@pytest.mark.parametrize("segment_ms", [1, 700, 10**12])
@pytest.mark.parametrize("gaps", [False, True])
def test_rest_of_track_without_pairing(spark, segment_ms, gaps):
    rows = make_rows(9, gaps)
    starts = [(i, v, "NORMAL", t) for i, (v, t) in enumerate(
        (v, t) for v in ("hot", "v1", "v2", "single", "still", "absent") for t in (-5, 0, 500, 501, 9000, 19500, 10**6)
    )]
    bounds = spark.createDataFrame(starts, "event_index long, id string, Category string, from_ms long")
    found = features.open_ended_features(spark.createDataFrame(rows, POINTS), bounds, segment_ms)
    got = {r["event_index"]: r for r in found.collect()}
    for index, vessel, _, begin in starts:
        later = [r[1:] for r in rows if r[0] == vessel and r[1] >= begin]
        if later:
            assert got[index]["n_points"] == len(later)
            check(got[index], expected(later))
        else:
            assert index not in got


def test_parts_keep_every_point_in_order(spark):
    rows = make_rows(3, True)
    frame = spark.createDataFrame(rows, POINTS)
    built = tracks.ordered_points(frame, ["id"], 10**9, part_points=7).orderBy("id", "part").collect()
    joined = {}
    for row in built:
        joined.setdefault(row["id"], []).extend(p["pos_key"] for p in row["points"])
    for vessel, keys in joined.items():
        want = [r[6] for r in sorted((r for r in rows if r[0] == vessel), key=lambda r: (r[1], r[6]))]
        assert keys == want
    assert max(r["part"] for r in built if r["id"] == "hot") > 3


def test_steps_cross_segments(spark):
    rows = make_rows(4, False)
    frame = spark.createDataFrame(rows, POINTS)
    narrow = {(r["pos_key"], r["prev_ts"], r["prev_lon"]) for r in tracks.point_steps(frame, ["id"], 1).collect()}
    wide = {(r["pos_key"], r["prev_ts"], r["prev_lon"]) for r in tracks.point_steps(frame, ["id"], 10**12).collect()}
    assert narrow == wide


def test_segment_width_follows_density(spark):
    frame = spark.createDataFrame(make_rows(5, False), POINTS)
    width = segments.suggest_segment_ms(frame, target_rows=10)
    crowded = frame.groupBy("id", segments.segment_id(F.col("ts"), width)).count().agg(F.max("count")).first()[0]
    assert width < 3_600_000
    assert crowded <= 100  # the test points are not spread evenly inside their hour


def test_open_ended_arrays_hold_every_later_point(spark):
    rows = make_rows(6, True)
    starts = [(i, v, t) for i, (v, t) in enumerate((v, t) for v in ("hot", "v1", "absent") for t in (0, 7000, 19000))]
    frame = spark.createDataFrame(starts, "event_index long, id string, from_ms long")
    built = tracks.open_ended_arrays(spark.createDataFrame(rows, POINTS), frame, 10**9, part_points=9)
    got = {}
    for row in built.orderBy("event_index", "part").collect():
        got.setdefault(row["event_index"], []).extend(row["cog_array"])
    for index, vessel, begin in starts:
        later = sorted((r for r in rows if r[0] == vessel and r[1] >= begin), key=lambda r: (r[1], r[6]))
        assert got.get(index, []) == [r[5] for r in later]


@pytest.mark.parametrize("segment_ms", [1, 3, 10**9])
def test_small_deviations_of_large_speeds(spark, segment_ms):
    rows = [("a", k, 1.0, 2.0, 1000 + k * 1e-5, 300 + k * 1e-5, k) for k in range(10)]
    points = spark.createDataFrame(rows, POINTS)
    whole = features.trajectory_features(points, ["id"], segment_ms).first()
    want = points.select(F.stddev_pop("sog").alias("s"), F.stddev_pop("cog").alias("c")).first()
    assert whole.std_dev_speed == pytest.approx(want.s, rel=1e-6) and abs(want.s - 2.8723e-5) < 1e-9
    assert whole.std_dev_heading == pytest.approx(want.c, rel=1e-6)
    starts = spark.createDataFrame([(1, "a", 0, "X"), (2, "a", 5, "X")], "event_index long, id string, from_ms long, Category string")
    rest = {r.event_index: r for r in features.open_ended_features(points, starts, segment_ms).collect()}
    assert rest[1].std_dev_speed == pytest.approx(want.s, rel=1e-6)
    late = points.where("ts >= 5").select(F.stddev_pop("sog").alias("s")).first().s
    assert rest[2].std_dev_speed == pytest.approx(late, rel=1e-6)
