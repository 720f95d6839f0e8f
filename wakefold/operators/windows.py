"""Sliding windows over tracks, anchored at a request's start, both ends included."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakefold.functions import textual
from wakefold.functions.geo import haversine_km, planar_bearing
from wakefold.functions.timefmt import TEXT_FORMAT
from wakefold.operators.segments import TURN_DEGREES

ORDER = ["ts_s", "event_index", "pos"]
SPOT = ["ts_s", "lon", "lat", "cog"]


def window_range(ts_s: Column, start_s: Column, size_s: int, step_s: int) -> tuple[Column, Column]:
    """First and last index of the windows that hold a time.

    Window k is ``[start + k*step, start + k*step + size]``, so a point exactly on an edge
    belongs to both neighbours. Windows may run past the end of the request.
    """
    offset = ts_s - start_s
    first = F.ceil((offset - F.lit(size_s)) / F.lit(step_s)).cast("long")
    last = F.floor(offset / F.lit(step_s)).cast("long")
    return F.greatest(first, F.lit(0).cast("long")), last


def assign_windows(points: DataFrame, start_s: Column, size_s: int, step_s: int) -> DataFrame:
    """One row per point and window. Points in no window (possible if step > size) are left out."""
    first, last = window_range(F.col("ts_s"), start_s, size_s, step_s)
    return (
        points.withColumn("first_window", first)
        .withColumn("last_window", last)
        .where(F.col("first_window") <= F.col("last_window"))
        .withColumn("window_index", F.explode(F.sequence("first_window", "last_window")))
        .drop("first_window", "last_window")
        .withColumn("window_start_s", start_s + F.col("window_index") * F.lit(step_s))
        .withColumn("window_end_s", F.col("window_start_s") + F.lit(size_s))
    )


def window_cell(ts_s: Column, start_s: Column, size_s: int, step_s: int) -> Column:
    """Number of the elementary cell of a time; every window is a run of whole cells.

    All window edges are multiples of the common divisor of size and step after the start. A
    time on such a multiple is a cell of its own (even number), the open stretch between two
    multiples is the odd number after it.
    """
    grid = gcd(size_s, step_s)
    offset = ts_s - start_s
    slot = F.floor(offset / F.lit(grid)).cast("long")
    return slot * 2 + (slot * grid != offset).cast("long")


def window_points(
    points: DataFrame,
    keys: list[str],
    start_s: Column,
    size_s: int,
    step_s: int,
    max_points: int | None = None,
) -> DataFrame:
    """The points of each window; with ``max_points`` the first of them in the order of ``ORDER``.

    A point that is not among the first ``max_points`` of its cell cannot be among the first
    of any window, because a window holds whole cells. So the limit is first taken per cell,
    before points are copied into windows. Spark applies a ``row_number`` limit already before
    the shuffle, which keeps a crowded cell from reaching one task, and every window then
    receives a bounded number of rows.
    """
    if max_points is None:
        return assign_windows(points, start_s, size_s, step_s)
    cells = points.withColumn("cell", window_cell(F.col("ts_s"), start_s, size_s, step_s))
    in_cell = Window.partitionBy(*keys, "cell").orderBy(*ORDER)
    few = cells.withColumn("rank", F.row_number().over(in_cell)).where(F.col("rank") <= max_points)
    placed = assign_windows(few.drop("rank", "cell"), start_s, size_s, step_s)
    in_window = Window.partitionBy(*keys, "window_index").orderBy(*ORDER)
    return placed.withColumn("rank", F.row_number().over(in_window)).where(F.col("rank") <= max_points)


def steps_within(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the step to each point from its predecessor under the same keys.

    ``path_km`` and the turn follow the rules of the loitering equations: the path skips points
    without a position.
    """
    order = Window.partitionBy(*keys).orderBy(*ORDER)
    located = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.struct("lon", "lat"))
    back = order.rowsBetween(Window.unboundedPreceding, -1)
    framed = rows.select(
        "*",
        *[F.lag(c).over(order).alias(f"p_{c}") for c in SPOT],
        F.last(located, ignorenulls=True).over(back).alias("p_spot"),
        located.alias("spot"),
    )
    before, here = ({c: F.col(f"{p}{c}") for c in SPOT} for p in ("p_", ""))
    return framed.select("*", *[c.alias(n) for n, c in step_values(before, here, F.col("p_spot"), F.col("spot")).items()])


def step_values(a: dict[str, Column], b: dict[str, Column], a_spot: Column, b_spot: Column) -> dict[str, Column]:
    """Measures of the step from point ``a`` to ``b``, and of the path from one located point to another."""
    dt_ms = (b["ts_s"] - a["ts_s"]) * 1000
    return {
        "dt_ms": dt_ms,
        "step_km": haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]),
        "bearing_ms": planar_bearing(b["lon"] - a["lon"], b["lat"] - a["lat"]) * dt_ms,
        "turn": F.abs(b["cog"] - a["cog"]),
        "path_km": haversine_km(a_spot["lat"], a_spot["lon"], b_spot["lat"], b_spot["lon"]),
    }


def window_features(windowed: DataFrame, keys: list[str]) -> DataFrame:
    """Full window blocks: arrays, parents and metrics.

    Rows carry, besides the point, the totals of the trajectory they come from
    (``primary_key``, ``event_index``, ``behavior_type_label``, ``total_area_time``,
    ``stagnation_time``, ``low_speed_percentage``,
    ``average_time_diff_between_consecutive_points``). As in the stored form those totals are
    added or averaged once per point; ``*_in_window`` columns hold the values of the window
    itself. Deviations are sample deviations. Arrays hold every point of the window.
    """
    stepped = steps_within(windowed, [*keys, "window_index"])
    is_step = F.col("p_ts_s").isNotNull()
    spot = F.struct(*ORDER, "lon", "lat", "sog", "cog")
    grouped = stepped.groupBy(*keys, "window_index", "window_start_s", "window_end_s").agg(
        F.array_sort(F.collect_list(spot)).alias("points"),
        F.array_sort(F.collect_set("event_index")).alias("event_index"),
        F.array_sort(F.collect_set("primary_key")).alias("primary_key_from_aggregated_ais_data"),
        F.array_sort(F.collect_set("behavior_type_label")).alias("behavior_type_label"),
        F.count(F.lit(1)).alias("n_points"),
        F.avg("sog").alias("average_speed"),
        F.min("sog").alias("min_speed"),
        F.max("sog").alias("max_speed"),
        F.stddev("sog").alias("std_dev_speed"),
        F.avg("cog").alias("average_heading"),
        F.min("cog").alias("min_heading"),
        F.max("cog").alias("max_heading"),
        F.stddev("cog").alias("std_dev_heading"),
        F.avg("average_time_diff_between_consecutive_points").alias(
            "average_time_diff_between_consecutive_points"
        ),
        F.sum("total_area_time").alias("total_area_time"),
        F.avg("low_speed_percentage").alias("low_speed_percentage"),
        F.sum("stagnation_time").alias("stagnation_time"),
        F.coalesce(F.sum("dt_ms"), F.lit(0)).cast("double").alias("total_area_time_in_window"),
        F.coalesce(F.avg("dt_ms"), F.lit(0.0)).alias(
            "average_time_diff_between_consecutive_points_in_window"
        ),
        (F.lit(100.0) * F.count_if(F.col("sog") < 2) / F.count(F.lit(1))).alias(
            "low_speed_percentage_in_window"
        ),
        F.coalesce(F.sum("step_km"), F.lit(0.0)).alias("km"),
        F.count_if(is_step & F.col("step_km").isNull()).alias("km_gap"),
        F.sum("bearing_ms").alias("bearing_ms"),
        F.count_if(F.col("turn") > TURN_DEGREES).alias("turns"),
        F.count_if(F.col("sog") < 0.5).alias("still"),
    )
    first, last = F.col("points")[0], F.element_at("points", -1)
    straight = F.coalesce(
        haversine_km(first["lat"], first["lon"], last["lat"], last["lon"]),
        F.when(first["lat"].isNull() | last["lat"].isNull(), F.lit(0.0)),
    )
    known = F.col("km_gap") == 0
    span = F.col("total_area_time_in_window")
    km = F.when(known, F.col("km"))
    return grouped.select(
        "primary_key_from_aggregated_ais_data",
        *keys,
        "event_index",
        textual.linestring(F.col("points")).alias("trajectory"),
        F.transform(
            "points", lambda p: F.date_format(F.timestamp_seconds(p["ts_s"]), TEXT_FORMAT)
        ).alias("timestamp_array"),
        F.transform("points", lambda p: p["sog"]).alias("sog_array"),
        F.transform("points", lambda p: p["cog"]).alias("cog_array"),
        "behavior_type_label",
        "average_speed", "min_speed", "max_speed",
        "average_heading", "min_heading", "max_heading", "std_dev_heading", "std_dev_speed",
        "total_area_time", "low_speed_percentage", "stagnation_time",
        km.alias("distance_in_kilometers"),
        "average_time_diff_between_consecutive_points",
        "n_points",
        "window_index",
        F.timestamp_seconds("window_start_s").alias("window_start_ts"),
        F.timestamp_seconds("window_end_s").alias("window_end_ts"),
        F.when(km > 0, straight / km).otherwise(F.lit(0.0)).alias("displacement_ratio"),
        F.when(span == 0, F.lit(0.0))
        .when(known, F.try_divide(F.col("bearing_ms"), span) / 360.0)
        .alias("cog_unit_range"),
        F.when(F.col("n_points") == 1, F.lit(0.0))
        .otherwise(F.try_divide(F.col("turns"), F.col("n_points") - 1))
        .alias("cog_ratio"),
        "total_area_time_in_window",
        "average_time_diff_between_consecutive_points_in_window",
        "low_speed_percentage_in_window",
        (F.col("still") * span / F.col("n_points")).alias("stagnation_time_in_window"),
    )


def inside_interval(points: DataFrame, start_s: Column, end_s: Column) -> DataFrame:
    return points.where(F.col("ts_s").between(start_s, end_s))


def sliding_windows(
    points: DataFrame,
    keys: list[str],
    size_s: int,
    step_s: int,
    max_points: int | None = None,
) -> DataFrame:
    """Window blocks of exploded trajectory points that carry their request's bounds.

    ``points`` holds ``start_s`` and ``end_s`` of the request next to ``keys``.
    """
    inside = inside_interval(points, F.col("start_s"), F.col("end_s"))
    windowed = window_points(inside, keys, F.col("start_s"), size_s, step_s, max_points)
    return window_features(windowed, keys)


def first_window(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The window with the lowest index per key."""
    order = Window.partitionBy(*keys).orderBy("window_index")
    return blocks.withColumn("at", F.row_number().over(order)).where("at = 1").drop("at")
