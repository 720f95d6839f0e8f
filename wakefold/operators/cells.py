"""Scalars of sliding windows from summaries of elementary cells.

All edges of all windows lie on one grid, so every window is a run of whole cells: the points
exactly on a grid time, the points between it and the next one, and so on. A cell, or a part of it
where points are dense, is folded to one row with its first and last point. The step from the last
point of the previous cell is added beside it. Windows then add up cells. Points are shuffled once
and never copied into windows, no window is ordered, and a track of any length is spread by time.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakefold.functions.geo import haversine_km
from wakefold.operators.segments import SLOW_KNOTS, STILL_KNOTS, TURN_DEGREES, squared_deviation
from wakefold.operators.windows import ORDER, SPOT, step_values, steps_within, window_cell, window_range

PARENT_SUMS = ["total_area_time", "stagnation_time"]
PARENT_MEANS = ["low_speed_percentage", "average_time_diff_between_consecutive_points"]
PARENT_SETS = ["event_index", "primary_key", "behavior_type_label"]
_STEP = ["dt_ms", "steps", "step_km", "km_gap", "bearing_ms", "turn", "turn_gap", "turns", "path_km"]


def _step_sums(exists: Column, values: dict[str, Column]) -> dict[str, Column]:
    """What a step adds, zeros where there is none; missing positions and headings are counted."""
    zero = F.lit(0.0)
    turn, km = values["turn"], values["step_km"]
    return {
        "dt_ms": F.when(exists, values["dt_ms"]).otherwise(F.lit(0).cast("long")),
        "steps": exists.cast("long"),
        "step_km": F.coalesce(F.when(exists, km), zero),
        "km_gap": (exists & km.isNull()).cast("long"),
        "bearing_ms": F.coalesce(F.when(exists, values["bearing_ms"]), zero),
        "turn": F.coalesce(F.when(exists, turn), zero),
        "turn_gap": (exists & turn.isNull()).cast("long"),
        "turns": F.coalesce(exists & (turn > TURN_DEGREES), F.lit(False)).cast("long"),
    }


def cell_summaries(
    points: DataFrame,
    keys: list[str],
    start_s: Column,
    size_s: int,
    step_s: int,
    part_s: int | None = None,
    parents: bool = False,
) -> DataFrame:
    """One row per keys, cell and part with its own sums and the step from the row before it.

    ``part_s`` cuts a cell further into stretches of so many seconds. With ``parents`` the totals of
    the trajectories that the points come from are kept too (see ``windows.window_features``).
    """
    part = F.floor(F.col("ts_s") / F.lit(part_s)).cast("long") if part_s else F.lit(0).cast("long")
    placed = points.withColumn("start_s", start_s.cast("long")).withColumn(
        "cell", window_cell(F.col("ts_s"), F.col("start_s"), size_s, step_s)
    )
    cell = [*keys, "start_s", "cell", "part"]
    stepped = steps_within(placed.withColumn("part", part), cell)
    within = _step_sums(F.col("p_ts_s").isNotNull(), {c: F.col(c) for c in ("dt_ms", "step_km", "bearing_ms", "turn")})
    point, spot = F.struct(*ORDER, "lon", "lat", "cog"), F.when(F.col("spot").isNotNull(), F.struct(*ORDER, "lon", "lat"))
    inherited = []
    if parents:
        inherited = [
            *[F.sum(c).alias(c) for c in [*PARENT_SUMS, *PARENT_MEANS]],
            *[F.count(c).alias(f"{c}_n") for c in PARENT_MEANS],
            *[F.collect_set(c).alias(f"{c}_set") for c in PARENT_SETS],
        ]
    folded = stepped.groupBy(*cell).agg(
        F.min(point).alias("head"),
        F.max(point).alias("tail"),
        F.min(spot).alias("head_spot"),
        F.max(spot).alias("tail_spot"),
        F.count(F.lit(1)).alias("n"),
        F.count("sog").alias("sog_n"),
        F.count("cog").alias("cog_n"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}_sum") for c in ("sog", "cog")],
        *[squared_deviation(F.col(c)).alias(f"{c}_m2") for c in ("sog", "cog")],
        *[fn(c).alias(f"{name}_{c}") for c in ("sog", "cog") for name, fn in (("min", F.min), ("max", F.max))],
        *[
            fn(F.when(F.col("spot").isNotNull(), F.col(c))).alias(f"{name}_{c}")
            for c in ("lon", "lat")
            for name, fn in (("min", F.min), ("max", F.max))
        ],
        F.count_if(F.col("sog") < SLOW_KNOTS).alias("slow"),
        F.count_if(F.col("sog") < STILL_KNOTS).alias("still"),
        *[F.sum(c).alias(name) for name, c in within.items()],
        F.coalesce(F.sum("path_km"), F.lit(0.0)).alias("path_km"),
        *inherited,
    )
    order = Window.partitionBy(*keys, "start_s").orderBy("cell", "part")
    back = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col("tail_spot").isNotNull(), F.struct("cell", "tail_spot"))
    linked = folded.select(
        "*",
        F.lag("cell").over(order).alias("p_cell"),
        F.lag("tail").over(order).alias("p_tail"),
        F.last(seen, ignorenulls=True).over(back).alias("p_seen"),
    )
    before, here = ({c: F.col(f"{side}.{c}") for c in SPOT} for side in ("p_tail", "head"))
    link = step_values(before, here, F.col("p_seen.tail_spot"), F.col("head_spot"))
    sums = _step_sums(F.col("p_tail").isNotNull(), link)
    return linked.select(
        "*",
        *[c.alias(f"link_{name}") for name, c in sums.items()],
        F.coalesce(link["path_km"], F.lit(0.0)).alias("link_path_km"),
        F.col("p_seen.cell").alias("p_seen_cell"),
    )


def _in_windows(cells: DataFrame, size_s: int, step_s: int) -> DataFrame:
    """Each cell once per window that holds it, with its link only where the row before is inside too."""
    first, last = window_range(F.col("head.ts_s"), F.col("start_s"), size_s, step_s)
    placed = (
        cells.withColumn("_first", first)
        .withColumn("_last", last)
        .where("_first <= _last")
        .withColumn("window_index", F.explode(F.sequence("_first", "_last")))
    )
    opening = F.col("window_index") * F.lit(2 * step_s // gcd(size_s, step_s))
    joined, path = F.col("p_cell") >= opening, F.col("p_seen_cell") >= opening
    total = {name: F.col(name) + F.when(path if name == "path_km" else joined, F.col(f"link_{name}")).otherwise(F.lit(0)) for name in _STEP}
    return placed.withColumns(total)


def _window_keys(keys: list[str], size_s: int, step_s: int) -> list:
    opened = F.col("start_s") + F.col("window_index") * F.lit(step_s)
    return [*keys, "window_index", opened.alias("window_start_s"), (opened + F.lit(size_s)).alias("window_end_s")]


def window_geometry(
    points: DataFrame, keys: list[str], start_s: Column, size_s: int, step_s: int, part_s: int | None = None
) -> DataFrame:
    """What the loitering equations need of each window, as scalars."""
    cells = cell_summaries(points, keys, start_s, size_s, step_s, part_s)
    return _in_windows(cells, size_s, step_s).groupBy(*_window_keys(keys, size_s, step_s)).agg(
        F.sum("n").alias("n_points"),
        F.sum("path_km").alias("path_km"),
        F.when(F.sum("sog_n") == F.sum("n"), F.sum("sog_sum")).alias("sum_sog"),
        F.when(F.sum("turn_gap") == 0, F.sum("turn")).alias("sum_cog_delta"),
        *[fn(f"{name}_{c}").alias(f"{name}_{c}") for c in ("lon", "lat") for name, fn in (("min", F.min), ("max", F.max))],
    )


def _sample_deviation(c: str) -> Column:
    n, m2 = F.sum(f"{c}_n"), F.sum(F.col(f"{c}_m2") + F.coalesce(F.col(f"{c}_n") * (F.col(f"{c}_sum") / F.col(f"{c}_n") - F.col(f"{c}_mean")) ** 2, F.lit(0.0)))
    return F.when(n > 1, F.sqrt(F.try_divide(m2, n - 1)))


def window_scalars(
    points: DataFrame, keys: list[str], start_s: Column, size_s: int, step_s: int, part_s: int | None = None
) -> DataFrame:
    """The metrics and parents of ``windows.window_features`` without its arrays, from cells.

    Deviations add the cells' own squared deviations and the distances of their means from the
    window's mean, which is known before by a window over the few cells of each window.
    """
    cells = cell_summaries(points, keys, start_s, size_s, step_s, part_s, parents=True)
    over = Window.partitionBy(*keys, "start_s", "window_index")
    placed = _in_windows(cells, size_s, step_s).withColumns(
        {f"{c}_mean": F.try_divide(F.sum(f"{c}_sum").over(over), F.sum(f"{c}_n").over(over)) for c in ("sog", "cog")}
        | {f"{c}_n": F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_n")) for c in ("sog", "cog")}
    )
    grouped = placed.groupBy("start_s", *_window_keys(keys, size_s, step_s)).agg(
        F.min("head").alias("head"),
        F.max("tail").alias("tail"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{c}_set")))).alias(f"{c}_set") for c in PARENT_SETS],
        F.sum("n").alias("n_points"),
        *[F.first(f"{c}_mean").alias(f"average_{name}") for c, name in (("sog", "speed"), ("cog", "heading"))],
        *[fn(f"{side}_{c}").alias(f"{side}_{name}") for c, name in (("sog", "speed"), ("cog", "heading")) for side, fn in (("min", F.min), ("max", F.max))],
        *[_sample_deviation(c).alias(f"std_dev_{name}") for c, name in (("sog", "speed"), ("cog", "heading"))],
        *[F.sum(c).alias(c) for c in PARENT_SUMS],
        *[F.try_divide(F.sum(c), F.sum(f"{c}_n")).alias(c) for c in PARENT_MEANS],
        F.sum("dt_ms").cast("double").alias("total_area_time_in_window"),
        F.coalesce(F.try_divide(F.sum("dt_ms"), F.sum("steps")), F.lit(0.0)).alias(
            "average_time_diff_between_consecutive_points_in_window"
        ),
        (F.lit(100.0) * F.sum("slow") / F.sum("n")).alias("low_speed_percentage_in_window"),
        F.when(F.sum("km_gap") == 0, F.sum("step_km")).alias("km"),
        F.when(F.sum("km_gap") < F.sum("steps"), F.sum("bearing_ms")).alias("bearing_ms"),
        F.sum("turns").alias("turns"),
        F.sum("still").alias("still"),
    )
    head, tail, km, span = F.col("head"), F.col("tail"), F.col("km"), F.col("total_area_time_in_window")
    straight = F.coalesce(
        haversine_km(head["lat"], head["lon"], tail["lat"], tail["lon"]),
        F.when(head["lat"].isNull() | tail["lat"].isNull(), F.lit(0.0)),
    )
    return grouped.select(
        F.col("primary_key_set").alias("primary_key_from_aggregated_ais_data"),
        *keys,
        F.col("event_index_set").alias("event_index"),
        F.col("behavior_type_label_set").alias("behavior_type_label"),
        *[f"{side}_{name}" for side in ("average", "min", "max", "std_dev") for name in ("speed", "heading")],
        *PARENT_SUMS, *PARENT_MEANS,
        km.alias("distance_in_kilometers"),
        "n_points", "window_index",
        F.timestamp_seconds("window_start_s").alias("window_start_ts"),
        F.timestamp_seconds("window_end_s").alias("window_end_ts"),
        F.when(km > 0, straight / km).otherwise(F.lit(0.0)).alias("displacement_ratio"),
        F.when(span == 0, F.lit(0.0))
        .when(km.isNotNull(), F.try_divide(F.col("bearing_ms"), span) / 360.0)
        .alias("cog_unit_range"),
        F.when(F.col("n_points") == 1, F.lit(0.0))
        .otherwise(F.try_divide(F.col("turns"), F.col("n_points") - 1))
        .alias("cog_ratio"),
        "total_area_time_in_window",
        "average_time_diff_between_consecutive_points_in_window",
        "low_speed_percentage_in_window",
        (F.col("still") * span / F.col("n_points")).alias("stagnation_time_in_window"),
    )
