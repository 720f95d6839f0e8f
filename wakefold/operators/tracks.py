"""Ordered point arrays, point-to-point steps and their text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakefold.functions import textual
from wakefold.functions.geo import haversine_km
from wakefold.functions.timefmt import ms_text
from wakefold.operators.segments import ENDS, SEGMENT_MS, TARGET_SEGMENT_ROWS, segment_id

PART_POINTS = 50_000


def with_parts(
    points: DataFrame, keys: list[str], segment_ms: int = SEGMENT_MS, part_points: int = PART_POINTS, whole: bool = False
) -> DataFrame:
    """Adds ``part``: consecutive pieces of about ``part_points`` points per trajectory.

    A row cannot hold a trajectory of any length, so arrays are built per part: part 0 is the
    whole trajectory unless it is longer than a part. The part of a time segment follows from
    the number of points before it, counted on segment summaries; segments are narrowed here
    so that one holds no more than a part.

    With ``whole`` a task may hold a track: the points before a segment are counted among the points
    of the key, without a second shuffle of them.
    """
    narrow_ms = max(1, segment_ms * part_points // TARGET_SEGMENT_ROWS)
    keyed = points.withColumn("seg", segment_id(F.col("ts"), narrow_ms))
    if whole:
        for key in keys:
            keyed = keyed.where(F.col(key).isNotNull())
        earlier = Window.partitionBy(*keys).orderBy("seg").rangeBetween(Window.unboundedPreceding, -1)
        part = F.floor(F.count(F.lit(1)).over(earlier) / F.lit(part_points)).cast("long")
        return keyed.withColumn("part", part).drop("seg")
    counts = keyed.groupBy(*keys, "seg").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(*keys).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.select(
        *keys,
        "seg",
        F.floor(F.coalesce(F.sum("rows").over(before), F.lit(0)) / F.lit(part_points)).cast("long").alias("part"),
    )
    return keyed.join(parts, [*keys, "seg"]).drop("seg")


def ordered_points(
    points: DataFrame, keys: list[str], segment_ms: int = SEGMENT_MS, part_points: int = PART_POINTS, whole: bool = False
) -> DataFrame:
    """Time-ordered ``points`` array per key and part; ties follow ``pos_key``."""
    item = F.struct("ts", "pos_key", "lat", "lon", "sog", "cog")
    return (
        with_parts(points, keys, segment_ms, part_points, whole)
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(item)).alias("points"))
    )


def trajectory_arrays(
    points: DataFrame,
    keys: list[str],
    segment_ms: int = SEGMENT_MS,
    part_points: int = PART_POINTS,
    decimals: int | None = None,
    whole: bool = False,
) -> DataFrame:
    """WKT, time text, speed and heading arrays per key and part."""
    return _array_columns(ordered_points(points, keys, segment_ms, part_points, whole), [*keys, "part"], decimals)


def _array_columns(built: DataFrame, keys: list[str], decimals: int | None = None) -> DataFrame:
    return built.select(
        *keys,
        textual.linestring(F.col("points"), decimals).alias("trajectory"),
        F.transform("points", lambda p: ms_text(p["ts"])).alias("timestamp_array"),
        F.transform("points", lambda p: p["sog"]).alias("sog_array"),
        F.transform("points", lambda p: p["cog"]).alias("cog_array"),
    )


def open_ended_arrays(
    points: DataFrame, starts: DataFrame, segment_ms: int = SEGMENT_MS, part_points: int = PART_POINTS
) -> DataFrame:
    """Array parts of the rest of the vessel's track from each start on.

    The output itself repeats later points for every start, so use it for chosen events; the
    features of all events come from ``features.open_ended_features`` without it. Whole parts
    are matched, not points, and the first part of each start is cut to its time.
    """
    parts = ordered_points(points, ["id"], segment_ms, part_points)
    spans = parts.select("id", "part", F.element_at("points", -1)["ts"].alias("last_ts"))
    wanted = starts.join(spans, "id").where(F.col("last_ts") >= F.col("from_ms")).drop("last_ts")
    cut = F.filter("points", lambda p: p["ts"] >= F.col("from_ms"))
    keys = [*starts.columns, "part"]
    return _array_columns(wanted.join(parts, ["id", "part"]).withColumn("points", cut), keys)


def point_steps(points: DataFrame, keys: list[str], segment_ms: int = SEGMENT_MS) -> DataFrame:
    """Every point with its predecessor on the track (null for the first).

    Inside a segment the predecessor is a ``lag``. For the first point of a segment it is the
    last point of the nearest earlier segment, found on segment ends and joined back.
    """
    keyed = points.withColumn("seg", segment_id(F.col("ts"), segment_ms))
    ends = keyed.groupBy(*keys, "seg").agg(
        F.max_by(F.struct(*ENDS), F.struct("ts", "pos_key")).alias("end")
    )
    order = Window.partitionBy(*keys).orderBy("seg")
    carried = ends.select(*keys, "seg", F.lag("end").over(order).alias("carried"))
    inside = Window.partitionBy(*keys, "seg").orderBy("ts", "pos_key")
    stepped = keyed.withColumn("prev", F.lag(F.struct(*ENDS)).over(inside))
    return stepped.join(carried, [*keys, "seg"]).select(
        *[c for c in points.columns],
        *[F.coalesce(F.col("prev"), F.col("carried"))[c].alias(f"prev_{c}") for c in ENDS],
    )


def point_deltas(points: DataFrame, keys: list[str], segment_ms: int = SEGMENT_MS) -> DataFrame:
    """Time difference and distance of each point to its predecessor."""
    steps = point_steps(points, keys, segment_ms)
    return steps.select(
        *keys,
        "pos_key",
        (F.col("ts") - F.col("prev_ts")).alias("time_diff_ms"),
        haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon")).alias("step_km"),
    )


def explode_arrays(trajectories: DataFrame, parents: list[str]) -> DataFrame:
    """One row per position of the stored arrays, whether they are arrays or text.

    Text cells that cannot be read give null; a trajectory without cells keeps one null row.
    ``pos`` runs on over the parts of a trajectory in order (not without gaps).
    """

    def cells(name: str):
        kind = trajectories.schema[name].dataType.typeName()
        return textual.text_cells(F.col(name)) if kind == "string" else F.col(name)

    zipped = F.arrays_zip(
        cells("timestamp_array").alias("t"),
        cells("sog_array").alias("s"),
        cells("cog_array").alias("c"),
        textual.wkt_points(F.col("trajectory")).alias("p"),
    )
    pos = F.col("pos").cast("long")
    if "part" in parents:
        pos = F.shiftleft("part", 32) + pos
    return (
        trajectories.select(*parents, F.posexplode_outer(zipped).alias("pos", "cell"))
        .select(
            *parents,
            pos.alias("pos"),
            F.unix_seconds(textual.cell_timestamp(F.col("cell.t"))).alias("ts_s"),
            F.col("cell.s").try_cast("double").alias("sog"),
            F.col("cell.c").try_cast("double").alias("cog"),
            F.col("cell.p.lon").alias("lon"),
            F.col("cell.p.lat").alias("lat"),
        )
    )


def trajectory_span(trajectories: DataFrame, keys: list[str]) -> DataFrame:
    """First and last time, duration and size read from the time array or its text."""
    kind = trajectories.schema["timestamp_array"].dataType.typeName()
    cells = textual.text_cells(F.col("timestamp_array")) if kind == "string" else F.col("timestamp_array")
    framed = trajectories.withColumn("cells", cells)
    first = textual.cell_timestamp(F.try_element_at("cells", F.lit(1)))
    last = textual.cell_timestamp(F.try_element_at("cells", F.lit(-1)))
    return framed.select(
        *keys,
        F.unix_seconds(first).alias("traj_start_s"),
        F.unix_seconds(last).alias("traj_end_s"),
        (F.unix_seconds(last) - F.unix_seconds(first)).alias("duration_s"),
        F.size("cells").cast("long").alias("ts_size"),
    )
