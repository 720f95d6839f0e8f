"""Sliding-window loitering over a stream of positions.

Two stateful steps with one watermark. The first groups a vessel's points by elementary cell, a
tumbling window of the common divisor of window size and step, and folds a closed cell to scalars:
so a point is held once in the state, whatever the number of windows over it, and only until its
cell closes. The second collects the few cell rows of each window and joins them in order. Both give
rows only when the watermark has passed their end, so each window appears once, complete; points
behind the watermark are dropped. Window k is ``[start + k*step, start + k*step + size]`` as in
``operators.windows``; a point on an edge belongs to both neighbours, therefore a cell also carries
the fold of the points exactly on its first second.
"""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakefold.functions.geo import haversine_km

_BOX = ["min_lon", "max_lon", "min_lat", "max_lat"]


def _pairs(values: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f over neighbours of an array."""
    n = F.size(values)
    both = F.zip_with(F.slice(values, F.lit(1), n - 1), F.slice(values, F.lit(2), n - 1), f)
    return F.when(n > 1, both).otherwise(F.array().cast("array<double>"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def _km(a: Column, b: Column) -> Column:
    return haversine_km(a["lat"], a["lon"], b["lat"], b["lon"])


def _folded(points: Column) -> Column:
    """Scalars of an ordered array of points and its first and last point and located point."""
    spots = F.filter(points, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    turns = _pairs(points, lambda a, b: F.abs(b["cog"] - a["cog"]))
    return F.struct(
        F.size(points).cast("long").alias("n"),
        _total(_pairs(spots, _km)).alias("path_km"),
        _total(F.transform(points, lambda p: p["sog"])).alias("sum_sog"),
        F.exists(points, lambda p: p["sog"].isNull()).alias("sog_gap"),
        _total(turns).alias("turn"),
        F.exists(turns, lambda x: x.isNull()).alias("turn_gap"),
        *[
            fn(_field(spots, c)).alias(f"{name}_{c}")
            for c in ("lon", "lat")
            for name, fn in (("min", F.array_min), ("max", F.array_max))
        ],
        F.get(points, F.lit(0))["cog"].alias("head_cog"),
        F.get(points, F.size(points) - 1)["cog"].alias("tail_cog"),
        F.get(spots, F.lit(0)).alias("head_spot"),
        F.get(spots, F.size(spots) - 1).alias("tail_spot"),
    )


def _field(points: Column, name: str) -> Column:
    return F.transform(points, lambda p: p[name])


def _joined(a: Column, b: Column) -> Column:
    """Fold of the points of ``a`` followed by those of ``b``; either may have no point."""
    turn = F.abs(b["head_cog"] - a["tail_cog"])
    both = F.struct(
        (a["n"] + b["n"]).alias("n"),
        (a["path_km"] + b["path_km"] + F.coalesce(_km(a["tail_spot"], b["head_spot"]), F.lit(0.0))).alias("path_km"),
        (a["sum_sog"] + b["sum_sog"]).alias("sum_sog"),
        (a["sog_gap"] | b["sog_gap"]).alias("sog_gap"),
        (a["turn"] + b["turn"] + F.coalesce(turn, F.lit(0.0))).alias("turn"),
        (a["turn_gap"] | b["turn_gap"] | turn.isNull()).alias("turn_gap"),
        *[(F.least if c[:3] == "min" else F.greatest)(a[c], b[c]).alias(c) for c in _BOX],
        a["head_cog"].alias("head_cog"),
        b["tail_cog"].alias("tail_cog"),
        F.coalesce(a["head_spot"], b["head_spot"]).alias("head_spot"),
        F.coalesce(b["tail_spot"], a["tail_spot"]).alias("tail_spot"),
    )
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)


def window_stream(points: DataFrame, start_s: int, size_s: int, step_s: int, delay: str = "1 hour") -> DataFrame:
    """Window scalars (as ``operators.cells.window_geometry``) of closed windows, from streamed points.

    ``points`` has id, ts_s, event_index, pos, lon, lat, sog, cog. Rows without id or time are left out.
    Windows that began before ``start_s`` are not given. A window appears when the watermark, ``delay``
    behind the latest time seen, has passed its end and one grid cell more.
    """
    grid = gcd(size_s, step_s)
    at = F.timestamp_seconds("ts_s").alias("at")
    spot = F.struct("ts_s", "event_index", "pos", "lon", "lat", "sog", "cog")
    timed = points.where("id IS NOT NULL AND ts_s IS NOT NULL").select("id", at, spot.alias("p")).withWatermark("at", delay)
    cell = F.window("at", f"{grid} seconds", startTime=f"{start_s % grid} seconds").alias("cell")
    ordered = timed.groupBy("id", cell).agg(F.array_sort(F.collect_list("p")).alias("points"))
    first = F.unix_seconds("cell.start")
    cells = ordered.select(
        "id", "cell", first.alias("cell_s"),
        _folded(F.col("points")).alias("whole"),
        _folded(F.filter("points", lambda p: p["ts_s"] == first)).alias("edge"),
    )
    # One cell more than the window: of the cell that begins where the window ends, the edge counts.
    over = F.window(F.window_time("cell"), f"{size_s + grid} seconds", f"{step_s} seconds", f"{start_s % step_s} seconds").alias("window")
    rows = F.array_sort(F.collect_list(F.struct("cell_s", "whole", "edge")))
    windows = cells.groupBy("id", over).agg(rows.alias("cells"))
    opened = F.unix_seconds("window.start")
    parts = F.transform("cells", lambda c: F.when(c["cell_s"] == opened + size_s, c["edge"]).otherwise(c["whole"]))
    folded = windows.select("id", opened.alias("window_start_s"), parts.alias("parts")).select(
        "id",
        "window_start_s",
        F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.get("parts", F.lit(0)), _joined).alias("f"),
    )
    return folded.where((F.col("f.n") > 0) & (F.col("window_start_s") >= start_s)).select(
        "id",
        F.expr(f"(window_start_s - {start_s}) div {step_s}").alias("window_index"),
        "window_start_s",
        (F.col("window_start_s") + size_s).alias("window_end_s"),
        F.col("f.n").alias("n_points"),
        "f.path_km",
        F.when(~F.col("f.sog_gap"), F.col("f.sum_sog")).alias("sum_sog"),
        F.when(~F.col("f.turn_gap"), F.col("f.turn")).alias("sum_cog_delta"),
        *[f"f.{c}" for c in _BOX],
    )


def run_available(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what the files present by now give to a Parquet folder, once, and stops.

    Called again it goes on from the checkpoint: files are read once, state is kept, and a batch that
    was cut off is repeated under its own number, so the folder holds each row once.
    """
    stream = rows.writeStream.format("parquet").outputMode("append")
    stream.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
