"""Two published loitering equations over window blocks or window scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakefold.functions.geo import EARTH_RADIUS_KM, box_perimeter_km, haversine_km
from wakefold.functions.textual import wkt_points


def _steps(values: Column) -> Column:
    """Array of ``struct<a, b>`` of neighbouring elements."""
    size = F.size(values)
    return F.when(
        size > 1,
        F.zip_with(
            F.slice(values, F.lit(1), size - 1),
            F.slice(values, F.lit(2), size - 1),
            lambda a, b: F.struct(a.alias("a"), b.alias("b")),
        ),
    ).otherwise(F.array())


def _total(values: Column) -> Column:
    """Sum of an array; null if an element is null."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def path_km(points: Column, radius_km: float = EARTH_RADIUS_KM) -> Column:
    return _total(
        F.transform(
            _steps(points),
            lambda s: haversine_km(s["a"]["lat"], s["a"]["lon"], s["b"]["lat"], s["b"]["lon"], radius_km),
        )
    )


def redundancy_zhang(path: Column, perimeter: Column) -> Column:
    """Path length over bounding-box perimeter."""
    return F.when(perimeter > 0, path / perimeter).otherwise(F.lit(0.0))


def redundancy_wn(path: Column, turn: Column, perimeter: Column, speed: Column) -> Column:
    """(path length x summed turn) over (perimeter x summed speed)."""
    return F.when((perimeter > 0) & (speed > 0), path * turn / (perimeter * speed)).otherwise(F.lit(0.0))


def behavior(redundancy: Column, threshold: float = 1.0) -> Column:
    return F.when(redundancy > F.lit(float(threshold)), F.lit("LOITERING")).otherwise(F.lit("NON-LOITERING"))


def _classified(frame: DataFrame, redundancy: Column, threshold: float, keep: list[str]) -> DataFrame:
    scored = frame.withColumn("trajectory_redundancy", redundancy)
    scored = scored.withColumn(
        "behavior_type_by_loitering_equation", behavior(F.col("trajectory_redundancy"), threshold)
    )
    added = ["trajectory_redundancy", "behavior_type_by_loitering_equation"]
    return scored.select(*keep, *[c for c in added if c not in keep])


def _with_box(blocks: DataFrame, radius_km: float) -> DataFrame:
    spots = blocks.withColumn("spots", wkt_points(F.col("trajectory")))
    lon, lat = F.col("spots.lon"), F.col("spots.lat")
    perimeter = box_perimeter_km(
        F.array_min(lon), F.array_max(lon), F.array_min(lat), F.array_max(lat), radius_km
    )
    return spots.withColumn("path", path_km(F.col("spots"), radius_km)).withColumn("perimeter", perimeter)


def loitering_zhang(
    blocks: DataFrame, earth_radius_km: float = EARTH_RADIUS_KM, redundancy_threshold: float = 1.0
) -> DataFrame:
    """Window blocks with redundancy and label; input columns stay as they are."""
    boxed = _with_box(blocks, earth_radius_km)
    redundancy = redundancy_zhang(F.col("path"), F.col("perimeter"))
    return _classified(boxed, redundancy, redundancy_threshold, blocks.columns)


def loitering_wn(
    blocks: DataFrame, earth_radius_km: float = EARTH_RADIUS_KM, redundancy_threshold: float = 1.0
) -> DataFrame:
    """Same, by the equation that also uses speed and turns."""
    boxed = _with_box(blocks, earth_radius_km)
    speed = F.when(F.col("sog_array").isNull(), F.lit(0.0)).otherwise(_total(F.col("sog_array")))
    turn = F.when(F.col("cog_array").isNull(), F.lit(0.0)).otherwise(
        _total(F.transform(_steps(F.col("cog_array")), lambda s: F.abs(s["b"] - s["a"])))
    )
    redundancy = redundancy_wn(F.col("path"), turn, F.col("perimeter"), speed)
    return _classified(boxed, redundancy, redundancy_threshold, blocks.columns)


def classify_geometry(
    geometry: DataFrame, equation: str = "wn", threshold: float = 1.0, radius_km: float = EARTH_RADIUS_KM
) -> DataFrame:
    """Labels window scalars (``operators.windows.window_geometry``) without building arrays."""
    perimeter = box_perimeter_km(
        F.col("min_lon"), F.col("max_lon"), F.col("min_lat"), F.col("max_lat"), radius_km
    )
    if equation == "zhang":
        redundancy = redundancy_zhang(F.col("path_km"), perimeter)
    elif equation == "wn":
        redundancy = redundancy_wn(F.col("path_km"), F.col("sum_cog_delta"), perimeter, F.col("sum_sog"))
    else:
        raise ValueError(f"unknown equation {equation!r}")
    return _classified(geometry, redundancy, threshold, geometry.columns)
