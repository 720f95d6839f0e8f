"""Great-circle and planar geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1, lon1, lat2, lon2, radius_km: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance; null when a coordinate is null.

    The null test sits outside ``least`` because ``least`` skips nulls.
    """
    half_lat = (F.radians(lat2) - F.radians(lat1)) / 2
    half_lon = (F.radians(lon2) - F.radians(lon1)) / 2
    chord = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.sin(half_lon) * F.sin(half_lon)
    return F.when(
        chord.isNotNull(), F.lit(2 * radius_km) * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))
    )


def planar_bearing(dlon: Column, dlat: Column) -> Column:
    """Bearing in [0, 360) on the plane, clockwise from north."""
    return (F.degrees(F.atan2(dlon, dlat)) + F.lit(360.0)) % F.lit(360.0)


def box_perimeter_km(
    min_lon, max_lon, min_lat, max_lat, radius_km: float = EARTH_RADIUS_KM
) -> Column:
    """Perimeter of a bounding box: width at its south edge, height at its west edge."""
    width = haversine_km(min_lat, min_lon, min_lat, max_lon, radius_km)
    height = haversine_km(min_lat, min_lon, max_lat, min_lon, radius_km)
    return F.lit(2.0) * (F.coalesce(width, F.lit(0.0)) + F.coalesce(height, F.lit(0.0)))
