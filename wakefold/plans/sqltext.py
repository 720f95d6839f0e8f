"""Shared pieces of oracle SQL."""

from __future__ import annotations

ROUND = 6


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"CASE WHEN {lat1} IS NOT NULL AND {lon1} IS NOT NULL AND {lat2} IS NOT NULL AND {lon2} IS NOT NULL"
        f" THEN 2 * 6371e0 * asin(least(1e0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))) END"
    )


def rounded(columns: dict[str, str], digits: int = ROUND) -> str:
    return ", ".join(f"round({expr}, {digits}) + 0e0 AS {name}" for name, expr in columns.items())


def step_cte(name: str, source: str, keys: str, order: str = "ts, pos_key") -> str:
    """Each point with its predecessor and what the step between them measures."""
    return f"""
      {name}_lag AS (SELECT *, lag(ts) OVER w AS p_ts, lag(lon) OVER w AS p_lon, lag(lat) OVER w AS p_lat,
                     lag(cog) OVER w AS p_cog FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY {order})),
      {name} AS (SELECT *, {km('p_lat', 'p_lon', 'lat', 'lon')} AS step_km, ts - p_ts AS dt,
                 fmod(degrees(atan2(lon - p_lon, lat - p_lat)) + 360e0, 360e0) * (ts - p_ts) AS bear_ms,
                 abs(cog - p_cog) AS turn FROM {name}_lag)"""


STRAIGHT = km(
    "arg_min(lat, (ts, pos_key))", "arg_min(lon, (ts, pos_key))",
    "arg_max(lat, (ts, pos_key))", "arg_max(lon, (ts, pos_key))",
)

FEATURE_SQL = {
    "average_speed": "coalesce(avg(sog), 0)",
    "min_speed": "min(sog)",
    "max_speed": "max(sog)",
    "average_heading": "coalesce(avg(cog), 0)",
    "min_heading": "min(cog)",
    "max_heading": "max(cog)",
    "std_dev_heading": "coalesce(stddev_pop(cog), 0)",
    "std_dev_speed": "coalesce(stddev_pop(sog), 0)",
    "total_area_time": "coalesce(sum(dt), 0)",
    "low_speed_percentage": "100e0 * count(*) FILTER (sog < 2) / count(*)",
    "stagnation_time": "count(*) FILTER (sog < 5e-1) * coalesce(sum(dt), 0) / count(*)",
    "distance_in_kilometers": "coalesce(sum(step_km), 0)",
    "average_time_diff_between_consecutive_points": "coalesce(avg(dt), 0)",
    "displacement_ratio": f"CASE WHEN sum(step_km) > 0 THEN ({STRAIGHT}) / sum(step_km) ELSE 0 END",
    "cog_unit_range": "CASE WHEN coalesce(sum(dt), 0) = 0 THEN 0 ELSE sum(bear_ms) / sum(dt) / 360 END",
    "cog_ratio": "CASE WHEN count(*) = 1 THEN 0 ELSE count(*) FILTER (turn > 10) / (count(*) - 1) END",
}
