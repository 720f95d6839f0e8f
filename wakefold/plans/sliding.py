"""Queries on sliding windows and loitering equations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakefold.functions.timefmt import canonical_epoch_seconds
from wakefold.operators import cells, joins, loitering, tracks, windows
from wakefold.plans.registry import Topic
from wakefold.plans.sqltext import km, step_cte
from wakefold.plans.tables import Tables, sql_with

topic = Topic()

START = "2024-01-01 00:00:00"
START_S = canonical_epoch_seconds(START)
SIZE_S = 48 * 3600
STEP_S = 24 * 3600


def vessel_points(t: Tables) -> DataFrame:
    """All vessels as one long track each, in whole seconds."""
    return t.points.select(
        "id",
        F.floor(F.col("ts") / F.lit(1000)).cast("long").alias("ts_s"),
        "lon", "lat", "sog", "cog",
        F.lit(0).cast("long").alias("event_index"),
        F.col("pos_key").alias("pos"),
    )


def _windowed(t: Tables, max_points: int | None = None) -> DataFrame:
    start = F.lit(START_S).cast("long")
    return windows.window_points(vessel_points(t), ["id"], start, SIZE_S, STEP_S, max_points)


def _assign_sql(limit: int | None = None) -> str:
    kept = f"WHERE rn <= {limit}" if limit else ""
    return f"""
      secs AS (SELECT id, ts // 1000 AS ts_s, lon, lat, sog, cog, pos_key FROM points),
      assigned AS (SELECT s.*, CAST(k.k AS BIGINT) AS window_index FROM secs s,
                   LATERAL (SELECT unnest(range(greatest(0, CAST(ceil((ts_s - {START_S} - {SIZE_S}) / {STEP_S}) AS BIGINT)),
                            CAST(floor((ts_s - {START_S}) / {STEP_S}) AS BIGINT) + 1)) AS k) k),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY id, window_index ORDER BY ts_s, pos_key) AS rn FROM assigned),
      win AS (SELECT *, ts_s AS ts FROM ranked {kept})"""


@topic.query(
    "window_assign",
    sql_with("points", extra=_assign_sql())
    + f"""SELECT id, pos_key, ts_s, window_index, {START_S} + window_index * {STEP_S} AS window_start_s,
                 {START_S} + window_index * {STEP_S} + {SIZE_S} AS window_end_s FROM assigned""",
)
def window_assign(t: Tables) -> DataFrame:
    placed = windows.assign_windows(vessel_points(t), F.lit(START_S).cast("long"), SIZE_S, STEP_S)
    return placed.select(
        "id", F.col("pos").alias("pos_key"), "ts_s", "window_index", "window_start_s", "window_end_s"
    )


@topic.query(
    "window_topn",
    sql_with("points", extra=_assign_sql(3)) + "SELECT id, window_index, pos_key, ts_s, rn AS rank FROM win",
)
def window_topn(t: Tables) -> DataFrame:
    kept = _windowed(t, 3)
    return kept.select(
        "id", "window_index", F.col("pos").alias("pos_key"), "ts_s", F.col("rank").cast("long").alias("rank")
    )


_PERIMETER = (
    f"2 * ({km('min(lat)', 'min(lon)', 'min(lat)', 'max(lon)')}"
    f" + {km('min(lat)', 'min(lon)', 'max(lat)', 'min(lon)')})"
)


def _geometry_sql(keys: str) -> str:
    return f"""
      geo AS (SELECT {keys}, window_index, count(*) AS n_points, coalesce(sum(step_km), 0) AS path_km,
                     sum(sog) AS sum_sog, coalesce(sum(turn), 0) AS sum_cog_delta, {_PERIMETER} AS perimeter
              FROM steps GROUP BY {keys}, window_index),
      scored AS (SELECT *, CASE WHEN perimeter > 0 THEN path_km / perimeter ELSE 0 END AS zhang,
                 CASE WHEN perimeter > 0 AND sum_sog > 0 THEN path_km * sum_cog_delta / (perimeter * sum_sog) ELSE 0 END AS wn
                 FROM geo)"""


_ALL_SQL = (
    _assign_sql()
    + ","
    + step_cte("steps", "win", "id, window_index", "ts_s, pos_key")
    + ","
    + _geometry_sql("id")
)


@topic.query(
    "loitering_sliding",
    sql_with("points", extra=_ALL_SQL)
    + """SELECT id, window_index, n_points, round(path_km, 6) AS path_km, round(sum_sog, 6) AS sum_sog,
                round(sum_cog_delta, 6) AS sum_cog_delta, round(wn, 6) AS trajectory_redundancy,
                CASE WHEN wn > 1 THEN 'LOITERING' ELSE 'NON-LOITERING' END AS behavior_type_by_loitering_equation
         FROM scored""",
)
def loitering_sliding(t: Tables) -> DataFrame:
    """Flagship: windows of every vessel, scored by the speed-and-turn equation."""
    start = F.lit(START_S).cast("long")
    geometry = cells.window_geometry(vessel_points(t), ["id"], start, SIZE_S, STEP_S, t.part_s)
    scored = loitering.classify_geometry(geometry, "wn", threshold=1.0)
    return scored.select(
        "id", "window_index", "n_points",
        *[F.round(c, 6).alias(c) for c in ("path_km", "sum_sog", "sum_cog_delta", "trajectory_redundancy")],
        "behavior_type_by_loitering_equation",
    )


def request_points(t: Tables) -> DataFrame:
    """Requests, the trajectories chosen for them, and those trajectories' points."""
    stored = t.stored.withColumn("primary_key", F.col("event_index"))
    spans = stored.groupBy("event_index", "id").agg(
        F.min("traj_start_ms").alias("traj_start_ms"),
        F.max("traj_end_ms").alias("traj_end_ms"),
        F.max("n_points").alias("n_points"),
    )
    chosen = joins.cover_else_within(spans, t.requests).select(
        "request_id", "id", "event_index",
        F.expr("from_ms div 1000").alias("start_s"),
        F.expr("to_ms div 1000").alias("end_s"),
    )
    parents = [
        "event_index", "id", "behavior_type_label", "primary_key", "part", "total_area_time",
        "stagnation_time", "low_speed_percentage", "average_time_diff_between_consecutive_points",
    ]
    # Only the chosen trajectories are taken apart, and they are shuffled as arrays.
    asked = stored.join(chosen, ["event_index", "id"])
    return tracks.explode_arrays(asked, [*parents, "request_id", "start_s", "end_s"])


REQUEST_SIZE_S = 12 * 3600
REQUEST_STEP_S = 6 * 3600

_PICK = """
  pick_cover AS (SELECT r.request_id, r.id, r.from_ms // 1000 AS start_s, r.to_ms // 1000 AS end_s, s.event_index,
      row_number() OVER (PARTITION BY r.request_id
        ORDER BY s.traj_end_ms // 1000 - s.traj_start_ms // 1000, s.n_points, s.event_index) AS rn
      FROM requests r JOIN spans s ON s.id = r.id AND s.traj_start_ms <= r.from_ms AND s.traj_end_ms >= r.to_ms),
  chosen AS (SELECT request_id, id, start_s, end_s, event_index FROM pick_cover WHERE rn = 1
      UNION ALL
      SELECT r.request_id, r.id, r.from_ms // 1000, r.to_ms // 1000, s.event_index FROM requests r JOIN spans s
      ON s.id = r.id AND s.traj_start_ms >= r.from_ms AND s.traj_end_ms <= r.to_ms
      WHERE r.request_id NOT IN (SELECT request_id FROM pick_cover))"""

_PARENTS = step_cte("psteps", "event_points", "event_index, id") + """,
  parents AS (SELECT event_index, id, Category, coalesce(sum(dt), 0) AS total_area_time,
      count(*) FILTER (sog < 5e-1) * coalesce(sum(dt), 0) / count(*) AS stagnation_time,
      100e0 * count(*) FILTER (sog < 2) / count(*) AS low_speed_percentage,
      coalesce(avg(dt), 0) AS avg_diff FROM psteps GROUP BY ALL)"""

_REQUEST_WIN = f"""
  asked AS (SELECT c.request_id, c.id, c.start_s, c.event_index, p.ts // 1000 AS ts_s, p.lon, p.lat, p.sog, p.cog,
      row_number() OVER (PARTITION BY c.request_id, c.event_index, c.id ORDER BY p.ts, p.pos_key) - 1 AS pos,
      c.end_s FROM chosen c JOIN event_points p ON p.event_index = c.event_index AND p.id = c.id),
  req_assigned AS (SELECT a.*, CAST(k.k AS BIGINT) AS window_index
      FROM (SELECT * FROM asked WHERE ts_s BETWEEN start_s AND end_s) a,
      LATERAL (SELECT unnest(range(
        greatest(0, CAST(ceil((ts_s - start_s - {REQUEST_SIZE_S}) / {REQUEST_STEP_S}) AS BIGINT)),
        CAST(floor((ts_s - start_s) / {REQUEST_STEP_S}) AS BIGINT) + 1)) AS k) k),
  req_ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id, id, window_index
      ORDER BY ts_s, event_index, pos) AS rn FROM req_assigned),
  req_win AS (SELECT *, ts_s * 1000 AS ts, pos AS pos_key FROM req_ranked)"""

_REQUEST_SQL = (
    _PICK + "," + _PARENTS + "," + _REQUEST_WIN + ","
    + step_cte("steps", "req_win", "request_id, id, window_index", "ts_s, event_index, pos")
)
_REQ_STRAIGHT = km(
    "arg_min(lat, (ts_s, s.event_index, pos))", "arg_min(lon, (ts_s, s.event_index, pos))",
    "arg_max(lat, (ts_s, s.event_index, pos))", "arg_max(lon, (ts_s, s.event_index, pos))",
)
_BLOCK_COLUMNS = {
    "average_speed": "avg(sog)",
    "min_speed": "min(sog)",
    "max_speed": "max(sog)",
    "std_dev_speed": "stddev_samp(sog)",
    "average_heading": "avg(cog)",
    "min_heading": "min(cog)",
    "max_heading": "max(cog)",
    "std_dev_heading": "stddev_samp(cog)",
    "average_time_diff_between_consecutive_points": "avg(p.avg_diff)",
    "total_area_time": "sum(p.total_area_time)",
    "low_speed_percentage": "avg(p.low_speed_percentage)",
    "stagnation_time": "sum(p.stagnation_time)",
    "distance_in_kilometers": "coalesce(sum(step_km), 0)",
    "displacement_ratio": f"CASE WHEN sum(step_km) > 0 THEN ({_REQ_STRAIGHT}) / sum(step_km) ELSE 0 END",
    "cog_unit_range": "CASE WHEN coalesce(sum(dt), 0) = 0 THEN 0 ELSE sum(bear_ms) / sum(dt) / 360 END",
    "cog_ratio": "CASE WHEN count(*) = 1 THEN 0 ELSE count(*) FILTER (turn > 10) / (count(*) - 1) END",
    "total_area_time_in_window": "coalesce(sum(dt), 0)",
    "average_time_diff_between_consecutive_points_in_window": "coalesce(avg(dt), 0)",
    "low_speed_percentage_in_window": "100e0 * count(*) FILTER (sog < 2) / count(*)",
    "stagnation_time_in_window": "count(*) FILTER (sog < 5e-1) * coalesce(sum(dt), 0) / count(*)",
}


def request_windows(t: Tables) -> DataFrame:
    return windows.sliding_windows(request_points(t), ["request_id", "id"], REQUEST_SIZE_S, REQUEST_STEP_S)


def _block_sql(columns: dict[str, str]) -> str:
    rounded = ", ".join(f"round({e}, 4) + 0e0 AS {n}" for n, e in columns.items())
    return (
        sql_with("requests", "spans", extra=_REQUEST_SQL)
        + f"""SELECT request_id, s.id, window_index, count(*) AS n_points, {rounded}
              FROM steps s JOIN parents p ON p.event_index = s.event_index AND p.id = s.id
              GROUP BY request_id, s.id, window_index"""
    )


@topic.query("window_features", _block_sql(_BLOCK_COLUMNS))
def window_features(t: Tables) -> DataFrame:
    inside = windows.inside_interval(request_points(t), F.col("start_s"), F.col("end_s"))
    blocks = cells.window_scalars(
        inside, ["request_id", "id"], F.col("start_s"), REQUEST_SIZE_S, REQUEST_STEP_S, t.part_s
    )
    return blocks.select(
        "request_id", "id", "window_index", "n_points",
        *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in _BLOCK_COLUMNS],
    )


@topic.query(
    "sliding_windows",
    sql_with("requests", "spans", extra=_REQUEST_SQL)
    + f"""SELECT request_id, s.id, window_index, count(*) AS n_points,
            list(strftime(make_timestamp(ts_s * 1000000), '%Y-%m-%d %H:%M:%S') ORDER BY ts_s, s.event_index, pos) AS timestamp_array,
            list(round(sog, 6) ORDER BY ts_s, s.event_index, pos) AS sog_array,
            list(round(cog, 6) ORDER BY ts_s, s.event_index, pos) AS cog_array,
            list_sort(list(DISTINCT s.event_index)) AS event_index,
            list_sort(list(DISTINCT s.event_index)) AS primary_key_from_aggregated_ais_data,
            list_sort(list(DISTINCT p.Category)) AS behavior_type_label,
            strftime(make_timestamp((any_value(start_s) + window_index * {REQUEST_STEP_S}) * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start_ts,
            strftime(make_timestamp((any_value(start_s) + window_index * {REQUEST_STEP_S} + {REQUEST_SIZE_S}) * 1000000), '%Y-%m-%d %H:%M:%S') AS window_end_ts
          FROM steps s JOIN parents p ON p.event_index = s.event_index AND p.id = s.id
          GROUP BY request_id, s.id, window_index""",
)
def sliding_windows(t: Tables) -> DataFrame:
    blocks = request_windows(t)
    return blocks.select(
        "request_id", "id", "window_index", "n_points", "timestamp_array",
        F.transform("sog_array", lambda x: F.round(x, 6)).alias("sog_array"),
        F.transform("cog_array", lambda x: F.round(x, 6)).alias("cog_array"),
        "event_index", "primary_key_from_aggregated_ais_data", "behavior_type_label",
        F.date_format("window_start_ts", "yyyy-MM-dd HH:mm:ss").alias("window_start_ts"),
        F.date_format("window_end_ts", "yyyy-MM-dd HH:mm:ss").alias("window_end_ts"),
    )


_SCORED_REQUESTS = _REQUEST_SQL + "," + _geometry_sql("request_id, id")


def _scored(name: str, column: str, threshold: int):
    return (
        sql_with("requests", "spans", extra=_SCORED_REQUESTS)
        + f"""SELECT request_id, id, window_index, n_points, round({column}, 6) AS trajectory_redundancy,
              CASE WHEN {column} > {threshold} THEN 'LOITERING' ELSE 'NON-LOITERING' END
                AS behavior_type_by_loitering_equation FROM scored"""
    )


_SCORE_COLUMNS = ["request_id", "id", "window_index", "n_points"]


def _score_view(frame: DataFrame) -> DataFrame:
    return frame.select(
        *_SCORE_COLUMNS,
        F.round("trajectory_redundancy", 6).alias("trajectory_redundancy"),
        "behavior_type_by_loitering_equation",
    )


@topic.query("loitering_zhang", _scored("zhang", "zhang", 1))
def loitering_zhang(t: Tables) -> DataFrame:
    return _score_view(loitering.loitering_zhang(request_windows(t)))


@topic.query("loitering_wn", _scored("wn", "wn", 1))
def loitering_wn(t: Tables) -> DataFrame:
    return _score_view(loitering.loitering_wn(request_windows(t)))


@topic.query(
    "first_window",
    sql_with("requests", "spans", extra=_REQUEST_SQL)
    + """SELECT request_id, id, window_index, n_points FROM (
           SELECT request_id, id, window_index, count(*) AS n_points FROM steps GROUP BY ALL)
         QUALIFY row_number() OVER (PARTITION BY request_id, id ORDER BY window_index) = 1""",
)
def first_window(t: Tables) -> DataFrame:
    return windows.first_window(request_windows(t), ["request_id", "id"]).select(
        "request_id", "id", "window_index", "n_points"
    )


@topic.query(
    "interval_points",
    sql_with("requests", "spans", extra=_PICK + "," + _REQUEST_WIN)
    + """SELECT request_id, id, event_index, pos, ts_s, round(sog, 6) AS sog FROM asked
         WHERE ts_s BETWEEN start_s AND end_s""",
)
def interval_points(t: Tables) -> DataFrame:
    inside = windows.inside_interval(request_points(t), F.col("start_s"), F.col("end_s"))
    return inside.select("request_id", "id", "event_index", "pos", "ts_s", F.round("sog", 6).alias("sog"))
