"""Queries on trajectory metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakefold.operators import features, labels, tracks
from wakefold.plans.registry import Topic
from wakefold.plans.sqltext import FEATURE_SQL, km, rounded, step_cte
from wakefold.plans.tables import Tables, sql_with
from wakefold.schemas import FEATURES

topic = Topic()

KEYS = ["event_index", "id", "Category"]
_STEPS = step_cte("steps", "event_points", "event_index, id")

_GROUPS = {
    "trajectory_time": ["total_area_time", "average_time_diff_between_consecutive_points"],
    "trajectory_speed": ["average_speed", "min_speed", "max_speed", "std_dev_speed"],
    "trajectory_heading": ["average_heading", "min_heading", "max_heading", "std_dev_heading"],
    "trajectory_low_speed": ["low_speed_percentage", "stagnation_time"],
    "trajectory_distance": ["distance_in_kilometers"],
    "trajectory_displacement": ["displacement_ratio"],
    "trajectory_cog_unit_range": ["cog_unit_range"],
    "trajectory_cog_ratio": ["cog_ratio"],
    "transshipment_features": FEATURES,
}


def round_features(frame: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    return frame.select(*keep, *[(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names])


def _register_features(name: str, names: list[str]) -> None:
    sql = (
        sql_with("event_points", extra=_STEPS)
        + f"SELECT event_index, id, Category, count(*) AS n_points, {rounded({n: FEATURE_SQL[n] for n in names})}"
        + " FROM steps GROUP BY event_index, id, Category"
    )

    @topic.query(name, sql)
    def build(t: Tables) -> DataFrame:
        table = features.trajectory_features(t.event_points, KEYS, t.segment_ms)
        return round_features(table, [*KEYS, "n_points"], names)


for _name, _columns in _GROUPS.items():
    _register_features(_name, _columns)


_BOUNDS = """
  bounds AS (SELECT event_index, id, min(ts) AS event_time_ms, arg_min(Category, ts) AS Category
             FROM annotated GROUP BY event_index, id),
  open_points AS (SELECT b.event_index, b.Category, p.* FROM points p JOIN bounds b
                  ON p.id = b.id AND p.ts >= b.event_time_ms)"""


def _open_bounds(t: Tables) -> DataFrame:
    return labels.event_bounds(t.annotated).withColumnRenamed("event_time_ms", "from_ms")


@topic.query(
    "non_transshipment_features",
    sql_with("annotated", extra=_BOUNDS + "," + step_cte("steps", "open_points", "event_index, id"))
    + f"SELECT event_index, id, Category, count(*) AS n_points, {rounded(FEATURE_SQL)}"
    + " FROM steps GROUP BY event_index, id, Category",
)
def non_transshipment_features(t: Tables) -> DataFrame:
    table = features.open_ended_features(t.points, _open_bounds(t), t.segment_ms)
    return round_features(table, [*KEYS, "n_points"], FEATURES)


@topic.query(
    "open_ended_join",
    sql_with("annotated", extra=_BOUNDS)
    + """SELECT event_index, id, Category, count(*) AS n_points, min(ts) AS first_ts, max(ts) AS last_ts,
                round(sum(sog), 6) AS sum_sog FROM open_points GROUP BY ALL""",
)
def open_ended_join(t: Tables) -> DataFrame:
    """What the open-ended join yields per event, without making its rows."""
    found = features.suffix_summaries(t.points, _open_bounds(t), t.segment_ms)
    return found.where("n > 0").select(
        *KEYS,
        F.col("n").alias("n_points"),
        F.col("head_ts").alias("first_ts"),
        F.col("tail_ts").alias("last_ts"),
        F.round("sog_sum", 6).alias("sum_sog"),
    )


@topic.query(
    "point_deltas",
    sql_with("event_points", extra=_STEPS)
    + "SELECT event_index, id, pos_key, dt AS time_diff_ms, round(step_km, 6) AS step_km FROM steps",
)
def point_deltas(t: Tables) -> DataFrame:
    steps = tracks.point_deltas(t.event_points, ["event_index", "id"], t.segment_ms)
    return steps.withColumn("step_km", F.round("step_km", 6))


_PART_SQL = f"""
  seg_rows AS (SELECT event_index, id, Category, ts // 3600000 AS seg, count(*) AS rows
               FROM event_points GROUP BY ALL),
  seg_part AS (SELECT *, coalesce(sum(rows) OVER (PARTITION BY event_index, id, Category ORDER BY seg
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {tracks.PART_POINTS} AS part FROM seg_rows),
  placed AS (SELECT e.*, CAST(s.part AS BIGINT) AS part FROM event_points e JOIN seg_part s
             ON e.event_index = s.event_index AND e.id = s.id AND e.Category = s.Category
             AND e.ts // 3600000 = s.seg)"""


@topic.query(
    "trajectory_points",
    sql_with("event_points", extra=_PART_SQL)
    + """SELECT event_index, id, Category, part, CAST(count(*) AS BIGINT) AS n_points,
                list(ts ORDER BY ts, pos_key) AS ts_list, list(pos_key ORDER BY ts, pos_key) AS key_list,
                list(round(sog, 6) ORDER BY ts, pos_key) AS sog_list
         FROM placed GROUP BY ALL""",
)
def trajectory_points(t: Tables) -> DataFrame:
    built = tracks.ordered_points(t.event_points, KEYS, t.segment_ms)
    return built.select(
        *KEYS,
        "part",
        F.size("points").cast("long").alias("n_points"),
        F.col("points.ts").alias("ts_list"),
        F.col("points.pos_key").alias("key_list"),
        F.transform("points", lambda p: F.round(p["sog"], 6)).alias("sog_list"),
    )


_DEC = "CAST(CAST(round({0}, 6) AS DECIMAL(18,6)) AS VARCHAR)"
_WKT_SQL = (
    "'LINESTRING(' || string_agg("
    + _DEC.format("lon")
    + " || ' ' || "
    + _DEC.format("lat")
    + ", ', ' ORDER BY ts, pos_key) || ')'"
)


@topic.query(
    "trajectory_wkt",
    sql_with("event_points", extra=_PART_SQL)
    + f"SELECT event_index, id, Category, part, {_WKT_SQL} AS trajectory FROM placed GROUP BY ALL",
)
def trajectory_wkt(t: Tables) -> DataFrame:
    built = tracks.trajectory_arrays(t.event_points, KEYS, t.segment_ms, decimals=6)
    return built.select(*KEYS, "part", "trajectory")


@topic.query(
    "trajectory_arrays",
    sql_with("event_points", extra=_PART_SQL)
    + """SELECT event_index, id, Category, part,
           list(strftime(make_timestamp(ts // 1000 * 1000000), '%Y-%m-%d %H:%M:%S') ORDER BY ts, pos_key) AS timestamp_array,
           list(round(sog, 6) ORDER BY ts, pos_key) AS sog_array,
           list(round(cog, 6) ORDER BY ts, pos_key) AS cog_array
         FROM placed GROUP BY ALL""",
)
def trajectory_arrays(t: Tables) -> DataFrame:
    built = tracks.trajectory_arrays(t.event_points, KEYS, t.segment_ms)
    return built.select(
        *KEYS,
        "part",
        "timestamp_array",
        F.transform("sog_array", lambda x: F.round(x, 6)).alias("sog_array"),
        F.transform("cog_array", lambda x: F.round(x, 6)).alias("cog_array"),
    )


_BOX = {
    "width_km": km("min(lat)", "min(lon)", "min(lat)", "max(lon)"),
    "height_km": km("min(lat)", "min(lon)", "max(lat)", "min(lon)"),
}


@topic.query(
    "bbox_perimeter",
    sql_with("event_points")
    + f"""SELECT event_index, id, Category, {rounded({'min_lon': 'min(lon)', 'max_lon': 'max(lon)',
          'min_lat': 'min(lat)', 'max_lat': 'max(lat)'})},
          round(2 * ({_BOX['width_km']} + {_BOX['height_km']}), 6) AS perimeter_km
          FROM event_points GROUP BY ALL""",
)
def bbox_perimeter(t: Tables) -> DataFrame:
    from wakefold.functions.geo import box_perimeter_km

    box = t.event_points.groupBy(*KEYS).agg(
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
    )
    perimeter = box_perimeter_km(F.col("min_lon"), F.col("max_lon"), F.col("min_lat"), F.col("max_lat"))
    return box.select(
        *KEYS,
        *[F.round(c, 6).alias(c) for c in ("min_lon", "max_lon", "min_lat", "max_lat")],
        F.round(perimeter, 6).alias("perimeter_km"),
    )
