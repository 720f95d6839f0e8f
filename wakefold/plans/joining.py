"""Queries on interval joins and interval selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakefold.operators import joins
from wakefold.plans.registry import Topic
from wakefold.plans.tables import Tables, sql_with
from wakefold.schemas import HOUR_MS

topic = Topic()


@topic.query(
    "interval_join",
    sql_with("annotated")
    + """SELECT event_index, Category, id, ts, pos_key, round(lon, 6) AS lon, round(lat, 6) AS lat,
                round(sog, 6) AS sog, round(cog, 6) AS cog FROM annotated""",
)
def interval_join(t: Tables) -> DataFrame:
    return t.annotated.select(
        "event_index", "Category", "id", "ts", "pos_key",
        *[F.round(c, 6).alias(c) for c in ("lon", "lat", "sog", "cog")],
    )


@topic.query(
    "interval_join_bucketed",
    sql_with("annotated")
    + """SELECT event_index, id, ts // 3600000 AS bucket, count(*) AS n_points, min(ts) AS first_ts
         FROM annotated GROUP BY ALL""",
)
def interval_join_bucketed(t: Tables) -> DataFrame:
    """The points of each event counted per hour."""
    joined = joins.interval_join(t.points, t.own_intervals).withColumn("bucket", F.floor(F.col("ts") / HOUR_MS).cast("long"))
    return joined.groupBy("event_index", "id", "bucket").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("ts").alias("first_ts")
    )


@topic.query(
    "pair_interval_join",
    sql_with("event_points")
    + """SELECT event_index, Category, id, ts, pos_key, round(lon, 6) AS lon, round(lat, 6) AS lat,
                round(sog, 6) AS sog, round(cog, 6) AS cog FROM event_points""",
)
def pair_interval_join(t: Tables) -> DataFrame:
    return t.event_points.select(
        "event_index", "Category", "id", "ts", "pos_key",
        *[F.round(c, 6).alias(c) for c in ("lon", "lat", "sog", "cog")],
    )


@topic.query(
    "vessel_semi_filter",
    sql_with("points", "label_events")
    + """SELECT id, ts, pos_key FROM points
         WHERE id IN (SELECT MMSI FROM label_events WHERE Category = 'LOITERING')
           AND ts BETWEEN (SELECT min(from_ms) FROM label_events WHERE Category = 'LOITERING')
                      AND (SELECT max(to_ms) FROM label_events WHERE Category = 'LOITERING')""",
)
def vessel_semi_filter(t: Tables) -> DataFrame:
    loitering = t.own_intervals.where(F.col("Category") == "LOITERING")
    return joins.vessel_semi_filter(t.points, loitering).select("id", "ts", "pos_key")


_COVER = """
  cover_ranked AS (SELECT r.request_id, r.id, r.from_ms, r.to_ms, s.event_index, s.traj_start_ms,
      s.traj_end_ms, s.n_points, row_number() OVER (PARTITION BY r.request_id
        ORDER BY s.traj_end_ms // 1000 - s.traj_start_ms // 1000, s.n_points, s.event_index) AS rn
      FROM requests r JOIN spans s ON s.id = r.id AND s.traj_start_ms <= r.from_ms AND s.traj_end_ms >= r.to_ms),
  covering AS (SELECT * EXCLUDE (rn) FROM cover_ranked WHERE rn = 1),
  inside AS (SELECT r.request_id, r.id, r.from_ms, r.to_ms, s.event_index, s.traj_start_ms,
      s.traj_end_ms, s.n_points FROM requests r JOIN spans s
      ON s.id = r.id AND s.traj_start_ms >= r.from_ms AND s.traj_end_ms <= r.to_ms)"""


@topic.query("covering_trajectory", sql_with("requests", "spans", extra=_COVER) + "SELECT * FROM covering")
def covering_trajectory(t: Tables) -> DataFrame:
    return joins.covering_trajectory(t.spans, t.requests)


@topic.query("within_trajectories", sql_with("requests", "spans", extra=_COVER) + "SELECT * FROM inside")
def within_trajectories(t: Tables) -> DataFrame:
    return joins.within_trajectories(t.spans, t.requests)


@topic.query(
    "cover_else_within",
    sql_with("requests", "spans", extra=_COVER)
    + """SELECT *, true AS is_covering FROM covering UNION ALL
         SELECT *, false AS is_covering FROM inside
         WHERE request_id NOT IN (SELECT request_id FROM covering)""",
)
def cover_else_within(t: Tables) -> DataFrame:
    return joins.cover_else_within(t.spans, t.requests)
