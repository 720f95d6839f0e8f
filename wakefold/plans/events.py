"""Queries on labels and composite events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakefold.operators import labels
from wakefold.plans.registry import Topic
from wakefold.plans.tables import Tables, sql_with

topic = Topic()


@topic.query(
    "label_filter",
    sql_with("label_events")
    + """SELECT FluentName, MMSI, Argument, Value, T_start, T_end, label_key FROM labels_raw
         WHERE FluentName IN (SELECT FluentName FROM cats)""",
)
def label_filter(t: Tables) -> DataFrame:
    return labels.keep_known_fluents(t.label_rows)


@topic.query(
    "labels_categorized",
    sql_with("label_events")
    + """SELECT event_index, FluentName, Category, MMSI, MMSI_2, Value,
                strftime(make_timestamp(T_start * 1000000), '%Y-%m-%d %H:%M:%S') AS T_start,
                strftime(make_timestamp(T_end * 1000000), '%Y-%m-%d %H:%M:%S') AS T_end
         FROM label_events""",
)
def labels_categorized(t: Tables) -> DataFrame:
    return t.label_events.select(
        "event_index", "FluentName", "Category", "MMSI", "MMSI_2", "Value",
        F.date_format("T_start", "yyyy-MM-dd HH:mm:ss").alias("T_start"),
        F.date_format("T_end", "yyyy-MM-dd HH:mm:ss").alias("T_end"),
    )


@topic.query(
    "event_index",
    sql_with("label_events")
    + """SELECT event_index AS label_key, FluentName, MMSI, Category, T_start,
                row_number() OVER (ORDER BY T_start, MMSI, event_index) AS event_index
         FROM label_events""",
)
def event_index(t: Tables) -> DataFrame:
    events = t.label_events.select(
        F.col("event_index").alias("label_key"), "FluentName", "MMSI", "Category",
        F.unix_seconds("T_start").alias("T_start"),
    )
    return labels.assign_event_index(events, ["T_start", "MMSI", "label_key"])


@topic.query(
    "events_split",
    sql_with("label_events")
    + """SELECT Category, count(*) AS events, min(T_start) AS first_start, max(T_end) AS last_end
         FROM label_events GROUP BY Category""",
)
def events_split(t: Tables) -> DataFrame:
    parts = labels.split_by_category(t.label_events)
    summaries = [
        part.groupBy("Category").agg(
            F.count(F.lit(1)).alias("events"),
            F.unix_seconds(F.min("T_start")).alias("first_start"),
            F.unix_seconds(F.max("T_end")).alias("last_end"),
        )
        for part in parts.values()
    ]
    merged = summaries[0]
    for summary in summaries[1:]:
        merged = merged.unionByName(summary)
    return merged


@topic.query(
    "transship_pairs",
    sql_with("label_events")
    + "SELECT DISTINCT MMSI, MMSI_2 FROM label_events WHERE Category = 'TRANSSHIPMENT'",
)
def transship_pairs(t: Tables) -> DataFrame:
    return labels.vessel_pairs(labels.split_by_category(t.label_events)["TRANSSHIPMENT"])


@topic.query(
    "event_bounds",
    sql_with("annotated")
    + """SELECT event_index, id, min(ts) AS event_time_ms, min(Category) AS Category
         FROM annotated GROUP BY event_index, id""",
)
def event_bounds(t: Tables) -> DataFrame:
    return labels.event_bounds(t.annotated)


@topic.query(
    "latest_events",
    sql_with("label_events")
    + """SELECT event_index, FluentName, MMSI, T_end FROM label_events
         ORDER BY T_end DESC, event_index DESC LIMIT 5""",
)
def latest_events(t: Tables) -> DataFrame:
    return labels.latest_events(t.label_events).select(
        "event_index", "FluentName", "MMSI", F.unix_seconds("T_end").alias("T_end")
    )
