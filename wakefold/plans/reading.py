"""Queries on sources. Files are written first from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakefold.plans.registry import Topic
from wakefold.plans.tables import Tables, sql_with
from wakefold.schemas import AIS_COLUMNS
from wakefold.sources import ranges, readers, writers
from wakefold.sources.shared import new_path

topic = Topic()


@topic.query(
    "labels_read",
    sql_with("labels_raw") + "SELECT FluentName, MMSI, Argument, Value, T_start, T_end FROM labels_raw",
)
def labels_read(t: Tables) -> DataFrame:
    path = new_path(t.spark, "labels")
    writers.write_csv(t.label_rows.drop("label_key"), path, sep="|")
    return readers.read_labels(t.spark, path)


@topic.query(
    "events_read",
    sql_with("label_events")
    + "SELECT FluentName, MMSI, MMSI_2, Value, T_start, T_end, Category, event_index FROM label_events",
)
def events_read(t: Tables) -> DataFrame:
    path = new_path(t.spark, "events")
    written = t.label_events.withColumnRenamed("MMSI_2", "Argument").select(
        "FluentName", "MMSI", "Argument", "Value",
        *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("T_start", "T_end")],
        "Category", "event_index",
    )
    writers.write_csv(written, path)
    events = readers.read_events(t.spark, path)
    return events.withColumns({c: F.unix_seconds(c) for c in ("T_start", "T_end")})


@topic.query(
    "ais_points",
    sql_with("points")
    + """SELECT id, ts, round(lon, 6) AS longitude, round(lat, 6) AS latitude, CAST(NULL AS VARCHAR) AS annotation,
         round(sog, 6) AS speed, round(cog, 6) AS heading, CAST(NULL AS DOUBLE) AS turn, round(cog, 6) AS course
         FROM points""",
)
def ais_points(t: Tables) -> DataFrame:
    path = new_path(t.spark, "positions")
    written = t.ais_points.withColumnRenamed("ts", "timestamp").select(*AIS_COLUMNS)
    writers.write_csv(written, path)
    rounded = ("longitude", "latitude", "speed", "heading", "course")
    return readers.read_positions(t.spark, path).withColumns({c: F.round(c, 6) for c in rounded})


_LINES = T.StructType(
    [
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DoubleType()),
    ]
)


@topic.query(
    "csv_read_rejects",
    """SELECT CASE WHEN l_linestatus = 'F' THEN 'rejected' ELSE 'read' END AS outcome, count(*) AS rows,
       CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM lineitem GROUP BY ALL""",
)
def csv_read_rejects(t: Tables) -> DataFrame:
    """Lines of one status get an unreadable quantity on the way out."""
    path = new_path(t.spark, "lines")
    broken = F.when(F.col("l_linestatus") == "F", "n/a").otherwise(F.col("l_quantity").cast("string"))
    written = t.read("lineitem").select("l_orderkey", "l_linenumber", broken.alias("l_quantity"))
    writers.write_csv(written, path)
    good, bad = readers.read_with_rejects(t.spark, path, _LINES)
    return (
        good.select(F.lit("read").alias("outcome"), "l_orderkey")
        .unionByName(bad.select(F.lit("rejected").alias("outcome"), "l_orderkey"))
        .groupBy("outcome")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").alias("key_sum"))
    )


@topic.query(
    "key_range_scan",
    """WITH edges AS (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem WHERE l_quantity > 25)
       SELECT (l_orderkey - lo) * 8 // (hi - lo + 1) AS range_id, count(*) AS rows, min(l_orderkey) AS first_key,
              max(l_orderkey) AS last_key, round(sum(l_extendedprice), 2) AS price
       FROM lineitem, edges WHERE l_quantity > 25 GROUP BY ALL""",
)
def key_range_scan(t: Tables) -> DataFrame:
    scan = ranges.key_range_scan(
        t.read("lineitem"), ["l_extendedprice"], "l_orderkey", F.col("l_quantity") > 25, 8
    )
    return scan.groupBy("range_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("l_orderkey").alias("first_key"),
        F.max("l_orderkey").alias("last_key"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"),
    )


@topic.query(
    "keyset_page",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
       WHERE o_orderkey > (SELECT max(o_orderkey) // 2 FROM orders) ORDER BY o_orderkey LIMIT 100""",
)
def keyset_page(t: Tables) -> DataFrame:
    orders = t.read("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    middle = orders.agg(F.max("o_orderkey")).first()[0] // 2
    return readers.keyset_page(orders, "o_orderkey", middle, 100)


@topic.query(
    "limit_per_label",
    sql_with("label_events")
    + """SELECT event_index, Category, MMSI FROM label_events
         QUALIFY row_number() OVER (PARTITION BY Category ORDER BY event_index) <= 800""",
)
def limit_per_label(t: Tables) -> DataFrame:
    rows = t.label_events.select("event_index", "Category", "MMSI")
    return readers.limit_per_label(rows, "Category", "event_index", 800)
