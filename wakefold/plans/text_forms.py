"""Queries on text, array, JSON and time forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakefold.functions import textual, timefmt
from wakefold.operators import tracks, upsert
from wakefold.plans.metrics import _PART_SQL, _WKT_SQL, KEYS
from wakefold.plans.registry import Topic
from wakefold.plans.tables import Tables, sql_with
from wakefold.sources import readers

topic = Topic()

# Slow points lose their speed here, so the arrays hold missing cells.
_GAPPY = _PART_SQL + ", gappy AS (SELECT * REPLACE (CASE WHEN sog >= 1 THEN sog END AS sog) FROM placed)"


def _text_rows(t: Tables) -> DataFrame:
    """Trajectories in stored text form."""
    gappy = t.event_points.withColumn("sog", F.when(F.col("sog") >= 1, F.col("sog")))
    built = tracks.trajectory_arrays(gappy, KEYS, t.segment_ms, decimals=6)
    return built.select(
        *KEYS, "part", "trajectory",
        textual.array_text(F.col("timestamp_array")).alias("timestamp_array"),
        textual.array_text(F.col("sog_array"), 6).alias("sog_array"),
        textual.array_text(F.col("cog_array"), 6).alias("cog_array"),
    )


def _sql_text(column: str) -> str:
    return (
        f"'[' || string_agg(coalesce(CAST(CAST(round({column}, 6) AS DECIMAL(18,6)) AS VARCHAR), 'None'), ', '"
        " ORDER BY ts, pos_key) || ']'"
    )


@topic.query(
    "array_stringify",
    sql_with("event_points", extra=_GAPPY)
    + f"""SELECT event_index, id, Category, part, {_sql_text('sog')} AS sog_array, {_sql_text('cog')} AS cog_array,
          '[' || string_agg(strftime(make_timestamp(ts // 1000 * 1000000), '%Y-%m-%d %H:%M:%S'), ', ' ORDER BY ts, pos_key)
          || ']' AS timestamp_array FROM gappy GROUP BY ALL""",
)
def array_stringify(t: Tables) -> DataFrame:
    return _text_rows(t).drop("trajectory")


@topic.query(
    "array_parse",
    sql_with("event_points", extra=_GAPPY)
    + """SELECT event_index, id, Category, part, list(round(sog, 6) ORDER BY ts, pos_key) AS sog_cells,
         count(*) FILTER (sog IS NULL) AS missing FROM gappy GROUP BY ALL""",
)
def array_parse(t: Tables) -> DataFrame:
    cells = F.transform(textual.text_cells(F.col("sog_array")), lambda c: c.try_cast("double"))
    return _text_rows(t).select(
        *KEYS, "part", cells.alias("sog_cells"),
        F.size(F.filter(cells, lambda c: c.isNull())).cast("long").alias("missing"),
    )


@topic.query(
    "trajectory_span",
    sql_with("event_points", extra=_PART_SQL)
    + """SELECT event_index, id, Category, part, min(ts) // 1000 AS traj_start_s, max(ts) // 1000 AS traj_end_s,
         max(ts) // 1000 - min(ts) // 1000 AS duration_s, count(*) AS ts_size FROM placed GROUP BY ALL""",
)
def trajectory_span(t: Tables) -> DataFrame:
    return tracks.trajectory_span(_text_rows(t), [*KEYS, "part"])


@topic.query(
    "trajectory_explode",
    sql_with("event_points", extra=_GAPPY)
    + """SELECT event_index, id, Category,
         row_number() OVER (PARTITION BY event_index, id, Category ORDER BY ts, pos_key) - 1 AS pos,
         ts // 1000 AS ts_s, round(sog, 6) AS sog, round(cog, 6) AS cog, round(lon, 6) AS lon, round(lat, 6) AS lat
         FROM gappy""",
)
def trajectory_explode(t: Tables) -> DataFrame:
    return tracks.explode_arrays(_text_rows(t), [*KEYS, "part"]).drop("part")


@topic.query(
    "wkt_points",
    sql_with("event_points", extra=_PART_SQL)
    + """SELECT event_index, id, Category, part, list(round(lon, 6) ORDER BY ts, pos_key) AS lon_array,
         list(round(lat, 6) ORDER BY ts, pos_key) AS lat_array FROM placed GROUP BY ALL""",
)
def wkt_points(t: Tables) -> DataFrame:
    spots = textual.wkt_points(F.regexp_replace("trajectory", r"(-?[\d.]+ -?[\d.]+)", " POINT( $1 ) "))
    return _text_rows(t).select(
        *KEYS, "part", spots["lon"].alias("lon_array"), spots["lat"].alias("lat_array")
    )


@topic.query(
    "valid_linestring",
    sql_with("event_points")
    + """, sizes AS (SELECT event_index, id, count(*) AS n FROM event_points GROUP BY ALL)
         SELECT count(*) AS processed, count(*) FILTER (n >= 2) AS valid, count(*) FILTER (n < 2) AS rejected FROM sizes""",
)
def valid_linestring(t: Tables) -> DataFrame:
    return upsert.validity_counts(t.stored)


@topic.query(
    "first_scalar",
    "SELECT event_id, event_type AS from_list, event_type AS from_double, event_type AS from_plain, "
    "CAST(user_id AS VARCHAR) AS from_number, CAST(NULL AS VARCHAR) AS from_empty FROM events",
)
def first_scalar(t: Tables) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    pick = textual.first_scalar
    return t.events.select(
        "event_id",
        pick(F.concat(F.lit(" ['"), kind, F.lit("', 'x'] "))).alias("from_list"),
        pick(F.concat(F.lit('["'), kind, F.lit('"]'))).alias("from_double"),
        pick(F.concat(F.lit("'"), kind, F.lit("'"))).alias("from_plain"),
        pick(F.concat(F.lit("["), user, F.lit(", 7]"))).alias("from_number"),
        pick(F.when(kind.isNotNull(), F.lit("[ ]"))).alias("from_empty"),
    )


@topic.query(
    "json_array",
    """SELECT event_id, '[' || props || ']' AS from_object, '["' || event_type || '"]' AS from_word,
       '[' || CAST(user_id AS VARCHAR) || ']' AS from_number, '[' || CAST(user_id AS VARCHAR) || ', 1]' AS from_list,
       '[]' AS from_null FROM events""",
)
def json_array(t: Tables) -> DataFrame:
    user = F.col("user_id").cast("string")
    return t.events.select(
        "event_id",
        textual.json_array(F.col("props")).alias("from_object"),
        textual.json_array(F.col("event_type")).alias("from_word"),
        textual.json_array(user).alias("from_number"),
        textual.json_array(F.concat(F.lit("["), user, F.lit(", 1]"))).alias("from_list"),
        textual.json_array(F.when(F.col("user_id") < 0, user)).alias("from_null"),
    )


_DAY = "(ts // 1000) % 86400"


@topic.query(
    "relative_seconds",
    sql_with("event_points", extra=_PART_SQL)
    + f"""SELECT event_index, id, Category, part,
            list(CASE WHEN s >= base THEN s - base ELSE s + 86400 - base END ORDER BY ts, pos_key) AS seconds
          FROM (SELECT *, {_DAY} AS s, first_value({_DAY}) OVER (PARTITION BY event_index, id, Category, part
                ORDER BY ts, pos_key) AS base FROM placed) GROUP BY ALL""",
)
def relative_seconds(t: Tables) -> DataFrame:
    cells = textual.text_cells(F.col("timestamp_array"))
    return _text_rows(t).select(*KEYS, "part", timefmt.relative_seconds(cells).alias("seconds"))


@topic.query(
    "epoch_normalize",
    """SELECT event_id, epoch_us(ts) // 1000 AS from_timestamp, epoch_us(ts) // 1000000 * 1000 AS from_text,
       epoch_us(ts) // 1000000 * 1000 AS from_iso, epoch_us(ts) // 1000 AS from_digits,
       epoch_us(ts) // 1000 AS from_number, CAST(NULL AS BIGINT) AS from_junk,
       epoch_us(ts) // 1000000 AS seconds FROM events""",
)
def epoch_normalize(t: Tables) -> DataFrame:
    stamp = F.col("ts").cast("timestamp")
    ms = F.floor(F.unix_micros(stamp) / F.lit(1000)).cast("long")
    text = T.StringType()
    return t.events.select(
        "event_id",
        timefmt.epoch_ms(F.col("ts"), T.TimestampNTZType()).alias("from_timestamp"),
        timefmt.epoch_ms(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), text).alias("from_text"),
        timefmt.epoch_ms(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), text).alias("from_iso"),
        timefmt.epoch_ms(ms.cast("string"), text).alias("from_digits"),
        timefmt.epoch_ms(ms, T.LongType()).alias("from_number"),
        timefmt.epoch_ms(F.col("event_type"), text).alias("from_junk"),
        timefmt.epoch_seconds(F.col("ts"), T.TimestampNTZType()).alias("seconds"),
    )


@topic.query(
    "sanitize_columns",
    """SELECT o_orderkey, o_custkey AS col_1, o_orderstatus AS col_2, o_totalprice AS amount,
       o_orderpriority AS amount_4, o_orderkey AS c_4_order_key FROM orders""",
)
def sanitize_columns(t: Tables) -> DataFrame:
    raw = t.read("orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
        F.col("o_orderkey").alias("copy"),
    )
    named = raw.toDF(" o_orderkey ", "", "2", "amount", "amount ", "4/order key")
    return readers.with_safe_names(named, strict=True)


@topic.query(
    "union_by_name",
    """SELECT 'order' AS kind, o_orderkey AS key, o_totalprice AS price, CAST(NULL AS DOUBLE) AS quantity FROM orders
       UNION ALL SELECT 'line', l_orderkey, NULL, l_quantity FROM lineitem""",
)
def union_by_name(t: Tables) -> DataFrame:
    orders = t.read("orders").select(
        F.lit("order").alias("kind"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price")
    )
    lines = t.read("lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_orderkey").alias("key"), F.lit("line").alias("kind")
    )
    return orders.unionByName(lines, allowMissingColumns=True)
