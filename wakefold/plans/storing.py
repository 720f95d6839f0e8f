"""Queries on sinks, hash buckets and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakefold.functions.textual import text_cells
from wakefold.operators import joins, loitering, upsert
from wakefold.plans.metrics import _PART_SQL
from wakefold.plans.registry import Topic
from wakefold.plans.sliding import _REQUEST_SQL, _geometry_sql, request_windows
from wakefold.plans.sqltext import step_cte
from wakefold.plans.tables import Tables, sql_with
from wakefold.sources import snapshots, writers
from wakefold.sources.shared import new_path

topic = Topic()


@topic.query(
    "csv_roundtrip",
    sql_with("event_points", extra=_PART_SQL)
    + """SELECT event_index, id, Category AS behavior_type_label, count(*) AS n_points,
         list(round(cog, 6) ORDER BY ts, pos_key) AS cog_cells FROM placed GROUP BY ALL""",
)
def csv_roundtrip(t: Tables) -> DataFrame:
    path = new_path(t.spark, "trajectory-csv")
    stored = t.stored.select("event_index", "id", "behavior_type_label", "n_points", "cog_array")
    writers.write_csv(stored, path)
    back = t.spark.read.schema(
        "event_index long, id string, behavior_type_label string, n_points long, cog_array string"
    ).option("header", True).csv(path)
    cells = F.transform(text_cells(F.col("cog_array")), lambda c: F.round(c.try_cast("double"), 6))
    return back.select("event_index", "id", "behavior_type_label", "n_points", cells.alias("cog_cells"))


@topic.query(
    "single_csv",
    sql_with("spans")
    + """SELECT Category AS behavior_type_label, count(*) AS trajectories, CAST(sum(n_points) AS BIGINT) AS points,
                min(traj_start_ms) AS first_ms, max(traj_end_ms) AS last_ms, 1::BIGINT AS files FROM spans GROUP BY ALL""",
)
def single_csv(t: Tables) -> DataFrame:
    """The summary of the stored trajectories per label as one CSV file, read back with the number of files."""
    summary = t.spans.groupBy(F.col("Category").alias("behavior_type_label")).agg(
        F.count(F.lit(1)).alias("trajectories"),
        F.sum("n_points").alias("points"),
        F.min("traj_start_ms").alias("first_ms"),
        F.max("traj_end_ms").alias("last_ms"),
    )
    path = new_path(t.spark, "single-csv")
    writers.write_csv(summary, path, single=True)
    back = t.spark.read.schema(summary.schema).option("header", True).csv(path)
    files = back.agg(F.count_distinct("_metadata.file_name")).scalar()
    return back.withColumn("files", files)


_BUCKET = "CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % {n}"


@topic.query(
    "hash_bucket_counts",
    f"""SELECT {_BUCKET.format(n=16)} AS bucket, count(*) AS rows, count(DISTINCT l_orderkey) AS keys
        FROM lineitem GROUP BY ALL""",
)
def hash_bucket_counts(t: Tables) -> DataFrame:
    """Written as one folder per bucket, then counted from the folders."""
    path = new_path(t.spark, "buckets")
    lines = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    writers.write_bucketed(lines, path, "l_orderkey", 16)
    back = t.spark.read.parquet(path)
    return back.groupBy(F.col("bucket").cast("long").alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("l_orderkey").alias("keys")
    )


@topic.query(
    "hash_bucket_sample",
    f"""SELECT {_BUCKET.format(n=400)} AS bucket, l_orderkey, l_linenumber FROM lineitem
        WHERE {_BUCKET.format(n=400)} < 10""",
)
def hash_bucket_sample(t: Tables) -> DataFrame:
    lines = t.read("lineitem").select("l_orderkey", "l_linenumber")
    return writers.bucket_sample(lines, "l_orderkey", 400, 10)


@topic.query(
    "bucket_size_estimate",
    f"""SELECT {_BUCKET.format(n=16)} AS bucket, CAST(round(count(*) / 0.2e0) AS BIGINT) AS estimated_rows FROM lineitem
        WHERE CAST('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber), 1, 8) AS BIGINT) < 0.2e0 * 4294967296
        GROUP BY ALL""",
)
def bucket_size_estimate(t: Tables) -> DataFrame:
    lines = t.read("lineitem").select("l_orderkey", "l_linenumber")
    return writers.bucket_size_estimate(lines, "l_orderkey", 16, 0.2, row_key=["l_orderkey", "l_linenumber"])


@topic.query(
    "upsert_trajectories",
    sql_with("event_points", extra=step_cte("steps", "event_points", "event_index, id"))
    + """, base AS (SELECT id AS mmsi, event_index, Category AS behavior_type_label, avg(sog) AS average_speed,
                   count(*) AS n_points FROM steps GROUP BY ALL),
         target AS (SELECT * FROM base WHERE behavior_type_label <> 'NORMAL' AND n_points >= 2),
         updates AS (SELECT mmsi, event_index, behavior_type_label, average_speed * 2 AS average_speed, n_points
                     FROM base WHERE behavior_type_label <> 'STOPPING' AND n_points >= 2)
         SELECT mmsi, event_index, behavior_type_label, round(average_speed, 6) AS average_speed, n_points FROM updates
         UNION ALL
         SELECT mmsi, event_index, behavior_type_label, round(average_speed, 6), n_points FROM target
         WHERE (mmsi, event_index, behavior_type_label) NOT IN
               (SELECT (mmsi, event_index, behavior_type_label) FROM updates)""",
)
def upsert_trajectories(t: Tables) -> DataFrame:
    """Two revisions of each update arrive; the later one wins."""
    stored = t.stored.select(
        F.col("id").alias("mmsi"), "event_index", "behavior_type_label", "part", "trajectory", "average_speed",
        "n_points",
    )
    target = upsert.valid_trajectories(stored.where(F.col("behavior_type_label") != "NORMAL"))
    changed = stored.where(F.col("behavior_type_label") != "STOPPING")
    updates = changed.withColumn("revision", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "average_speed", F.col("average_speed") * F.col("revision")
    )
    merged = upsert.upsert_trajectories(target, updates, [F.desc("revision")])
    return merged.where("part = 0").select(
        "mmsi", "event_index", "behavior_type_label", F.round("average_speed", 6).alias("average_speed"), "n_points"
    )


_UPSERT_PARTS = sql_with("event_points", extra=step_cte("steps", "event_points", "event_index, id")) + """, base AS (
         SELECT id AS mmsi, event_index, Category AS behavior_type_label, avg(sog) AS average_speed,
                count(*) AS n_points FROM steps GROUP BY ALL)"""
SNAPSHOT_BUCKETS = 32


def _snapshot(t: Tables) -> tuple[DataFrame, dict[str, int]]:
    """A snapshot without normal trajectories after an upsert of all but the stopping ones, each in two revisions."""
    stored = t.stored.select(
        F.col("id").alias("mmsi"), "event_index", "behavior_type_label", "part", "trajectory", "average_speed",
        "n_points",
    )
    keys, path = upsert.TRAJECTORY_KEYS, new_path(t.spark, "snapshot")
    target = upsert.valid_trajectories(stored.where(F.col("behavior_type_label") != "NORMAL"))
    snapshots.create(target, path, keys, SNAPSHOT_BUCKETS)
    changed = stored.where(F.col("behavior_type_label") != "STOPPING")
    updates = changed.withColumn("revision", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "average_speed", F.col("average_speed") * F.col("revision")
    )
    reason = upsert.reject_reason(updates.columns)
    counts = snapshots.apply(t.spark, path, keys, updates, reason, [F.desc("revision")], SNAPSHOT_BUCKETS)
    return snapshots.read(t.spark, path), counts


@topic.query(
    "snapshot_upsert",
    _UPSERT_PARTS
    + """SELECT mmsi, event_index, behavior_type_label, n_points,
                round(CASE WHEN behavior_type_label = 'STOPPING' THEN average_speed ELSE average_speed * 2 END, 6) AS average_speed
         FROM base WHERE n_points >= 2""",
)
def snapshot_upsert(t: Tables) -> DataFrame:
    rows, _ = _snapshot(t)
    return rows.where("part = 0").select(*upsert.TRAJECTORY_KEYS, "n_points", F.round("average_speed", 6).alias("average_speed"))


@topic.query(
    "snapshot_upsert_counts",
    _UPSERT_PARTS
    + """SELECT unnest(['processed', 'upserted', 'rejected']) AS what,
                unnest([2 * count(*), count(*) FILTER (n_points >= 2), 2 * count(*) FILTER (n_points < 2)]) AS trajectories
         FROM base WHERE behavior_type_label <> 'STOPPING'""",
)
def snapshot_upsert_counts(t: Tables) -> DataFrame:
    """Updates seen and rejected, and trajectories stored, as counted by the upsert itself."""
    _, counts = _snapshot(t)
    return t.spark.createDataFrame(list(counts.items()), "what string, trajectories long")


_KEY_SQL = (
    _REQUEST_SQL + "," + _geometry_sql("request_id, id") + """,
  blocks AS (SELECT request_id, s.id AS mmsi, window_index, min(s.event_index) AS event_index,
      min(s.event_index) AS aggregated_ais_data_id, min(p.Category) AS behavior_type_label,
      '[' || string_agg(strftime(make_timestamp(ts_s * 1000000), '%Y-%m-%d %H:%M:%S'), ', '
             ORDER BY ts_s, s.event_index, pos) || ']' AS timestamp_array, count(*) AS n_points
      FROM steps s JOIN parents p ON p.event_index = s.event_index AND p.id = s.id
      GROUP BY request_id, s.id, window_index HAVING count(*) >= 2),
  preds AS (SELECT b.*, g.wn AS trajectory_redundancy FROM blocks b JOIN scored g
      ON g.request_id = b.request_id AND g.id = b.mmsi AND g.window_index = b.window_index),
  latest AS (SELECT * FROM preds QUALIFY row_number() OVER (PARTITION BY mmsi, event_index, behavior_type_label,
      timestamp_array ORDER BY request_id DESC, window_index) = 1)"""
)


def _predictions(t: Tables) -> DataFrame:
    scored = loitering.loitering_wn(request_windows(t)).withColumnRenamed("id", "mmsi")
    return upsert.as_predictions(scored).select(
        *upsert.PREDICTION_KEYS, "aggregated_ais_data_id", "trajectory_redundancy",
        "behavior_type_by_loitering_equation", "request_id", "window_index",
    )


@topic.query(
    "upsert_predictions",
    sql_with("requests", "spans", extra=_KEY_SQL)
    + """SELECT mmsi, event_index, behavior_type_label, timestamp_array, aggregated_ais_data_id,
                round(trajectory_redundancy, 6) AS trajectory_redundancy,
                CASE WHEN trajectory_redundancy > 1 THEN 'LOITERING' ELSE 'NON-LOITERING' END
                  AS behavior_type_by_loitering_equation FROM latest""",
)
def upsert_predictions(t: Tables) -> DataFrame:
    """Windows of all requests merged into a table that already holds older scores of some."""
    fresh = _predictions(t)
    older = fresh.where(F.col("behavior_type_label") == "LOITERING").withColumn(
        "trajectory_redundancy", F.lit(-1.0)
    )
    target = upsert.upsert_predictions(
        older.limit(0), older, [F.desc("request_id"), F.col("window_index")]
    )
    merged = upsert.upsert_predictions(target, fresh, [F.desc("request_id"), F.col("window_index")])
    return merged.drop("request_id", "window_index").withColumn(
        "trajectory_redundancy", F.round("trajectory_redundancy", 6)
    )


@topic.query(
    "loitering_requests_stored",
    sql_with("requests", "spans", extra=_KEY_SQL)
    + """SELECT mmsi, event_index, behavior_type_label, timestamp_array, aggregated_ais_data_id,
                round(trajectory_redundancy, 6) AS trajectory_redundancy,
                CASE WHEN trajectory_redundancy > 1 THEN 'LOITERING' ELSE 'NON-LOITERING' END
                  AS behavior_type_by_loitering_equation FROM latest""",
)
def loitering_requests_stored(t: Tables) -> DataFrame:
    """The whole chain of a request: selection, windows, score, upsert into the stored predictions, and those read back."""
    fresh, keys, path = _predictions(t), upsert.PREDICTION_KEYS, new_path(t.spark, "predictions")
    snapshots.create(fresh.limit(0), path, keys, SNAPSHOT_BUCKETS)
    order = [F.desc("request_id"), F.col("window_index")]
    snapshots.apply(t.spark, path, keys, fresh, F.lit(None).cast("string"), order, SNAPSHOT_BUCKETS, fresh.schema)
    stored = snapshots.read(t.spark, path, fresh.schema)
    return stored.drop("request_id", "window_index").withColumn(
        "trajectory_redundancy", F.round("trajectory_redundancy", 6)
    )


@topic.query(
    "prediction_parent_join",
    sql_with("requests", "spans", extra=_KEY_SQL)
    + """SELECT l.mmsi, l.aggregated_ais_data_id, l.timestamp_array, round(l.trajectory_redundancy, 6) AS trajectory_redundancy,
                s.n_points AS parent_points, s.Category AS parent_label
         FROM latest l JOIN spans s ON s.event_index = l.aggregated_ais_data_id AND s.id = l.mmsi""",
)
def prediction_parent_join(t: Tables) -> DataFrame:
    fresh = _predictions(t)
    predictions = upsert.upsert_predictions(
        fresh.limit(0), fresh, [F.desc("request_id"), F.col("window_index")]
    )
    parents = t.stored.where("part = 0").select(
        F.col("event_index").alias("primary_key"), F.col("id").alias("mmsi"),
        F.col("n_points").alias("parent_points"), F.col("behavior_type_label").alias("parent_label"),
    )
    joined = joins.prediction_parent_join(predictions, parents, ["mmsi"])
    return joined.select(
        "mmsi", "aggregated_ais_data_id", "timestamp_array",
        F.round("trajectory_redundancy", 6).alias("trajectory_redundancy"), "parent_points", "parent_label",
    )

