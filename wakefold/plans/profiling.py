"""Queries on profiles, class balance, histograms and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakefold.operators import profiling
from wakefold.plans.registry import Topic
from wakefold.plans.sampling import MODEL_SQL, labelled_features
from wakefold.plans.tables import Tables, sql_with
from wakefold.schemas import FEATURES, LABELS
from wakefold.sources import writers
from wakefold.sources.shared import new_path

topic = Topic()

_LABEL_COLUMNS = ["FluentName", "MMSI", "Argument", "Value", "T_start", "T_end"]


def _union(template: str, names: list[str]) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in names)


@topic.query(
    "profile_nulls",
    sql_with("labels_raw")
    + _union(
        "SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count(*) - count({c}) AS nulls_or_nans FROM labels_raw",
        _LABEL_COLUMNS,
    )
    + " UNION ALL "
    + _union(
        "SELECT '{c}', count(*) - count({c}), count(*) FILTER ({c} IS NULL OR isnan({c})) FROM "
        "(SELECT CASE WHEN value > 100 THEN 'nan'::DOUBLE WHEN value > 50 THEN NULL ELSE value END AS value FROM events)",
        ["value"],
    ),
)
def profile_nulls(t: Tables) -> DataFrame:
    labels = profiling.profile_nulls(t.label_rows.select(*_LABEL_COLUMNS))
    gaps = F.when(F.col("value") > 100, F.lit(float("nan"))).when(F.col("value") > 50, None).otherwise(F.col("value"))
    return labels.unionByName(profiling.profile_nulls(t.events.select(gaps.alias("value"))))


@topic.query(
    "profile_distinct",
    sql_with("labels_raw")
    + _union(
        "SELECT '{c}' AS \"column\", count(DISTINCT {c}) + CAST(count(*) > count({c}) AS BIGINT) AS distinct_values FROM labels_raw",
        _LABEL_COLUMNS,
    ),
)
def profile_distinct(t: Tables) -> DataFrame:
    return profiling.profile_distinct(t.label_rows.select(*_LABEL_COLUMNS))


_SUMMARY = ["value", "user_id"]


@topic.query(
    "profile_summary",
    _union(
        """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
           CAST(min({c}) AS DOUBLE) AS min, CAST(quantile_disc({c}, 0.25) AS DOUBLE) AS p25,
           CAST(quantile_disc({c}, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc({c}, 0.75) AS DOUBLE) AS p75,
           CAST(max({c}) AS DOUBLE) AS max FROM events""",
        _SUMMARY,
    ),
)
def profile_summary(t: Tables) -> DataFrame:
    summary = profiling.profile_summary(t.events.select(*_SUMMARY))
    return summary.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


_COLUMN_TYPES = {
    "FluentName": "string", "MMSI": "string", "Argument": "string", "Value": "string", "T_start": "bigint", "T_end": "bigint",
}


@topic.query(
    "profile_columns",
    sql_with("labels_raw")
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {at}::BIGINT AS position, '{kind}' AS type, count(*) AS rows, count({c}) AS count,
            CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM labels_raw"""
        for at, (c, kind) in enumerate(_COLUMN_TYPES.items())
    ),
)
def profile_columns(t: Tables) -> DataFrame:
    return profiling.profile_columns(t.label_rows.select(*_COLUMN_TYPES))


@topic.query(
    "label_counts",
    sql_with("label_events")
    + """SELECT l.behavior_type_label, count(e.event_index) AS rows
         FROM (VALUES ('LOITERING'), ('NORMAL'), ('STOPPING'), ('TRANSSHIPMENT'), ('DRIFTING')) l(behavior_type_label)
         LEFT JOIN label_events e ON e.Category = l.behavior_type_label GROUP BY ALL""",
)
def label_counts(t: Tables) -> DataFrame:
    events = t.label_events.select(F.col("Category").alias("behavior_type_label"))
    return profiling.label_counts(events, "behavior_type_label", [*LABELS, "DRIFTING"])


@topic.query(
    "class_distribution",
    MODEL_SQL
    + """SELECT behavior_type_label, count(*) FILTER (split = 'train') AS train_rows,
         count(*) FILTER (split = 'test') AS test_rows,
         round(count(*) FILTER (split = 'train') / sum(count(*) FILTER (split = 'train')) OVER (), 6) AS train_share,
         round(count(*) FILTER (split = 'test') / sum(count(*) FILTER (split = 'test')) OVER (), 6) AS test_share
         FROM model GROUP BY behavior_type_label""",
)
def class_distribution(t: Tables) -> DataFrame:
    found = profiling.class_distribution(labelled_features(t), "behavior_type_label")
    return found.withColumns({c: F.round(c, 6) for c in ("train_share", "test_share")})


_STATS = ", ".join(
    f"count({{c}}) FILTER (split = '{p}') AS {p}_count, round(avg({{c}}) FILTER (split = '{p}'), 4) AS {p}_mean, "
    f"round(stddev_samp({{c}}) FILTER (split = '{p}'), 4) AS {p}_std, "
    f"round(min({{c}}) FILTER (split = '{p}'), 4) + 0e0 AS {p}_min, round(max({{c}}) FILTER (split = '{p}'), 4) + 0e0 AS {p}_max"
    for p in ("train", "test")
)


@topic.query(
    "feature_stats", MODEL_SQL + _union("SELECT '{c}' AS feature, " + _STATS + " FROM model", FEATURES)
)
def feature_stats(t: Tables) -> DataFrame:
    found = profiling.feature_stats(labelled_features(t), FEATURES)
    return found.select(
        "feature",
        *[F.col(c) if c.endswith("count") else (F.round(c, 4) + F.lit(0.0)).alias(c) for c in found.columns[1:]],
    )


@topic.query(
    "stats_json", MODEL_SQL + _union("SELECT '{c}' AS feature, " + _STATS + " FROM model", FEATURES)
)
def stats_json(t: Tables) -> DataFrame:
    """Feature statistics as the JSON file that goes with a model, read back."""
    found, path = feature_stats(t), new_path(t.spark, "stats")
    writers.write_json(found, path)
    return t.spark.read.schema(found.schema).json(path)


@topic.query(
    "zero_variance",
    MODEL_SQL
    + _union(
        "SELECT '{c}' AS feature, round(stddev_samp({c}), 4) AS std, coalesce(stddev_samp({c}) = 0, true) AS is_constant FROM model",
        [*FEATURES, "one"],
    ),
)
def zero_variance(t: Tables) -> DataFrame:
    table = labelled_features(t).withColumn("one", F.lit(1.0))
    return profiling.zero_variance(table, [*FEATURES, "one"]).withColumn("std", F.round("std", 4))


_BINS = 10
_HIST_FEATURES = ["min_speed", "cog_ratio", "max_heading"]


def _hist_sql(c: str, bins: int = _BINS, table: str = "model") -> str:
    return f"""
      SELECT '{c}' AS feature, b.bin - 1 AS bin, round(b.l, 6) AS left_edge, round(b.r, 6) AS right_edge,
             (SELECT count(*) FROM {table} WHERE split = 'train' AND {c} >= b.l AND ({c} < b.r OR (b.bin = b.n AND {c} <= b.r))) AS train_rows,
             (SELECT count(*) FROM {table} WHERE split = 'test' AND {c} >= b.l AND ({c} < b.r OR (b.bin = b.n AND {c} <= b.r))) AS test_rows
      FROM (SELECT row_number() OVER (ORDER BY e) AS bin, e AS l, lead(e) OVER (ORDER BY e) AS r,
                   count(*) OVER () - 1 AS n
            FROM (SELECT DISTINCT unnest(quantile_disc({c}, [{', '.join(str(i / bins) for i in range(bins + 1))}])) AS e
                  FROM {table} WHERE split = 'train')) b WHERE b.r IS NOT NULL"""


@topic.query(
    "quantile_histogram", MODEL_SQL + " UNION ALL ".join(_hist_sql(c) for c in _HIST_FEATURES)
)
def quantile_histogram(t: Tables) -> DataFrame:
    bins = profiling.quantile_histogram(labelled_features(t), _HIST_FEATURES, _BINS)
    return bins.withColumns({c: F.round(c, 6) for c in ("left_edge", "right_edge")})


_ALL_BINS = 30


# Nine decimals, so that equal values stay equal whatever the order of their sums.
_ROUNDED_SQL = f", rounded AS (SELECT split, {', '.join(f'round({c}, 9) + 0e0 AS {c}' for c in FEATURES)} FROM model) "


@topic.query(
    "quantile_histogram_all",
    MODEL_SQL.rstrip() + _ROUNDED_SQL + " UNION ALL ".join(_hist_sql(c, _ALL_BINS, "rounded") for c in FEATURES),
)
def quantile_histogram_all(t: Tables) -> DataFrame:
    """All features at the full number of bins."""
    rounded = labelled_features(t).select("split", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in FEATURES])
    bins = profiling.quantile_histogram(rounded, FEATURES, _ALL_BINS)
    return bins.withColumns({c: F.round(c, 6) for c in ("left_edge", "right_edge")})


# A fixed rule stands in for a classifier, so that both sides can compute it.
_RULE_SQL = """, ruled AS (SELECT behavior_type_label AS label,
    CASE WHEN average_speed < 3 THEN 'STOPPING' WHEN average_speed > 6 THEN 'NORMAL'
         WHEN cog_ratio < 9e-1 THEN 'TRANSSHIPMENT' WHEN n_points = 1 THEN 'UNKNOWN' ELSE 'LOITERING' END AS prediction FROM model),
  confusion AS (SELECT label, prediction, count(*) AS rows FROM ruled GROUP BY ALL)"""


def _confusion(t: Tables) -> DataFrame:
    rule = (
        F.when(F.col("average_speed") < 3, "STOPPING")
        .when(F.col("average_speed") > 6, "NORMAL")
        .when(F.col("cog_ratio") < 0.9, "TRANSSHIPMENT")
        .when(F.col("n_points") == 1, "UNKNOWN")
        .otherwise("LOITERING")
    )
    scored = labelled_features(t).select(F.col("behavior_type_label").alias("label"), rule.alias("prediction"))
    return profiling.confusion_counts(scored, "label", "prediction")


@topic.query("confusion_counts", MODEL_SQL.rstrip() + _RULE_SQL + " SELECT label, prediction, rows FROM confusion")
def confusion_counts(t: Tables) -> DataFrame:
    return _confusion(t)


_REPORT_SQL = _RULE_SQL + """,
  kept AS (SELECT * FROM confusion WHERE prediction <> 'UNKNOWN'),
  classes AS (SELECT DISTINCT label AS scope FROM confusion),
  pr AS (SELECT scope, coalesce((SELECT sum(rows) FROM kept WHERE label = scope AND prediction = scope), 0) AS tp,
           coalesce((SELECT sum(rows) FROM kept WHERE prediction = scope), 0) AS pp,
           coalesce((SELECT sum(rows) FROM kept WHERE label = scope), 0) AS ap FROM classes),
  prf AS (SELECT scope, tp, ap, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS p, CASE WHEN ap > 0 THEN tp / ap ELSE 0 END AS r FROM pr),
  full_report AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM prf),
  report AS (
    SELECT scope, 'precision' AS metric, p AS value FROM full_report UNION ALL SELECT scope, 'recall', r FROM full_report
    UNION ALL SELECT scope, 'f1', f FROM full_report UNION ALL SELECT scope, 'support', CAST(ap AS DOUBLE) FROM full_report
    UNION ALL SELECT 'macro_avg', 'precision', avg(p) FROM full_report UNION ALL SELECT 'macro_avg', 'recall', avg(r) FROM full_report
    UNION ALL SELECT 'macro_avg', 'f1', avg(f) FROM full_report
    UNION ALL SELECT 'overall', 'accuracy', sum(tp) / sum(ap) FROM full_report
    UNION ALL SELECT 'overall', 'total_samples', CAST(sum(ap) AS DOUBLE) FROM full_report)"""


@topic.query(
    "classification_metrics",
    MODEL_SQL.rstrip() + _REPORT_SQL + " SELECT scope, metric, round(value, 6) AS value FROM report",
)
def classification_metrics(t: Tables) -> DataFrame:
    report = profiling.classification_metrics(_confusion(t), LABELS)
    return report.withColumn("value", F.round("value", 6))


@topic.query(
    "metrics_long",
    MODEL_SQL.rstrip()
    + _REPORT_SQL
    + " SELECT 'rule_' || scope || '_' || metric AS metric, round(value, 6) AS value, 7::BIGINT AS step FROM report",
)
def metrics_long(t: Tables) -> DataFrame:
    report = profiling.classification_metrics(_confusion(t), LABELS)
    return profiling.metrics_long(report, F.lit("rule"), F.lit(7)).withColumn("value", F.round("value", 6))


@topic.query(
    "metrics_log",
    MODEL_SQL.rstrip()
    + _REPORT_SQL
    + """ SELECT run, 'rule_' || scope || '_' || metric AS metric, round(value, 6) AS value, step
          FROM report, (VALUES ('first', 1::BIGINT), ('second', 3::BIGINT)) r(run, step)""",
)
def metrics_log(t: Tables) -> DataFrame:
    """Two runs appended to a metric log; the second is logged again, as after a retry, and is in it once."""
    path = new_path(t.spark, "metric-log")
    report = profiling.classification_metrics(_confusion(t), LABELS)
    for run, step in (("first", 1), ("second", 2), ("second", 3)):
        writers.append_metrics(profiling.metrics_long(report, F.lit("rule"), F.lit(step)), path, run)
    log = t.spark.read.schema("metric string, value double, step long, run string").parquet(path)
    return log.withColumn("value", F.round("value", 6))
