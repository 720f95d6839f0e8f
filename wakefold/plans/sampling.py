"""Queries on sampling, splitting, folding, cleaning and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakefold.operators import cleaning, sampling
from wakefold.plans.registry import Topic
from wakefold.plans.sqltext import FEATURE_SQL, step_cte
from wakefold.plans.tables import Tables, sql_with
from wakefold.schemas import FEATURES, LABELS

topic = Topic()

SEED = 42
LABEL = "behavior_type_label"


def keyed(frame: DataFrame) -> DataFrame:
    """One unique text key per trajectory."""
    return frame.withColumn("row_key", F.concat_ws(":", "event_index", "id"))


def labelled_spans(t: Tables) -> DataFrame:
    return keyed(t.spans.withColumnRenamed("Category", LABEL)).select("row_key", LABEL, "n_points")


def labelled_features(t: Tables) -> DataFrame:
    """Stored trajectories, split 80 to 20 within each label."""
    table = keyed(t.stored.where("part = 0")).select("row_key", LABEL, "n_points", *FEATURES)
    return sampling.stratified_split(table, LABEL, "row_key", 0.2, SEED)


_LABELLED = """
  labelled AS (SELECT CAST(event_index AS VARCHAR) || ':' || id AS row_key, Category AS behavior_type_label, n_points FROM spans)"""
_RANKED = """
  ranked AS (SELECT *, row_number() OVER (PARTITION BY behavior_type_label ORDER BY md5(row_key || ':42'), row_key) AS rank,
             count(*) OVER (PARTITION BY behavior_type_label) AS total FROM {source})"""

_FEATURE_LIST = ", ".join(f"{e} AS {n}" for n, e in FEATURE_SQL.items())

MODEL_SQL = sql_with(
    "event_points",
    extra=step_cte("steps", "event_points", "event_index, id")
    + f""",
  featured AS (SELECT CAST(event_index AS VARCHAR) || ':' || id AS row_key, Category AS behavior_type_label,
               count(*) AS n_points, {_FEATURE_LIST} FROM steps GROUP BY event_index, id, Category),"""
    + _RANKED.format(source="featured")
    + """,
  model AS (SELECT * EXCLUDE (rank, total), 1e0 AS one,
            CASE WHEN rank <= floor((1 - 2e-1) * total) THEN 'train' ELSE 'test' END AS split FROM ranked)""",
)


@topic.query(
    "balanced_sample",
    sql_with("spans", extra=_LABELLED + "," + _RANKED.format(source="labelled"))
    + """SELECT row_key, behavior_type_label, n_points FROM ranked
         WHERE rank <= (SELECT min(total) FROM ranked)""",
)
def balanced_sample(t: Tables) -> DataFrame:
    return sampling.balanced_sample(labelled_spans(t), LABEL, "row_key", LABELS, None, SEED)


@topic.query(
    "stratified_split",
    sql_with("spans", extra=_LABELLED + "," + _RANKED.format(source="labelled"))
    + """SELECT row_key, behavior_type_label, n_points,
         CASE WHEN rank <= floor((1 - 28e-2) * total) THEN 'train' ELSE 'test' END AS split FROM ranked""",
)
def stratified_split(t: Tables) -> DataFrame:
    return sampling.stratified_split(labelled_spans(t), LABEL, "row_key", 0.28, SEED)


@topic.query(
    "kfold_assign",
    sql_with("spans", extra=_LABELLED + "," + _RANKED.format(source="labelled"))
    + "SELECT row_key, behavior_type_label, n_points, (rank - 1) % 5 AS fold FROM ranked",
)
def kfold_assign(t: Tables) -> DataFrame:
    return sampling.kfold_assign(labelled_spans(t), LABEL, "row_key", 5, SEED)


_SPOILT = ["max_speed", "distance_in_kilometers"]
# Large values are spoilt on purpose: not-a-number, infinite or missing.
_SPOILT_SQL = """CASE WHEN max_speed > 10 THEN NULL ELSE round(max_speed, 6) END AS max_speed,
  CASE WHEN distance_in_kilometers > 60 THEN NULL ELSE round(distance_in_kilometers, 6) END AS distance_in_kilometers"""


def _spoilt(t: Tables) -> DataFrame:
    speed, km = F.col("max_speed"), F.col("distance_in_kilometers")
    return labelled_features(t).select(
        "row_key", LABEL, "split",
        F.when(speed > 14, F.lit(float("nan"))).when(speed > 10, F.lit(float("inf"))).otherwise(F.round(speed, 6)).alias("max_speed"),
        F.when(km > 80, F.lit(float("-inf"))).when(km > 60, F.lit(None)).otherwise(F.round(km, 6)).alias("distance_in_kilometers"),
    )


@topic.query(
    "clean_nonfinite", MODEL_SQL + f"SELECT row_key, behavior_type_label, split, {_SPOILT_SQL} FROM model"
)
def clean_nonfinite(t: Tables) -> DataFrame:
    return cleaning.clean_nonfinite(_spoilt(t), _SPOILT)


@topic.query(
    "impute_median",
    MODEL_SQL.rstrip()
    + f""", cleaned AS (SELECT row_key, behavior_type_label, split, {_SPOILT_SQL} FROM model),
         mid AS (SELECT quantile_disc(max_speed, 0.5) AS a, quantile_disc(distance_in_kilometers, 0.5) AS b
                 FROM cleaned WHERE split = 'train')
         SELECT row_key, behavior_type_label, split, coalesce(max_speed, a) AS max_speed,
                coalesce(distance_in_kilometers, b) AS distance_in_kilometers FROM cleaned, mid""",
)
def impute_median(t: Tables) -> DataFrame:
    return cleaning.impute(cleaning.clean_nonfinite(_spoilt(t), _SPOILT), _SPOILT, "median")


_SCALED = ["average_speed", "cog_unit_range"]


@topic.query(
    "standard_scale",
    MODEL_SQL.rstrip()
    + """, m AS (SELECT avg(average_speed) AS ma, stddev_samp(average_speed) AS sa, avg(cog_unit_range) AS mc,
                stddev_samp(cog_unit_range) AS sc FROM model WHERE split = 'train')
         SELECT row_key, split, round((average_speed - ma) / sa, 6) + 0e0 AS average_speed,
                round((cog_unit_range - mc) / sc, 6) + 0e0 AS cog_unit_range FROM model, m""",
)
def standard_scale(t: Tables) -> DataFrame:
    table = labelled_features(t).select("row_key", "split", *_SCALED)
    scaled = cleaning.standard_scale(table, _SCALED)
    return scaled.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in _SCALED})


# The same operators on all features; every feature is spoilt in three of eleven rows by size.
_SPOILT_ALL_SQL = ", ".join(
    f"CASE WHEN (n_points + {i}) % 11 < 3 THEN NULL ELSE round({c}, 6) + 0e0 END AS {c}" for i, c in enumerate(FEATURES)
)


def _spoilt_all(t: Tables) -> DataFrame:
    def spoilt(i: int, c: str):
        turn = (F.col("n_points") + i) % 11
        bad = F.when(turn == 0, F.lit(float("nan"))).when(turn == 1, F.lit(float("-inf"))).when(turn == 2, F.lit(None))
        return bad.otherwise(F.round(c, 6) + F.lit(0.0)).alias(c)

    return labelled_features(t).select("row_key", LABEL, "split", *[spoilt(i, c) for i, c in enumerate(FEATURES)])


@topic.query(
    "clean_nonfinite_all", MODEL_SQL + f"SELECT row_key, behavior_type_label, split, {_SPOILT_ALL_SQL} FROM model"
)
def clean_nonfinite_all(t: Tables) -> DataFrame:
    return cleaning.clean_nonfinite(_spoilt_all(t), FEATURES)


@topic.query(
    "impute_median_all",
    MODEL_SQL.rstrip()
    + f""", cleaned AS (SELECT row_key, behavior_type_label, split, {_SPOILT_ALL_SQL} FROM model),
         mid AS (SELECT {", ".join(f"quantile_disc({c}, 0.5) AS mid_{c}" for c in FEATURES)}
                 FROM cleaned WHERE split = 'train')
         SELECT row_key, behavior_type_label, split, {", ".join(f"coalesce({c}, mid_{c}) AS {c}" for c in FEATURES)}
         FROM cleaned, mid""",
)
def impute_median_all(t: Tables) -> DataFrame:
    return cleaning.impute(cleaning.clean_nonfinite(_spoilt_all(t), FEATURES), FEATURES, "median")


@topic.query(
    "standard_scale_all",
    MODEL_SQL.rstrip()
    + f""", m AS (SELECT {", ".join(f"avg({c}) AS mean_{c}, stddev_samp({c}) AS std_{c}" for c in FEATURES)}
                FROM model WHERE split = 'train')
         SELECT row_key, split, {", ".join(
             f"CASE WHEN std_{c} > 0 THEN round(({c} - mean_{c}) / std_{c}, 6) + 0e0 ELSE 0e0 END AS {c}" for c in FEATURES)}
         FROM model, m""",
)
def standard_scale_all(t: Tables) -> DataFrame:
    table = labelled_features(t).select("row_key", "split", *FEATURES)
    scaled = cleaning.standard_scale(table, FEATURES)
    return scaled.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in FEATURES})
