"""Snapshot upserts: newest row per key of target and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakefold.functions.textual import array_text, is_valid_linestring

TRAJECTORY_KEYS = ["mmsi", "event_index", "behavior_type_label"]
PREDICTION_KEYS = [*TRAJECTORY_KEYS, "timestamp_array"]


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Target with updates applied; among updates of one key the first in ``order`` wins.

    One shuffle: both sides are unioned and the winner taken by ``row_number``, whose limit
    Spark applies before the shuffle too. Columns are those of the target; columns missing in
    the updates become null. Applying the same updates again changes nothing. Where both sides have
    a ``part``, the rows of a key are the parts of one trajectory and are replaced together;
    ``order`` must then be the same for all parts of a revision.
    """
    for key in keys:
        if key not in updates.columns:
            raise ValueError(f"updates lack key column {key}")
    both = target.withColumn("_new", F.lit(0)).unionByName(
        updates.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    newest = Window.partitionBy(*keys).orderBy(F.desc("_new"), *order)
    if "part" in target.columns and "part" in updates.columns:
        # All parts of the newest revision stay, and older parts go even where it has fewer.
        both = both.withColumn("_revision", F.rank().over(newest)).where(F.col("_revision") == 1)
        newest = Window.partitionBy(*keys, "part").orderBy(F.desc("_new"), *order)
    ranked = both.withColumn("_at", F.row_number().over(newest)).where(F.col("_at") == 1)
    return ranked.select(*target.columns)


def _named(updates: DataFrame) -> DataFrame:
    """The vessel may be called ``id``; both spellings of the event number are accepted."""
    for other, name in (("id", "mmsi"), ("EventIndex", "event_index")):
        if name not in updates.columns and other in updates.columns:
            updates = updates.withColumnRenamed(other, name)
    return updates


def reject_reason(columns: list[str], keys: list[str] = TRAJECTORY_KEYS) -> Column:
    """Why a row cannot be stored, or null: ``key`` for a null in the key, ``trajectory`` for a short path.

    A trajectory of several parts is judged as a whole by its part 0, the only one that needs two
    positions; without a usable part 0 all its parts are rejected.
    """
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    usable = is_valid_linestring(F.col("trajectory"))
    if "part" in columns:
        revision = [c for c in ("revision",) if c in columns]
        whole = Window.partitionBy(*keys, *revision)
        usable = F.coalesce(F.max((F.col("part") == 0) & usable).over(whole), F.lit(False))
    return F.when(missing, F.lit("key")).when(~usable, F.lit("trajectory"))


def rejected(updates: DataFrame, keys: list[str] = TRAJECTORY_KEYS) -> DataFrame:
    """Updates that cannot be stored with their ``reason``: ``key`` for a null in the key, else ``trajectory``."""
    named = _named(updates)
    return named.withColumn("reason", reject_reason(named.columns, keys)).where("reason IS NOT NULL")


def valid_trajectories(updates: DataFrame, keys: list[str] = TRAJECTORY_KEYS) -> DataFrame:
    """Updates that can be stored: at least two positions in the whole and no null in the key."""
    named = _named(updates)
    judged = named.withColumn("_reason", reject_reason(named.columns, keys))
    return judged.where("_reason IS NULL").drop("_reason")


def validity_counts(updates: DataFrame) -> DataFrame:
    """Trajectories processed, valid and rejected, in one pass.

    A trajectory of several parts counts once, by its part 0; that one is full whenever there are others.
    """
    whole = updates.where("part = 0") if "part" in updates.columns else updates
    ok = is_valid_linestring(F.col("trajectory"))
    if set(TRAJECTORY_KEYS) <= set(_named(whole).columns):
        whole = _named(whole)
        whole = whole.withColumn("_ok", reject_reason([], TRAJECTORY_KEYS).isNull())
        ok = F.col("_ok")
    return whole.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(ok).alias("valid"),
        F.count_if(~ok).alias("rejected"),
    )


def upsert_trajectories(target: DataFrame, updates: DataFrame, order: list[Column]) -> DataFrame:
    return upsert(target, valid_trajectories(updates), TRAJECTORY_KEYS, order)


def as_predictions(scored: DataFrame) -> DataFrame:
    """Scored window blocks with a readable path; each set-valued key becomes its least element."""
    return scored.withColumns(
        {
            "aggregated_ais_data_id": F.array_min("primary_key_from_aggregated_ais_data"),
            "event_index": F.array_min("event_index"),
            "behavior_type_label": F.array_min("behavior_type_label"),
            "timestamp_array": array_text(F.col("timestamp_array")),
        }
    ).where(is_valid_linestring(F.col("trajectory")))


def upsert_predictions(target: DataFrame, updates: DataFrame, order: list[Column]) -> DataFrame:
    return upsert(target, updates, PREDICTION_KEYS, order)
