"""The sixteen trajectory features, derived from track summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakefold.functions.geo import haversine_km
from wakefold.operators.segments import SEGMENT_MS, suffix_summaries, track_summaries
from wakefold.schemas import FEATURES


def _spread(squares: Column, count: Column) -> Column:
    """Population deviation from the sum of squared deviations."""
    return F.when(count == 0, F.lit(0.0)).otherwise(F.sqrt(squares / count))


def _ratio(part: Column, whole: Column) -> Column:
    """Quotient that is zero for a zero divisor and null for a null one."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.try_divide(part, whole))


def feature_columns() -> dict[str, Column]:
    """Feature expressions over the columns of a track summary.

    Headings are averaged on the line, not on the circle, and turns do not wrap at 360.
    """
    n = F.col("n").cast("double")
    span = (F.col("tail_ts") - F.col("head_ts")).cast("double")
    known = F.col("km_gap") == 0
    km = F.when(known, F.col("km"))
    straight = F.coalesce(
        haversine_km(F.col("head_lat"), F.col("head_lon"), F.col("tail_lat"), F.col("tail_lon")),
        F.when(F.col("head_lat").isNull() | F.col("tail_lat").isNull(), F.lit(0.0)),
    )
    sog_n, cog_n = F.col("sog_n").cast("double"), F.col("cog_n").cast("double")
    return {
        "average_speed": _ratio(F.col("sog_sum"), sog_n),
        "min_speed": F.col("sog_min"),
        "max_speed": F.col("sog_max"),
        "average_heading": _ratio(F.col("cog_sum"), cog_n),
        "min_heading": F.col("cog_min"),
        "max_heading": F.col("cog_max"),
        "std_dev_heading": _spread(F.col("cog_m2"), F.greatest(cog_n, F.lit(1.0))),
        "std_dev_speed": _spread(F.col("sog_m2"), F.greatest(sog_n, F.lit(1.0))),
        "total_area_time": span,
        "low_speed_percentage": F.lit(100.0) * F.col("slow") / n,
        "stagnation_time": F.col("still") * span / n,
        "distance_in_kilometers": km,
        "average_time_diff_between_consecutive_points": _ratio(span, n - 1),
        "displacement_ratio": F.when(km > 0, straight / km).otherwise(F.lit(0.0)),
        "cog_unit_range": F.when(known | (span == 0), _ratio(F.col("bearing_ms"), span) / 360.0),
        "cog_ratio": _ratio(F.col("turns").cast("double"), n - 1),
    }


def with_features(summaries: DataFrame, keys: list[str]) -> DataFrame:
    columns = feature_columns()
    measured = summaries.where(F.col("n") > 0)
    return measured.select(*keys, *[columns[name].alias(name) for name in FEATURES], F.col("n").alias("n_points"))


def trajectory_features(
    points: DataFrame, keys: list[str], segment_ms: int = SEGMENT_MS
) -> DataFrame:
    """Features of every trajectory whose points carry ``keys``."""
    return with_features(track_summaries(points, keys, segment_ms), keys)


def open_ended_features(
    points: DataFrame, bounds: DataFrame, segment_ms: int = SEGMENT_MS
) -> DataFrame:
    """Features of the rest of the vessel's track from each event start on.

    ``bounds`` has ``event_index``, ``id``, ``Category`` and ``from_ms``. An event without a
    later point gives no row. Linear in points plus events.
    """
    summaries = suffix_summaries(points, bounds, segment_ms)
    return with_features(summaries, ["event_index", "id", "Category"])
