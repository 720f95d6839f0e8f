"""Typed schemas and the fixed value domains of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Label domain, fluent-to-category table and classifier features.
LABELS = ["LOITERING", "NORMAL", "STOPPING", "TRANSSHIPMENT"]

FLUENT_CATEGORY = {
    "highSpeedNC": "NORMAL",
    "loitering": "LOITERING",
    "tuggingSpeed": "LOITERING",
    "stopped": "STOPPING",
    "anchoredOrMoored": "STOPPING",
    "rendezVous": "TRANSSHIPMENT",
}

FEATURES = [
    "average_speed",
    "min_speed",
    "max_speed",
    "average_heading",
    "min_heading",
    "max_heading",
    "std_dev_heading",
    "std_dev_speed",
    "total_area_time",
    "low_speed_percentage",
    "stagnation_time",
    "distance_in_kilometers",
    "average_time_diff_between_consecutive_points",
    "displacement_ratio",
    "cog_unit_range",
    "cog_ratio",
]

RESOLUTIONS = [120, 128, 224, 256, 299, 384, 512, 640]

# End of fixed values.

HOUR_MS = 3_600_000

LABEL_FILE = T.StructType(
    [
        T.StructField("FluentName", T.StringType()),
        T.StructField("MMSI", T.StringType()),
        T.StructField("Argument", T.StringType()),
        T.StructField("Value", T.StringType()),
        T.StructField("T_start", T.LongType()),
        T.StructField("T_end", T.LongType()),
    ]
)

EVENT_FILE = T.StructType(
    [
        T.StructField("FluentName", T.StringType()),
        T.StructField("MMSI", T.StringType()),
        T.StructField("Argument", T.StringType()),
        T.StructField("Value", T.StringType()),
        T.StructField("T_start", T.StringType()),
        T.StructField("T_end", T.StringType()),
        T.StructField("Category", T.StringType()),
        T.StructField("event_index", T.LongType()),
    ]
)

AIS_FILE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("annotation", T.StringType()),
        T.StructField("speed", T.DoubleType()),
        T.StructField("heading", T.DoubleType()),
        T.StructField("turn", T.DoubleType()),
        T.StructField("course", T.DoubleType()),
    ]
)

AIS_COLUMNS = [f.name for f in AIS_FILE.fields]

# One stored trajectory; arrays stay native and become text only at a CSV sink.
TRAJECTORY = T.StructType(
    [
        T.StructField("mmsi", T.StringType()),
        T.StructField("event_index", T.LongType()),
        T.StructField("part", T.LongType()),
        T.StructField("trajectory", T.StringType()),
        T.StructField("timestamp_array", T.ArrayType(T.StringType())),
        T.StructField("sog_array", T.ArrayType(T.DoubleType())),
        T.StructField("cog_array", T.ArrayType(T.DoubleType())),
        T.StructField("behavior_type_label", T.StringType()),
    ]
    + [T.StructField(name, T.DoubleType()) for name in FEATURES]
)

WINDOW_BLOCK = T.StructType(
    [
        T.StructField("primary_key_from_aggregated_ais_data", T.ArrayType(T.LongType())),
        T.StructField("mmsi", T.StringType()),
        T.StructField("event_index", T.ArrayType(T.LongType())),
        T.StructField("trajectory", T.StringType()),
        T.StructField("timestamp_array", T.ArrayType(T.StringType())),
        T.StructField("sog_array", T.ArrayType(T.DoubleType())),
        T.StructField("cog_array", T.ArrayType(T.DoubleType())),
        T.StructField("behavior_type_label", T.ArrayType(T.StringType())),
    ]
    + [T.StructField(name, T.DoubleType()) for name in FEATURES]
    + [
        T.StructField("n_points", T.LongType()),
        T.StructField("window_index", T.LongType()),
        T.StructField("window_start_ts", T.TimestampType()),
        T.StructField("window_end_ts", T.TimestampType()),
    ]
)


def empty(spark, schema: T.StructType):
    """A zero-row frame that still carries the full schema."""
    return spark.createDataFrame([], schema)
