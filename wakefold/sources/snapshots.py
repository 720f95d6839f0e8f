"""A keyed snapshot in Parquet whose upserts rewrite only the buckets they touch.

Rows lie in one folder per bucket of a key hash. An upsert first writes the accepted updates once,
counted while they pass, then reads only the buckets of their keys, drops the replaced rows by a
``left_anti`` join on keys, and overwrites those folders by dynamic partition overwrite, which swaps
finished files in when the job ends. Other buckets keep their files. Applying the same updates again
gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from wakefold.sources.shared import new_path

BUCKET = "key_bucket"


def _bucketed(frame: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    # Text forms, so that a key has its bucket whatever integer width a caller's column has.
    return frame.withColumn(BUCKET, F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int"))


def _written(frame: DataFrame, path: str) -> None:
    """Rows are rebalanced by bucket, so a large bucket is written by several tasks."""
    rows = frame.hint("rebalance", BUCKET)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def create(rows: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    _written(_bucketed(rows, keys, buckets), path)


def _rows(spark: SparkSession, path: str, schema: StructType | None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(StructType([*schema.fields, StructField(BUCKET, IntegerType())]))
    return reader.parquet(path)


def read(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The snapshot's rows; an empty one, which has no file, needs its schema."""
    return _rows(spark, path, schema).drop(BUCKET)


def newest_revision(updates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first revision of each key in ``order``: all its parts, or one row where there are none."""
    newest = Window.partitionBy(*keys).orderBy(*order)
    if "part" in updates.columns:
        updates = updates.withColumn("_at", F.rank().over(newest)).where("_at = 1")
        newest = Window.partitionBy(*keys, "part").orderBy(*order)
    return updates.withColumn("_at", F.row_number().over(newest)).where("_at = 1").drop("_at")


def apply(
    spark: SparkSession, path: str, keys: list[str], updates: DataFrame, reason: Column, order: list[Column], buckets: int,
    schema: StructType | None = None,
) -> dict[str, int]:
    """Upserts the rows without a ``reason``; keys processed, upserted and rejected.

    ``reason`` (null: accepted) may hold aggregates over the keys, so that rows of one key share a fate.
    Among accepted rows of a key the newest revision is stored, in the columns of the snapshot; columns
    missing in the updates become null. Counts are of distinct (key, revision) rows: of ``part`` 0 where
    there are parts. Updates without accepted rows change nothing.
    """
    columns = read(spark, path, schema).schema
    seen, staged = Observation("upsert"), new_path(spark, "updates")
    head = F.col("part") == 0 if "part" in updates.columns else F.lit(True)
    judged = updates.withColumn("_reason", reason).observe(
        seen, F.count_if(head).alias("processed"), F.count_if(head & F.col("_reason").isNotNull()).alias("rejected")
    )
    newest = newest_revision(judged.where("_reason IS NULL"), keys, order)
    fields = [F.col(f.name) if f.name in updates.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in columns]
    _bucketed(newest.select(fields), keys, buckets).write.parquet(staged)
    fresh = spark.read.parquet(staged)
    touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
    stored = fresh.where(head).count()
    if touched:
        before = _rows(spark, path, schema).where(F.col(BUCKET).isin(touched))
        kept = before.join(fresh.select(*keys).distinct(), keys, "left_anti")
        _written(kept.unionByName(fresh.select(kept.columns)), path)
    counts = seen.get
    return {"processed": counts["processed"], "upserted": stored, "rejected": counts["rejected"]}
