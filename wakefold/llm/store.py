"""Intermediate tables in the shared folder; they cut lineage and survive lost executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakefold.sources import shared
from wakefold.sources.shared import in_tasks  # noqa: F401 - used by the corpus operators

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Writes the frame under the checkpoint folder and reads it back.

    Nothing needs the shuffle files of the job afterwards, so they go when it ends.
    """
    spark = frame.sparkSession
    path = shared.new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)


def document_key() -> list[Column]:
    """Two columns telling rows apart by id and text; equal rows share a key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [
        F.coalesce(F.col("doc_id"), F.lit(-(2**63) + 1)).alias("k1"),
        F.xxhash64(text, F.col("doc_id").isNull()).alias("k2"),
    ]


def ranked(frame: DataFrame, keys: list[str], spread: list[str], name: str, buckets: int = 64) -> DataFrame:
    """Adds ``name``: a gapless rank from 0 within the keys, in no promised order.

    Rows of a key are dealt to buckets by a hash of ``spread``, numbered inside the bucket and
    shifted by the counts of the buckets before, so no key is ordered in one task.
    """
    dealt = frame.withColumn("_bucket", F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*spread)
    numbered = dealt.withColumn("_row", F.row_number().over(inside) - 1)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_bucket") == F.col("_b")]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    joined = numbered.join(bases, condition)
    return joined.withColumn(name, F.col("_base") + F.col("_row")).select(*frame.columns, name)
