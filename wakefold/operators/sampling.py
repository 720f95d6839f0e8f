"""Repeatable sampling, splitting and folding by a hash order.

Random order is the order of ``md5(key:seed)``, so the outcome depends neither on the
partitioning nor on a retry. Ranks within a label are found without sorting a label in one
task: the hash is uniform, so its leading digits cut each label, however large, into even
buckets; a bucket is ranked on its own and shifted by the rows in the buckets before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DIGITS = 3  # 4096 buckets per label


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def _bucketed(frame: DataFrame, key: str, seed: int) -> DataFrame:
    hashed = frame.withColumn("_hash", hash_order(key, seed))
    return hashed.withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))


def _bucket_offsets(bucketed: DataFrame, label: str) -> DataFrame:
    """Rows per (label, bucket), rows before it and rows of the label. Map-side combined."""
    counts = bucketed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        label,
        "_bucket",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(label)).alias("_total"),
    )


def rank_by_hash(frame: DataFrame, label: str, key: str, seed: int, first: int | None = None) -> DataFrame:
    """Adds ``rank`` (1-based, in hash order) and ``total`` per label.

    With ``first``, buckets that start beyond it are dropped before any row is sorted, and
    only ranks up to it are returned.
    """
    bucketed = _bucketed(frame, key, seed)
    offsets = _bucket_offsets(bucketed, label)
    if first is not None:
        offsets = offsets.where(F.col("_before") < first)
    inside = Window.partitionBy(label, "_bucket").orderBy("_hash", key)
    ranked = bucketed.join(offsets, [label, "_bucket"]).withColumn(
        "rank", F.col("_before") + F.row_number().over(inside)
    )
    if first is not None:
        ranked = ranked.where(F.col("rank") <= first)
    return ranked.withColumn("total", F.col("_total")).drop("_hash", "_bucket", "_before", "_total")


def smallest_class(frame: DataFrame, label: str, labels: list[str]) -> int:
    """Rows of the rarest listed label, zero if one is absent."""
    rows = frame.where(F.col(label).isin(labels)).groupBy(label).count().collect()  # at most len(labels) rows
    counts = {r[label]: r["count"] for r in rows}
    return min(counts.get(x, 0) for x in labels)


def balanced_sample(
    frame: DataFrame, label: str, key: str, labels: list[str], n: int | None = None, seed: int = 42
) -> DataFrame:
    """``n`` rows of each label; the size of the rarest label when ``n`` is not given."""
    smallest = smallest_class(frame, label, labels)
    if n is None:
        n = smallest
    if n > smallest:
        raise ValueError(f"{n} rows per label asked for, the rarest label has {smallest}")
    kept = frame.where(F.col(label).isin(labels))
    return rank_by_hash(kept, label, key, seed, first=n).drop("rank", "total")


def stratified_split(frame: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``: exactly ``floor((1 - test_size) * rows)`` train rows per label."""
    ranked = rank_by_hash(frame, label, key, seed)
    train = F.floor(F.lit(1.0 - test_size) * F.col("total"))
    return ranked.withColumn("split", F.when(F.col("rank") <= train, "train").otherwise("test")).drop("rank", "total")


def kfold_assign(frame: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0..folds-1, dealt evenly within each label."""
    ranked = rank_by_hash(frame, label, key, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % folds).cast("long")).drop("rank", "total")
