"""One-pass table profiles, class balance, quantile histograms and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rank error 1/50000 of the rows; the sketch is exact for small tables and bounded for large.
QUANTILE_ACCURACY = 50_000
EDGE_GAP = 1e-12


def _long(wide: DataFrame, columns: list[str], metrics: list[str], keep: list[str] | None = None) -> DataFrame:
    """Wide aggregates named ``column#metric`` as one row per column."""
    keep = keep or []
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}#{m}`").alias(m) for m in metrics])
            for c in columns
        ]
    )
    return wide.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")


def _float_columns(frame: DataFrame) -> list[str]:
    return [f.name for f in frame.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def _numeric_columns(frame: DataFrame) -> list[str]:
    return [f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType)]


def profile_nulls(frame: DataFrame) -> DataFrame:
    """Nulls, and nulls or NaNs of float columns, of every column in one pass."""
    floats = set(_float_columns(frame))
    aggregates = []
    for c in frame.columns:
        missing = F.col(c).isNull()
        aggregates.append(F.count_if(missing).alias(f"{c}#nulls"))
        unusable = missing | F.isnan(c) if c in floats else missing
        aggregates.append(F.count_if(unusable).alias(f"{c}#nulls_or_nans"))
    return _long(frame.agg(*aggregates), frame.columns, ["nulls", "nulls_or_nans"])


def profile_distinct(frame: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct values per column, a null counting as a value.

    The exact form reduces (column, value) pairs before and after one shuffle, so neither a
    frequent value nor a wide column meets in one task.
    """
    if approximate:
        wide = frame.agg(
            *[
                (F.approx_count_distinct(c) + F.max(F.col(c).isNull().cast("long"))).alias(f"{c}#distinct_values")
                for c in frame.columns
            ]
        )
        return _long(wide, frame.columns, ["distinct_values"])
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in frame.columns])
    )
    return (
        frame.select(pairs.alias("p"))
        .select("p.*")
        .distinct()
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("distinct_values"))
    )


def profile_summary(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles per numeric column.

    Quartiles come from a mergeable sketch of fixed size.
    """
    columns = columns or _numeric_columns(frame)
    aggregates = []
    for c in columns:
        value = F.col(c).cast("double")
        aggregates += [
            F.count(value).alias(f"{c}#count"),
            F.avg(value).alias(f"{c}#mean"),
            F.stddev(value).alias(f"{c}#std"),
            F.min(value).alias(f"{c}#min"),
            F.max(value).alias(f"{c}#max"),
            F.percentile_approx(value, [0.25, 0.5, 0.75], QUANTILE_ACCURACY).alias(f"{c}#q"),
        ]
    wide = frame.agg(*aggregates)
    long = _long(wide, columns, ["count", "mean", "std", "min", "max", "q"])
    quartile = [F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))]
    return long.select("column", "count", "mean", "std", "min", *quartile, "max")


def profile_columns(frame: DataFrame) -> DataFrame:
    """Shape, types and extremes of all columns: one row per column with type, rows, present values, least and greatest.

    Extremes are those of the column's own type, as text; nested columns have none.
    """
    plain = [f.name for f in frame.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for at, name in enumerate(frame.columns):
        value = F.col(f"`{name}`")
        aggregates.append(F.count(value).alias(f"{at}#count"))
        for what, fold in (("min", F.min), ("max", F.max)):
            edge = fold(value).cast("string") if name in plain else F.lit(None).cast("string")
            aggregates.append(edge.alias(f"{at}#{what}"))
    rows = [
        F.struct(
            F.lit(field.name).alias("column"),
            F.lit(at).cast("long").alias("position"),
            F.lit(field.dataType.simpleString()).alias("type"),
            F.col("rows"),
            *[F.col(f"{at}#{what}").alias(what) for what in ("count", "min", "max")],
        )
        for at, field in enumerate(frame.schema.fields)
    ]
    return frame.agg(*aggregates).select(F.inline(F.array(*rows)))


def label_counts(frame: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """Rows per listed label; zero where a label is absent."""
    spark = frame.sparkSession
    listed = spark.createDataFrame([(x,) for x in labels], f"{label} string")
    counts = frame.where(F.col(label).isin(labels)).groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    return F.broadcast(listed).join(counts, label, "left").select(
        label, F.coalesce("rows", F.lit(0)).alias("rows")
    )


def class_distribution(frame: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Rows per label in the train and test part, with the share of each part."""
    counts = frame.groupBy(label).agg(
        F.count_if(F.col(split) == "train").alias("train_rows"),
        F.count_if(F.col(split) == "test").alias("test_rows"),
    )
    every = Window.partitionBy(F.lit(1))  # one row per label
    return counts.select(
        label,
        "train_rows",
        "test_rows",
        F.try_divide(F.col("train_rows"), F.sum("train_rows").over(every)).alias("train_share"),
        F.try_divide(F.col("test_rows"), F.sum("test_rows").over(every)).alias("test_share"),
    )


def feature_stats(frame: DataFrame, features: list[str], split: str = "split") -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum per feature for train and test."""
    aggregates = []
    for c in features:
        for part in ("train", "test"):
            value = F.when(F.col(split) == part, F.col(c))
            for metric, fn in (
                ("count", F.count), ("mean", F.avg), ("std", F.stddev), ("min", F.min), ("max", F.max)
            ):
                aggregates.append(fn(value).alias(f"{c}#{part}_{metric}"))
    metrics = [f"{p}_{m}" for p in ("train", "test") for m in ("count", "mean", "std", "min", "max")]
    return _long(frame.agg(*aggregates), features, metrics).withColumnRenamed("column", "feature")


def zero_variance(frame: DataFrame, features: list[str]) -> DataFrame:
    """Sample deviation per feature and whether the feature is constant."""
    wide = frame.agg(*[F.stddev(c).alias(f"{c}#std") for c in features])
    long = _long(wide, features, ["std"]).withColumnRenamed("column", "feature")
    return long.withColumn("is_constant", F.coalesce(F.col("std") == 0, F.lit(True)))


def quantile_edges(frame: DataFrame, features: list[str], bins: int) -> DataFrame:
    """Bin edges per feature: quantiles at i/bins with equal neighbours merged."""
    probabilities = [i / bins for i in range(bins + 1)]
    wide = frame.agg(
        *[F.percentile_approx(c, probabilities, QUANTILE_ACCURACY).alias(f"{c}#q") for c in features]
    )
    merged = F.aggregate(
        "q",
        F.array().cast("array<double>"),
        lambda acc, v: F.when(
            (F.size(acc) == 0) | (v - F.element_at(acc, -1) > EDGE_GAP), F.array_append(acc, v)
        ).otherwise(acc),
    )
    long = _long(wide, features, ["q"]).withColumnRenamed("column", "feature")
    return long.select("feature", merged.alias("edges")).where(F.size("edges") >= 2)


def quantile_histogram(
    frame: DataFrame, features: list[str], bins: int = 30, split: str = "split"
) -> DataFrame:
    """Rows per quantile bin of the train part, for train and test.

    Bins are ``[left, right)``, the last one ``[left, right]``. Edges are one small row per
    feature; all features are then counted in one pass.
    """
    edges = quantile_edges(frame.where(F.col(split) == "train"), features, bins)
    values = frame.select(
        split,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
        ).alias("v"),
    ).select(split, "v.*")
    last = F.size("edges") - 1
    below = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    number = F.least(below, last) - 1
    placed = (
        values.join(F.broadcast(edges), "feature")
        .where(F.col("value").between(F.col("edges")[0], F.element_at("edges", -1)))
        .withColumn("bin", number)
    )
    counted = placed.groupBy("feature", "bin").agg(
        F.count_if(F.col(split) == "train").alias("train_rows"),
        F.count_if(F.col(split) == "test").alias("test_rows"),
    )
    every_bin = edges.select("feature", "edges", F.posexplode(F.slice("edges", F.lit(1), last)).alias("bin", "left"))
    return every_bin.join(counted, ["feature", "bin"], "left").select(
        "feature",
        F.col("bin").cast("long").alias("bin"),
        F.col("left").alias("left_edge"),
        F.col("edges")[F.col("bin") + 1].alias("right_edge"),
        F.coalesce("train_rows", F.lit(0)).alias("train_rows"),
        F.coalesce("test_rows", F.lit(0)).alias("test_rows"),
    )


def confusion_counts(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    return scored.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("rows"))


def classification_metrics(
    confusion: DataFrame,
    labels: list[str],
    label: str = "label",
    prediction: str = "prediction",
    by: list[str] | None = None,
) -> DataFrame:
    """Long-form report per ``by`` group: per class, macro averages and accuracy.

    Counts with a label or prediction outside ``labels`` are left out; a quotient with a zero
    divisor is zero. Works on the small confusion table only.
    """
    by = by or []
    known = confusion.where(F.col(label).isin(labels) & F.col(prediction).isin(labels))
    zero, rows = F.lit(0).cast("long"), F.col("rows")
    hit = F.when(F.col(label) == F.col(prediction), rows).otherwise(zero)
    every_class = F.explode(F.array(*[F.lit(x) for x in labels]))
    # Each count adds to the support of its label and to the predictions of its class; the
    # listed classes add zeros, so that none is missing from a group.
    sides = (
        known.select(*by, F.col(label).alias("scope"), rows.alias("support"), zero.alias("predicted"), hit.alias("hits"))
        .unionByName(
            known.select(*by, F.col(prediction).alias("scope"), zero.alias("support"), rows.alias("predicted"), zero.alias("hits"))
        )
        .unionByName(
            confusion.select(*by, every_class.alias("scope"), zero.alias("support"), zero.alias("predicted"), zero.alias("hits"))
        )
    )
    per_class = sides.groupBy(*by, "scope").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(F.lit(0.0))
    scored = per_class.withColumn("precision", precision).withColumn("recall", recall)
    both = F.col("precision") + F.col("recall")
    scored = scored.withColumn(
        "f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0))
    )
    names = ["precision", "recall", "f1"]

    def cell(scope: Column, metric: str, value: Column) -> Column:
        return F.struct(scope.alias("scope"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))

    class_cells = F.array(*[cell(F.col("scope"), n, F.col(n)) for n in [*names, "support"]])
    whole = scored.groupBy(*by).agg(
        F.flatten(F.collect_list(class_cells)).alias("classes"),  # four cells per listed label
        *[F.avg(n).alias(n) for n in names],
        F.coalesce(F.try_divide(F.sum("hits"), F.sum("support")), F.lit(0.0)).alias("accuracy"),
        F.sum("support").alias("total_samples"),
    )
    summary = F.array(
        *[cell(F.lit("macro_avg"), n, F.col(n)) for n in names],
        *[cell(F.lit("overall"), n, F.col(n)) for n in ("accuracy", "total_samples")],
    )
    return whole.select(*by, F.explode(F.concat("classes", summary)).alias("m")).select(*by, "m.*")


def metrics_long(report: DataFrame, prefix: Column, step: Column) -> DataFrame:
    """Report rows under the names a metric log uses."""
    return report.select(
        F.concat_ws("_", prefix, "scope", "metric").alias("metric"), "value", step.cast("long").alias("step")
    )
