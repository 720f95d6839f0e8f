"""Behaviour classifiers on MLlib: pipelines, cross-validation, learning curves, reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.feature import (
    Imputer, IndexToString, StandardScaler, StringIndexerModel, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakefold.ml import deep_forest, spread_forest
from wakefold.ml.deep_forest import TaskForest
from wakefold.operators.cleaning import clean_nonfinite
from wakefold.operators.profiling import (
    classification_metrics, confusion_counts, metrics_long, zero_variance,
)
from wakefold.operators.sampling import balanced_sample, kfold_assign, smallest_class, stratified_split
from wakefold.schemas import FEATURES
from wakefold.sources.shared import ensure_checkpoint_dir, new_path

LABEL = "behavior_type_label"
KEY = "row_key"
ROWS_PER_TASK = 50_000
UNLIMITED_DEPTH = 30  # MLlib builds no deeper trees
DEEP = 10
TASK_FOREST_ROWS = (20_000, 2_000_000)  # deep forests on fewer rows are left to MLlib; of more, a task could not hold all
SPREAD_FROM = 100_000  # shallow forests on more rows are grown by ``spread_forest``
FITS_AT_ONCE = 5
FEW_TASKS = 8  # up to so many tasks' rows, jobs are short: their overhead counts, and several fits run side by side


def svm(max_iterations: int = 20, regularization: float = 0.0) -> Estimator:
    return OneVsRest(
        classifier=LinearSVC(maxIter=max_iterations, regParam=regularization),
        labelCol="label",
        parallelism=4,
    )


def forest(trees: int = 100, depth: int | None = None, seed: int = 42) -> Estimator:
    """Trees are 5 deep when no depth is given; ``UNLIMITED_DEPTH`` for as deep as MLlib builds them.

    In deep forests each row keeps the node it is in, so a level costs a lookup and not a walk from the
    root, and a level's nodes fit one pass.
    """
    deep = {"cacheNodeIds": True, "maxMemoryInMB": 1024} if (depth or 5) > DEEP else {}
    return RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth or 5, seed=seed, **deep)


def usable_features(train: DataFrame, features: list[str]) -> list[str]:
    """Features that vary on the train rows (one small row per feature is collected)."""
    constant = {r["feature"] for r in zero_variance(train, features).where("is_constant").collect()}
    return [f for f in features if f not in constant]


def pipeline(classifier: Estimator, features: list[str], labels: list[str], strategy: str = "median") -> Pipeline:
    """Imputer, assembler, scaler, label indexer and classifier as one pipeline.

    All steps are fitted together, so a fold never sees the rows it is tested on. An unknown
    label is an error.
    """
    filled = [f"{f}_filled" for f in features]
    # Numbers follow the listed labels, so a label without rows does not shift the names of the rest.
    indexer = StringIndexerModel.from_labels(sorted(labels), LABEL, "label", "error")
    return Pipeline(
        stages=[
            Imputer(inputCols=features, outputCols=filled, strategy=strategy),
            VectorAssembler(inputCols=filled, outputCol="raw_features", handleInvalid="keep"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
            indexer,
            classifier,
            IndexToString(inputCol="prediction", outputCol="predicted", labels=sorted(labels)),
        ]
    )


def tasks_for(rows: int) -> int:
    return max(1, rows // ROWS_PER_TASK)


def fitted(steps: Pipeline, rows: DataFrame, spread: bool = True) -> PipelineModel | TaskForest:
    """The pipeline's model; a margin solver starts from vectors that are made once, a shallow forest on many
    rows is grown by ``spread_forest`` unless its single trees are asked for.

    The solver runs a job or two per iteration. On few rows these cost little but their start: so the vectors
    are checkpointed, packed into as many partitions as the rows call for, and jobs do not carry the steps before.
    """
    stages = steps.getStages()
    forest = stages[-2]
    if spread and isinstance(forest, RandomForestClassifier) and forest.getMaxDepth() <= DEEP and rows.count() > SPREAD_FROM:
        before, labels = Pipeline(stages=stages[:-2]).fit(rows), stages[-1].getLabels()
        return spread_forest.fit(before, rows, KEY, labels, forest.getNumTrees(), forest.getMaxDepth(), forest.getSeed())
    solver = next((i for i, s in enumerate(stages) if isinstance(s, OneVsRest)), None)
    tasks = 0 if solver is None else tasks_for(rows.count())
    if solver is None or tasks > FEW_TASKS:
        return steps.fit(rows)
    prepared, before = rows, []
    for stage in stages[:solver]:
        before.append(stage.fit(prepared) if isinstance(stage, Estimator) else stage)
        prepared = before[-1].transform(prepared)
    ensure_checkpoint_dir(rows.sparkSession)
    vectors = prepared.select("features", "label").coalesce(tasks).checkpoint()
    return PipelineModel(before + Pipeline(stages=stages[solver:]).fit(vectors).stages)


def training_table(
    table: DataFrame,
    labels: list[str],
    per_label: int | None = None,
    test_size: float = 0.2,
    seed: int = 42,
    features: list[str] | None = None,
) -> DataFrame:
    """Balanced, cleaned and split rows of the chosen labels, written once and kept for repeated passes.

    Fits start from the written rows, so their tasks do not carry how the rows were made.
    Solvers run one job per iteration, so rows are packed into as many partitions as their
    number calls for; it is known from the class sizes.
    """
    features = features or FEATURES
    if per_label is None:
        per_label = smallest_class(table, LABEL, labels)
    sampled = balanced_sample(table.select(KEY, LABEL, *features), LABEL, KEY, labels, per_label, seed)
    split = clean_nonfinite(stratified_split(sampled, LABEL, KEY, test_size, seed), features)
    path = new_path(table.sparkSession, "training-rows")
    split.repartition(tasks_for(per_label * len(labels)), KEY).write.parquet(path)
    return table.sparkSession.read.parquet(path).persist()


def _one_vs_rest_scores(model: OneVsRestModel, rows: DataFrame) -> DataFrame:
    """Class with the largest margin, compared as columns instead of by a Python function."""
    margins = []
    for i, single in enumerate(model.models):
        named = single.copy({single.rawPredictionCol: f"_raw_{i}", single.predictionCol: f"_at_{i}"})
        rows = named.transform(rows)
        margins.append(vector_to_array(F.col(f"_raw_{i}"))[1])
    best = F.array_position(F.array(*margins), F.array_max(F.array(*margins))) - 1
    helpers = [f"_{n}_{i}" for n in ("raw", "at") for i in range(len(margins))]
    return rows.withColumn("prediction", best.cast("double")).drop(*helpers)


def grows_in_tasks(steps: Pipeline, rows: DataFrame) -> bool:
    """Whether the pipeline ends in a deep forest and the rows call for ``deep_forest``."""
    forest, (least, most) = steps.getStages()[-2], TASK_FOREST_ROWS
    deep = isinstance(forest, RandomForestClassifier) and forest.getMaxDepth() > DEEP
    return deep and least <= rows.count() <= most


def task_forest(
    steps: Pipeline, rows: DataFrame, used: Column, group: Column, labels: list[str], counts_at: list[int]
) -> tuple[TaskForest, list[tuple]]:
    """The pipeline fitted on the ``used`` rows, its forest grown in tasks; and ``deep_forest.fit``'s counts."""
    *before, forest, _ = steps.getStages()
    ahead = Pipeline(stages=before).fit(rows.where(used))
    settings = forest.getNumTrees(), forest.getMaxDepth(), forest.getSeed()
    return deep_forest.fit(ahead, rows, KEY, used, group, sorted(labels), *settings, counts_at)


def score(model: PipelineModel | TaskForest, rows: DataFrame) -> DataFrame:
    if isinstance(model, TaskForest):
        return model.predicted(rows)
    for stage in model.stages:
        if isinstance(stage, OneVsRestModel):
            rows = _one_vs_rest_scores(stage, rows)
        elif not isinstance(stage, StringIndexerModel):  # scoring needs no true label
            rows = stage.transform(rows)
    return rows


def staged_scores(model: PipelineModel, rows: DataFrame, steps: list[int]) -> DataFrame:
    """Every row once per step with the prediction of the forest's first ``step`` trees.

    Each tree gives its class shares once; they are added up in the order of the trees, as the forest
    itself does, and read off at the steps.
    """
    forest_at = next(i for i, stage in enumerate(model.stages) if hasattr(stage, "trees"))
    for stage in model.stages[:forest_at]:
        rows = rows if isinstance(stage, StringIndexerModel) else stage.transform(rows)
    trees, given = model.stages[forest_at].trees, rows.columns
    total, done = F.array_repeat(F.lit(0.0), model.stages[forest_at].numClasses), 0
    for step in sorted(steps):
        own = [f"_tree_{i}" for i in range(done, step)]
        for name, tree in zip(own, trees[done:step], strict=True):
            rows = tree.copy({tree.rawPredictionCol: "", tree.predictionCol: "", tree.probabilityCol: name}).transform(rows)
        shares = F.array(*[vector_to_array(F.col(name)) for name in own])
        added = F.aggregate(shares, total, lambda acc, share: F.zip_with(acc, share, lambda a, b: a + b))
        rows = rows.withColumn(f"_votes_{step}", added).drop(*own)
        total, done = F.col(f"_votes_{step}"), step
    best = [
        F.struct(
            F.lit(k).cast("long").alias("step"),
            (F.array_position(f"_votes_{k}", F.array_max(f"_votes_{k}")) - 1).cast("double").alias("prediction"),
        )
        for k in steps
    ]
    long = rows.select(*given, F.explode(F.array(*best)).alias("_at")).select(*given, "_at.*")
    return model.stages[-1].transform(long)


def confusion_rows(model: PipelineModel, rows: DataFrame, labels: list[str], *group) -> list[tuple]:
    """Counts per (label, predicted) after ``group``; at most ``len(labels)**2`` of them."""
    counts = confusion_counts(score(model, rows), LABEL, "predicted")
    known = counts.where(F.col(LABEL).isin(labels) & F.col("predicted").isin(labels))
    return [(*group, *row) for row in known.collect()]


def staged_confusion_rows(model: PipelineModel, rows: DataFrame, labels: list[str], steps: list[int], fold: int) -> list[tuple]:
    """Confusion rows of every step from one pass over the rows."""
    scored = staged_scores(model, rows, steps).where(F.col(LABEL).isin(labels) & F.col("predicted").isin(labels))
    counts = scored.groupBy("step", LABEL, "predicted").agg(F.count(F.lit(1)).alias("rows"))
    return [("cv", r["step"], fold, r[LABEL], r["predicted"], r["rows"]) for r in counts.collect()]


def at_once(work: Callable, items, rows: DataFrame) -> list:
    """``work`` for each item from a few threads, so that small fits share the cluster.

    Fits on many ``rows`` fill it by themselves and keep their rows with a count per tree: one after another.
    """
    with ThreadPool(FITS_AT_ONCE if tasks_for(rows.count()) <= FEW_TASKS else 1) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(work), items)


def fold_models(
    folded: DataFrame, build: Callable[[], Pipeline], folds: int, path: str | None = None, spread: bool = True
) -> list[PipelineModel | TaskForest]:
    """One model per fold, fitted on the other folds.

    With ``path``, models found there are loaded, and else written there for the next caller.
    """
    if path and _is_written(folded.sparkSession, path):
        return [load(folded.sparkSession, f"{path}/fold={k}") for k in range(folds)]
    models = at_once(lambda k: fitted(build(), folded.where(F.col("fold") != k), spread), range(folds), folded)
    if path:
        at_once(lambda k: save(models[k], f"{path}/fold={k}"), range(folds), folded)
        folded.sparkSession.range(1).write.parquet(f"{path}/done")
    return models


def fold_counts(
    folded: DataFrame, build: Callable[[], Pipeline], labels: list[str], folds: int, wanted: list[int], path: str | None = None
) -> list[tuple]:
    """(step, fold, true, predicted, rows) of forests grown in tasks, each on the other folds.

    With ``path``, counts found there are used, and else written there for the next caller, at the steps of a curve, too.
    """
    spark, schema = folded.sparkSession, "step long, fold long, true string, said string, rows long"
    if path and _is_written(spark, path):
        found = spark.read.parquet(f"{path}/counts").where(F.col("step").isin(wanted)).collect()
        if {r["step"] for r in found} == set(wanted):
            return [tuple(r) for r in found]
    at = sorted({*wanted, *(checkpoints(max(wanted)) if path else [])})

    def counted(fold: int) -> list[tuple]:
        held_out = F.when(F.col("fold") == fold, 0)
        _, counts = task_forest(build(), folded, F.col("fold") != fold, held_out, labels, at)
        return [(step, fold, *rest) for _, step, *rest in counts]

    rows = [row for part in at_once(counted, range(folds), folded) for row in part]
    if path:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/done")
    return [row for row in rows if row[0] in wanted]


def _is_written(spark: SparkSession, path: str) -> bool:
    try:
        return spark.read.parquet(f"{path}/done").count() == 1
    except AnalysisException:
        return False


def report(spark: SparkSession, counted: list[tuple], labels: list[str]) -> DataFrame:
    """Metrics per (stage, step, fold) of rows made by ``confusion_rows``."""
    schema = f"stage string, step long, fold long, {LABEL} string, predicted string, rows long"
    confusion = spark.createDataFrame(counted, schema)
    return classification_metrics(confusion, labels, LABEL, "predicted", ["stage", "step", "fold"])


@dataclass
class Trained:
    model: PipelineModel | TaskForest
    features: list[str]
    metrics: DataFrame
    data: DataFrame


def cross_validate(
    train: DataFrame, build: Callable[[], Pipeline], labels: list[str], folds: int, seed: int, step: int = 0,
    trees: list[int] | None = None, path: str | None = None,
) -> list[tuple]:
    """Confusion rows of every fold, each scored by a model that never saw it.

    With ``trees``, the model is a forest and each of these numbers of its first trees is a step.
    With ``path`` the fold models are shared (see ``fold_models``).
    """
    packed = train.rdd.getNumPartitions()
    folded = kfold_assign(train, LABEL, KEY, folds, seed).repartition(packed, KEY).persist()
    if grows_in_tasks(build(), train):
        wanted = trees or [build().getStages()[-2].getNumTrees()]
        rows = fold_counts(folded, build, labels, folds, wanted, path)
        folded.unpersist()
        return [("cv", at if trees else step, *rest) for at, *rest in rows]
    models = fold_models(folded, build, folds, path, spread=not trees)

    def counted(fold: int) -> list[tuple]:
        held_out = folded.where(F.col("fold") == fold)
        if trees:
            return staged_confusion_rows(models[fold], held_out, labels, trees, fold)
        return confusion_rows(models[fold], held_out, labels, "cv", step, fold)

    rows = [row for part in at_once(counted, range(folds), folded) for row in part]
    folded.unpersist()
    return rows


def train(
    table: DataFrame,
    labels: list[str],
    classifier: Estimator,
    per_label: int | None = None,
    test_size: float = 0.2,
    folds: int = 5,
    strategy: str = "median",
    seed: int = 42,
    features: list[str] | None = None,
    path: str | None = None,
) -> Trained:
    """Cross-validates on the train rows, fits on all of them and reports train and test."""
    data = training_table(table, labels, per_label, test_size, seed, features)
    train_rows, test_rows = (data.where(F.col("split") == s) for s in ("train", "test"))
    used = usable_features(train_rows, features or FEATURES)

    def build() -> Pipeline:
        return pipeline(classifier, used, labels, strategy)

    def whole() -> tuple[PipelineModel | TaskForest, list[tuple]]:
        steps = build()
        if not grows_in_tasks(steps, train_rows):
            return fitted(steps, train_rows), []
        split, trees = F.col("split"), steps.getStages()[-2].getNumTrees()
        group = F.when(split == "train", 0).when(split == "test", 1)
        model, counts = task_forest(steps, data, split == "train", group, labels, [trees])
        return model, [(("train", "test")[at], 0, 0, *rest) for at, _, *rest in counts]

    counted, (model, own) = at_once(
        lambda work: work(),
        [
            lambda: cross_validate(train_rows, build, labels, folds, seed, path=path) if folds > 1 else [],
            whole,
        ],
        train_rows,
    )
    counted += own or [
        row
        for name, rows in (("train", train_rows), ("test", test_rows))
        for row in confusion_rows(model, rows, labels, name, 0, 0)
    ]
    data.unpersist()
    scores = report(table.sparkSession, counted, labels)
    averaged = scores.groupBy("stage", "scope", "metric").agg(F.avg("value").alias("value"))
    return Trained(model, used, metrics_long(averaged, F.col("stage"), F.lit(0)), data)


def checkpoints(highest: int, points: int = 20) -> list[int]:
    """Increasing whole numbers from 1 to ``highest``, evenly spread."""
    if highest <= 0:
        return [1]
    count = min(points, highest)
    if count == 1:
        return [1]
    return sorted({round(1 + (highest - 1) * i / (count - 1)) for i in range(count)})


def learning_curve(
    table: DataFrame,
    labels: list[str],
    classifier_at: Callable[[int], Estimator],
    steps: list[int],
    folds: int = 5,
    seed: int = 42,
    features: list[str] | None = None,
    path: str | None = None,
) -> DataFrame:
    """Fold-averaged accuracy and macro scores per number of iterations or trees.

    A forest is fitted once per fold with the most trees; a smaller step scores its first trees.
    """
    kept_rows = training_table(table, labels, None, 0.2, seed, features)
    data = kept_rows.where(F.col("split") == "train")
    used = usable_features(data, features or FEATURES)
    largest = classifier_at(max(steps))
    if isinstance(largest, RandomForestClassifier):
        counted = cross_validate(data, lambda: pipeline(largest, used, labels), labels, folds, seed, trees=steps, path=path)
        steps = []
    else:
        counted = []
    for step in steps:
        def build(step: int = step) -> Pipeline:
            return pipeline(classifier_at(step), used, labels)

        counted += cross_validate(data, build, labels, folds, seed, step)
    kept_rows.unpersist()
    scores = report(table.sparkSession, counted, labels)
    kept = scores.where((F.col("scope") == "macro_avg") | (F.col("metric") == "accuracy"))
    return kept.groupBy("step", "scope", "metric").agg(F.avg("value").alias("value"))


def objective_history(
    table: DataFrame, labels: tuple[str, str], max_iterations: int = 20, seed: int = 42
) -> DataFrame:
    """Objective per iteration of a two-class linear SVM."""
    rows = training_table(table, list(labels), None, 0.2, seed)
    data = rows.where(F.col("split") == "train")
    used = usable_features(data, FEATURES)
    fitted = pipeline(LinearSVC(labelCol="label", maxIter=max_iterations, regParam=0.0), used, list(labels)).fit(data)
    history = fitted.stages[4].summary().objectiveHistory
    rows.unpersist()
    return table.sparkSession.createDataFrame(
        [(i, float(v)) for i, v in enumerate(history)], "iteration long, objective double"
    )


def save(model: PipelineModel | TaskForest, path: str) -> None:
    if isinstance(model, TaskForest):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load(spark: SparkSession, path: str) -> PipelineModel | TaskForest:
    try:
        spark.read.text(f"{path}/facts")
    except AnalysisException:
        return PipelineModel.load(path)
    return TaskForest.load(path)


def apply_saved(path: str, rows: DataFrame, features: list[str]) -> DataFrame:
    """Predicted label for stored trajectories by a saved model."""
    return score(load(rows.sparkSession, path), clean_nonfinite(rows, features)).select(*rows.columns, "predicted")
