"""Registered training runs with the reference's settings; forest curves score the first trees."""

import time
from datetime import datetime

from pyspark.sql import functions as F

from wakefold.ml import trainers
from wakefold.plans import tables, training


def test_registered_training_is_whole(spark, monkeypatch):
    class Kept:
        model, features, metrics = None, [], None

    seen = {}

    def record(name):
        def train(table, labels, classifier, folds=5, path=None):
            inner = classifier.getClassifier() if hasattr(classifier, "getClassifier") else classifier
            kinds = ("numTrees", "maxDepth", "maxIter")
            seen[name] = (folds, *[inner.getOrDefault(k) for k in kinds if inner.hasParam(k)])
            return Kept

        def curve(table, labels, classifier_at, steps, folds=5, path=None):
            train(table, labels, classifier_at(steps[-1]), folds)
            seen[name] += (len(steps), steps[-1])

        monkeypatch.setattr(trainers, "train", train)
        monkeypatch.setattr(trainers, "learning_curve", curve)
        getattr(training, name)(None)

    monkeypatch.setattr(training, "_table", lambda t: None)
    monkeypatch.setattr(training, "_fold_path", lambda t: None)
    for name in ("svm_loitering_transshipment", "rf_loitering_transshipment", "rf_loitering_stopping",
                 "rf_multiclass", "svm_multiclass", "train_test_report", "learning_curve"):
        record(name)
    assert seen == {
        "svm_loitering_transshipment": (5, 20), "svm_multiclass": (5, 1000),
        "rf_loitering_transshipment": (5, 200, 30), "rf_loitering_stopping": (5, 100, 5),
        "rf_multiclass": (5, 100, 5), "train_test_report": (0, 100, 5), "learning_curve": (5, 200, 30, 20, 200),
    }


def test_forest_curve_scores_the_first_trees(spark, monkeypatch):
    rows = [(f"{label}{i}", label, float((i * 7) % 23 + (6 if label == "A" else 0)), float(i % 5)) for label in "AB" for i in range(60)]
    table = spark.createDataFrame(rows, "row_key string, behavior_type_label string, x double, y double")
    labels, features = ["A", "B"], ["x", "y"]
    model = trainers.pipeline(trainers.forest(6, 30), features, labels).fit(table)
    staged = trainers.staged_scores(model, table, [1, 4, 6])
    at = {k: {r["row_key"]: r["predicted"] for r in staged.where(F.col("step") == k).collect()} for k in (1, 6)}
    assert at[6] == {r["row_key"]: r["predicted"] for r in trainers.score(model, table).collect()}
    assert staged.count() == 3 * table.count()
    prepared = table
    for stage in (model.stages[0], model.stages[1], model.stages[2]):
        prepared = stage.transform(prepared)
    first = model.stages[4].trees[0].transform(prepared)
    assert at[1] == {r["row_key"]: labels[int(r["prediction"])] for r in first.collect()}
    fits = []
    fit = trainers.Pipeline.fit
    monkeypatch.setattr(trainers.Pipeline, "fit", lambda self, *a: fits.append(1) or fit(self, *a))
    curve = trainers.learning_curve(table, labels, trainers.forest, [1, 3, 6], 2, features=features)
    assert {r["step"] for r in curve.collect()} == {1, 3, 6} and len(fits) == 2


def test_fold_models_are_fitted_once_and_shared(spark, monkeypatch, tmp_path):
    rows = [(f"{label}{i}", label, float((i * 7) % 23 + (6 if label == "A" else 0)), float(i % 5)) for label in "AB" for i in range(60)]
    table = spark.createDataFrame(rows, "row_key string, behavior_type_label string, x double, y double")
    labels, features, path = ["A", "B"], ["x", "y"], str(tmp_path / "folds")
    fits = []
    fit = trainers.Pipeline.fit
    monkeypatch.setattr(trainers.Pipeline, "fit", lambda self, *a: fits.append(1) or fit(self, *a))
    trained = trainers.train(table, labels, trainers.forest(6, 30), folds=3, features=features, path=path)
    curve = trainers.learning_curve(table, labels, lambda k: trainers.forest(k, 30), [2, 6], 3, features=features, path=path)
    assert len(fits) == 4
    mean = {(r["scope"], r["metric"]): r["value"] for r in curve.where("step = 6").collect()}
    whole = {r["metric"]: r["value"] for r in trained.metrics.collect()}
    assert mean and any(abs(v - w) < 1e-9 for v in mean.values() for w in whole.values())


def _labelled(spark, labels):
    rows = [(f"{label}{i}", label, float((i * 7) % 23 + 3 * n), float((i + n) % 5)) for n, label in enumerate(labels) for i in range(60)]
    return spark.createDataFrame(rows, "row_key string, behavior_type_label string, x double, y double")


def test_solver_starts_from_packed_vectors(spark, monkeypatch):
    labels, features = ["A", "B", "C"], ["x", "y"]
    table = _labelled(spark, labels).repartition(4, "row_key").persist()
    seen = []
    fit = trainers.OneVsRest.fit
    monkeypatch.setattr(trainers.OneVsRest, "fit", lambda self, rows, *a: seen.append(rows) or fit(self, rows, *a))
    build = trainers.pipeline(trainers.svm(5, 0.1), features, labels)
    trainers.fitted(build, table)
    assert seen[0].columns == ["features", "label"] and seen[0].rdd.getNumPartitions() == 1
    table = table.coalesce(1).persist()
    model, plain = trainers.fitted(build, table), build.fit(table)
    packed, whole = (
        {r["row_key"]: r["predicted"] for r in trainers.score(m, table).collect()} for m in (model, plain)
    )
    assert packed == whole and len(model.stages) == len(plain.stages)


def test_large_fits_run_one_after_another(spark, monkeypatch):
    table = _labelled(spark, ["A", "B"])
    running, most = [], []

    def work(k):
        running.append(k)
        most.append(len(running))
        time.sleep(0.1)
        running.remove(k)
        return k

    assert trainers.at_once(work, range(4), table) == [0, 1, 2, 3] and max(most) > 1
    most.clear()
    monkeypatch.setattr(trainers, "ROWS_PER_TASK", 10)
    assert trainers.at_once(work, range(4), table) == [0, 1, 2, 3] and max(most) == 1


def test_training_rows_need_no_arrays(spark, monkeypatch, tmp_path):
    folder, kinds = str(tmp_path), ["view", "click", "signup", "error", "purchase"]
    rows = [(i if i % 17 else None, datetime(2024, 1, 1 + i // 24, i % 24), i % 5, kinds[i * 7 % 5], float(i % 11), f'{{"k": {i % 100}}}') for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(f"{folder}/events.parquet")
    monkeypatch.setattr(tables, "_stored", {})
    monkeypatch.setattr(tables, "_features", {})
    alone = training._table(tables.Tables(spark, folder))
    assert tables._features and not tables._stored
    assert tables.Tables(spark, folder).stored.count() == alone.count() > 100
    beside = training._table(tables.Tables(spark, folder))
    assert "trajectories-" in beside.inputFiles()[0] and "trajectory-features-" in alone.inputFiles()[0]
    assert sorted(map(tuple, alone.collect()), key=str) == sorted(map(tuple, beside.collect()), key=str)
