"""The stored snapshot: files of untouched buckets, counts, repeats, whole trajectories."""

import os

import pytest
from pyspark.sql import functions as F

from wakefold.operators import upsert
from wakefold.sources import snapshots

KEYS, BUCKETS = upsert.TRAJECTORY_KEYS, 8
SCHEMA = "mmsi string, event_index long, behavior_type_label string, part int, trajectory string, revision int, value double"
LINE = "LINESTRING(1 2, 3 4)"


def _files(path):
    return {
        (folder, name): os.path.getmtime(os.path.join(root, name))
        for root, _, names in os.walk(path)
        for name in names
        if name.endswith(".parquet") and (folder := os.path.basename(root))
    }


def _apply(spark, path, rows):
    updates = spark.createDataFrame(rows, SCHEMA)
    reason = upsert.reject_reason(updates.columns)
    return snapshots.apply(spark, path, KEYS, updates, reason, [F.desc("revision")], BUCKETS)


def _read(spark, path):
    return sorted((r["mmsi"], r["part"], r["revision"], r["value"]) for r in snapshots.read(spark, path).collect())


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    old = [(f"m{i}", i, "A", p, LINE, 0, 0.0) for i in range(60) for p in range(2)]
    snapshots.create(spark.createDataFrame(old, SCHEMA), path, KEYS, BUCKETS)
    before = _files(path)
    rows = [
        ("m1", 1, "A", 0, LINE, 1, 1.0), ("m1", 1, "A", 0, LINE, 2, 2.0), ("m1", 1, "A", 1, "LINESTRING(1 2)", 2, 2.5), ("m1", 1, "A", 2, LINE, 2, 2.7),
        ("m2", 2, "A", 0, "LINESTRING(1 2)", 1, 9.0), ("m2", 2, "A", 1, LINE, 1, 9.0),
        (None, 3, "A", 0, LINE, 1, 9.0), ("m4", 4, "A", 1, LINE, 1, 9.0),
    ]
    counts = _apply(spark, path, rows)
    assert counts == {"processed": 4, "upserted": 1, "rejected": 2}
    got = _read(spark, path)
    assert [r for r in got if r[0] == "m1"] == [("m1", 0, 2, 2.0), ("m1", 1, 2, 2.5), ("m1", 2, 2, 2.7)]
    assert len(got) == 121 and {r for r in got if r[0] in ("m2", "m4")} == {(m, p, 0, 0.0) for m in ("m2", "m4") for p in (0, 1)}
    after = _files(path)
    changed = {folder for folder, _ in before.items() ^ after.items() for folder in [folder[0]]}
    assert len(changed) == 1
    assert _apply(spark, path, rows) == counts and _read(spark, path) == got
    same = _files(path)
    assert _apply(spark, path, [r for r in rows if r[0] in (None, "m2")])["upserted"] == 0 and _files(path) == same


def test_new_keys_and_missing_columns(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    snapshots.create(spark.createDataFrame([("a", 1, "A", 0, LINE, 0, 0.0)], SCHEMA), path, KEYS, BUCKETS)
    updates = spark.createDataFrame([("b", 2, "B", 0, LINE, 1, 3.0)], SCHEMA).drop("value").withColumn("other", F.lit(1))
    counts = snapshots.apply(spark, path, KEYS, updates, upsert.reject_reason(updates.columns), [F.desc("revision")], BUCKETS)
    assert counts == {"processed": 1, "upserted": 1, "rejected": 0}
    assert _read(spark, path) == [("a", 0, 0, 0.0), ("b", 0, 1, None)]


def test_a_rejected_trajectory_loses_all_its_parts(spark):
    rows = [("a", 1, "A", 0, None, 0, 0.0), ("a", 1, "A", 1, LINE, 0, 0.0), ("b", 1, "A", 0, LINE, 0, 0.0), ("b", 1, "A", 1, None, 0, 0.0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r["mmsi"], r["part"]) for r in upsert.valid_trajectories(frame).collect()) == [("b", 0), ("b", 1)]
    assert [(r["mmsi"], r["reason"]) for r in upsert.rejected(frame).collect()] == [("a", "trajectory")] * 2
    with pytest.raises(ValueError):
        upsert.upsert(frame, frame.drop("mmsi"), KEYS, [])
