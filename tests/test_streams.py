"""The streamed windows against the batch ones: late rows, restarts, edges, missing values."""

import random

import pytest
from compare import compare, oracle_connection
from pyspark.sql import functions as F

from wakefold.operators import cells
from wakefold.plans import registry
from wakefold.streaming.loitering import run_available, window_stream

SCHEMA = "id string, ts_s long, lon double, lat double, sog double, cog double, event_index long, pos long"
SIZE, STEP, START = 200, 100, 1000


def _points():
    rnd, rows = random.Random(4), []
    for i in range(300):
        miss = rnd.random()
        ts = rnd.choice([rnd.randrange(900, 2500), rnd.randrange(9, 25) * 100])
        rows.append((
            f"v{i % 4}", ts, None if miss < 0.1 else rnd.uniform(0, 1), rnd.uniform(40, 41),
            None if miss > 0.97 else rnd.uniform(0, 9), None if miss > 0.99 else rnd.uniform(0, 360), 0, i,
        ))
    return sorted(rows, key=lambda r: r[1])


def _deliver(spark, rows, source, out, state):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(SCHEMA).parquet(source)
    run_available(window_stream(arriving, START, SIZE, STEP, "50 seconds"), out, state)


def _rows(frame):
    return {(r["id"], r["window_index"]): r for r in frame.collect()}


def _same(got, want):
    assert got.keys() == want.keys() and got
    for key, row in got.items():
        for name in ("n_points", "path_km", "sum_sog", "sum_cog_delta", "min_lon", "max_lat", "window_end_s"):
            a, b = row[name], want[key][name]
            assert a == (pytest.approx(b, abs=1e-9) if isinstance(b, float) else b), (key, name)


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    rows = _points()
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    parts = [rows[:80], rows[80:160], rows[160:240], rows[240:]]
    for k, part in enumerate(parts):
        # The last delivery also holds a row far behind the watermark of the ones before.
        late = [("v0", 950 + START // 10, 0.5, 40.5, 1.0, 1.0, 0, 9999)] if k == 3 else []
        _deliver(spark, part + late, source, out, state)
        if k == 2:
            early = _rows(spark.read.parquet(out))
    closed = (F.col("window_end_s") + STEP) <= max(r[1] for r in rows) - 50
    batch = cells.window_geometry(spark.createDataFrame(rows, SCHEMA), ["id"], F.lit(START), SIZE, STEP)
    got = spark.read.parquet(out)
    assert got.count() == got.dropDuplicates(["id", "window_index"]).count()
    _same(_rows(got), _rows(batch.where(closed)))
    assert early and early.items() <= _rows(got).items()


def test_restart_without_new_files_adds_nothing(spark, tmp_path):
    rows = _points()
    whole, cut = ([str(tmp_path / f"{n}{x}") for x in ("in", "out", "state")] for n in "ab")
    _deliver(spark, rows, *whole)
    for part in (rows[:100], rows[100:101], rows[101:]):
        _deliver(spark, part, *cut)
    arriving = spark.readStream.schema(SCHEMA).parquet(cut[0])
    run_available(window_stream(arriving, START, SIZE, STEP, "50 seconds"), *cut[1:])
    _same(_rows(spark.read.parquet(whole[1])), _rows(spark.read.parquet(cut[1])))


def test_rows_without_id_or_time_are_left_out(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("in", "out", "state")]
    rows = [(None, 1100, 0.0, 40.0, 1.0, 1.0, 0, 1), ("a", None, 0.0, 40.0, 1.0, 1.0, 0, 2), ("a", 1150, 0.0, 40.0, 1.0, 1.0, 0, 3), ("b", 9000, 0.0, 40.0, 1.0, 1.0, 0, 4)]
    _deliver(spark, rows, *paths)
    assert {(r["id"], r["n_points"]) for r in spark.read.parquet(paths[1]).collect()} == {("a", 1)}


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.001"
    frame = registry.queries()["stream_loitering"](spark, folder)
    assert frame.count() > 50
    assert compare(frame, oracle_connection(folder), registry.oracle_sql()["stream_loitering"]) == []
