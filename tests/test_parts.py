"""Text forms, time, joins, upserts, sampling, sources and images on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakefold import schemas
from wakefold.functions import textual, timefmt
from wakefold.ml import trainers
from wakefold.operators import joins, labels, profiling, raster, sampling, upsert
from wakefold.sources import ranges, readers, shared, writers


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [
    ("['X', 'Y']", "X"), ('["X"]', "X"), ("'X'", "X"), (" X ", "X"), ("[]", None), ("", None), (None, None), ("[3, 4]", "3"),
])
def test_first_scalar(spark, text, want):
    assert one(spark, textual.first_scalar, text) == want


@pytest.mark.parametrize("text,want", [
    ("[1, 2]", "[1, 2]"), ("5", "[5]"), ("null", "[null]"), ("a b", '["a b"]'), (None, "[]"), ('{"k": 1}', '[{"k": 1}]'),
    ('1,"x":2', '["1,\\"x\\":2"]'),
])
def test_json_array(spark, text, want):
    assert one(spark, textual.json_array, text) == want


def test_array_text_round_trip(spark):
    text = one(spark, textual.array_text, [1.5, None, 2.0], "array<double>")
    assert text == "[1.5, None, 2.0]"
    assert one(spark, textual.text_cells, text) == ["1.5", None, "2.0"]
    assert one(spark, textual.text_cells, "[]") == []


def test_wkt_accepts_points_and_blanks(spark):
    got = one(spark, textual.wkt_points, " linestring(POINT( 1  2 ),  3 4 , x y)")
    assert [tuple(p) for p in got] == [(1.0, 2.0), (3.0, 4.0), (None, None)]
    assert one(spark, textual.wkt_points, "LINESTRING()") == []


@pytest.mark.parametrize("wkt,want", [("LINESTRING(1 2, 3 4)", True), ("LINESTRING(1 2)", False), (None, False)])
def test_valid_linestring(spark, wkt, want):
    assert one(spark, textual.is_valid_linestring, wkt) is want


def test_relative_seconds_wraps_midnight(spark):
    cells = [None, "2024-01-01 23:59:50", "2024-01-02 00:00:05", "junk", "86395"]
    assert one(spark, timefmt.relative_seconds, cells, "array<string>") == [None, 0, 15, None, 5]
    assert one(spark, timefmt.relative_seconds, ["junk"], "array<string>") == []


def test_canonical_datetime():
    assert timefmt.canonical_datetime("2024-01-02T03:04:05.678") == "2024-01-02 03:04:05"
    with pytest.raises(ValueError):
        timefmt.canonical_datetime("yesterday")


def test_safe_names():
    assert textual.safe_names(["a", "", "7", "a", None]) == ["a", "col_1", "col_2", "a_3", "col_4"]
    assert textual.safe_names(["a-b", "4x"], strict=True) == ["a_b", "c_4x"]


def test_interval_join_equals_plain_join(spark):
    rnd = random.Random(1)
    points = [(f"v{rnd.randrange(4)}", rnd.randrange(-500, 1000), i) for i in range(300)]
    events = [(i, f"v{rnd.randrange(4)}", s, s + rnd.randrange(-20, 300)) for i, s in enumerate(rnd.randrange(-600, 900) for _ in range(60))]
    p = spark.createDataFrame(points, "id string, ts long, pos_key long")
    e = spark.createDataFrame(events, "event_index long, id string, from_ms long, to_ms long")
    want = {(ev[0], pt[2]) for ev in events for pt in points if ev[1] == pt[0] and ev[2] <= pt[1] <= ev[3]}
    rows = [(r["event_index"], r["pos_key"]) for r in joins.interval_join(p, e).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert joins.interval_join(p, e.limit(0)).count() == 0


def test_long_events_do_not_make_short_ones_coarse(spark):
    """990 events of a minute and 10 of thirty days, a point each ten minutes: few pairs beyond the results."""
    minute, day, rnd = 60_000, 86_400_000, random.Random(2)
    events = [(i, "v", (s := rnd.randrange(0, 60 * day)), s + minute) for i in range(990)]
    events += [(1000 + i, "v", (s := rnd.randrange(0, 30 * day)), s + 30 * day) for i in range(10)]
    p = spark.range(0, 60 * 144).select(F.lit("v").alias("id"), (F.col("id") * 600_000 + 7).alias("ts"))
    e = spark.createDataFrame(events, "event_index long, id string, from_ms long, to_ms long")
    met, kept = joins.interval_candidates(p, e).count(), joins.interval_join(p, e).count()
    assert 43_000 < kept <= met < 3 * kept


def test_pair_events_skip_missing_partner(spark):
    events = spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "event_index long, MMSI string, MMSI_2 string")
    assert sorted((r["event_index"], r["id"]) for r in joins.pair_events(events).collect()) == [(1, "a"), (1, "b"), (2, "c")]


def test_cover_else_within_brute_force(spark):
    rnd = random.Random(8)
    spans = [(i, rnd.choice("ab"), s, s + rnd.randrange(0, 40_000), rnd.randrange(1, 9)) for i, s in enumerate(rnd.randrange(0, 100_000) for _ in range(80))]
    asks = [(i, rnd.choice("ab"), s, s + rnd.randrange(0, 60_000)) for i, s in enumerate(rnd.randrange(0, 100_000) for _ in range(50))]
    t = spark.createDataFrame(spans, "event_index long, id string, traj_start_ms long, traj_end_ms long, n_points long")
    r = spark.createDataFrame(asks, "request_id long, id string, from_ms long, to_ms long")
    got = {(x["request_id"], x["event_index"], x["is_covering"]) for x in joins.cover_else_within(t, r).collect()}
    want = set()
    for rid, v, a, b in asks:
        covering = [s for s in spans if s[1] == v and s[2] <= a and s[3] >= b]
        if covering:
            best = min(covering, key=lambda s: (s[3] // 1000 - s[2] // 1000, s[4], s[0]))
            want.add((rid, best[0], True))
        else:
            want |= {(rid, s[0], False) for s in spans if s[1] == v and s[2] >= a and s[3] <= b}
    assert got == want


@pytest.mark.parametrize("top,length", [(40, 40), (3000, 900), (10**6, 10**6)])
def test_smallest_cover_is_found_without_pairs(spark, top, length):
    rnd = random.Random(top)
    spans = [(i, rnd.choice("ab"), s, s + rnd.randrange(0, length), rnd.choice([None, 1, 2])) for i, s in enumerate(rnd.randrange(-top, top) for _ in range(300))]
    asks = [(i, rnd.choice("abc"), s, s + rnd.randrange(0, length // 2)) for i, s in enumerate(rnd.randrange(-top, top) for _ in range(300))]
    t = spark.createDataFrame(spans, "event_index long, id string, traj_start_ms long, traj_end_ms long, n_points long")
    r = spark.createDataFrame(asks, "request_id long, id string, from_ms long, to_ms long")
    found = joins.covering_trajectory(t, r)
    got = {(x["request_id"], x["event_index"]) for x in found.collect()}
    want = set()
    for rid, v, a, b in asks:
        covering = [s for s in spans if s[1] == v and s[2] <= a and s[3] >= b]
        if covering:
            length_s = lambda s: int(s[3] / 1000) - int(s[2] / 1000)
            want.add((rid, min(covering, key=lambda s: (length_s(s), s[4] or 2**62, s[0]))[0]))
    assert got == want and len(want) > 50
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "_from" in plan.split("Join Inner")[1]  # with one row per node only
    assert joins.covering_trajectory(t.limit(0), r).count() == 0


def _spans_and_requests(spark, day=86_400_000):
    spans = [(i, "v", i * 1000, i * 1000 + day, 1) for i in range(200)]
    asks = [(i, "v", i * 500, i * 500 + length) for i, length in enumerate([60_000, 600_000, 3_600_000, 2 * day] * 5)]
    t = spark.createDataFrame(spans, "event_index long, id string, traj_start_ms long, traj_end_ms long, n_points long")
    return t, spark.createDataFrame(asks, "request_id long, id string, from_ms long, to_ms long")


def test_long_trajectories_skip_classes_of_short_requests(spark, monkeypatch):
    t, r = _spans_and_requests(spark)
    met, candidates = [], joins.interval_candidates
    monkeypatch.setattr(joins, "interval_candidates", lambda *a: met.append(candidates(*a)) or met[-1])
    got = {(x["request_id"], x["event_index"]) for x in joins.within_trajectories(t, r).collect()}
    spans, asks = t.collect(), r.collect()
    assert got == {(a[0], s[0]) for a in asks for s in spans if s[2] >= a[2] and s[3] <= a[3]} and got
    assert met[0].select("_level").distinct().count() == 1


def test_covering_rows_are_dealt_before_they_are_repeated(spark):
    t, r = _spans_and_requests(spark)
    found = joins.covering_trajectory(t, r)
    plan = found._jdf.queryExecution().executedPlan().toString()
    window, dealt = plan.index("Window"), plan.index("Exchange hashpartitioning(id", plan.index("Window"))
    assert "Generate explode" in plan[window:dealt]


def test_event_index_is_gapless_with_frequent_values(spark):
    rows = [(7 if i % 3 == 0 else i, f"m{i % 5}", i) for i in range(500)]
    frame = spark.createDataFrame(rows, "T_start long, MMSI string, key long").repartition(6)
    numbered = labels.assign_event_index(frame, ["T_start", "MMSI", "key"]).collect()
    want = {r[2]: i + 1 for i, r in enumerate(sorted(rows))}
    assert {r["key"]: r["event_index"] for r in numbered} == want


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0)], "k string, e long, v double")
    updates = spark.createDataFrame([("b", 2, 5.0, 1), ("b", 2, 6.0, 2), ("c", 3, 7.0, 1)], "k string, e long, v double, at int")
    once = upsert.upsert(target, updates, ["k", "e"], [F.desc("at")])
    twice = upsert.upsert(once, updates, ["k", "e"], [F.desc("at")])
    want = [("a", 1, 1.0), ("b", 2, 6.0), ("c", 3, 7.0)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, twice.collect())) == want
    with pytest.raises(ValueError):
        upsert.upsert(target, updates.drop("e"), ["k", "e"], [])


def test_trajectory_updates_accept_both_names(spark):
    rows = [("a", 1, "NORMAL", "LINESTRING(1 2, 3 4)"), ("b", 2, "NORMAL", "LINESTRING(1 2)"), (None, 3, "NORMAL", "LINESTRING(1 2, 3 4)")]
    frame = spark.createDataFrame(rows, "id string, EventIndex long, behavior_type_label string, trajectory string")
    assert [r["event_index"] for r in upsert.valid_trajectories(frame).collect()] == [1]


def test_split_and_folds_partition_the_rows(spark):
    rows = [(f"k{i}", "A" if i % 4 else "B") for i in range(403)]
    frame = spark.createDataFrame(rows, "row_key string, label string")
    split = sampling.stratified_split(frame, "label", "row_key", 0.28).groupBy("label", "split").count()
    counts = {(r["label"], r["split"]): r["count"] for r in split.collect()}
    for label in "AB":
        total = sum(1 for r in rows if r[1] == label)
        assert counts[(label, "train")] == int((1 - 0.28) * total)
        assert counts[(label, "train")] + counts[(label, "test")] == total
    folds = sampling.kfold_assign(frame, "label", "row_key", 5).groupBy("label", "fold").count().collect()
    for label in "AB":
        sizes = [r["count"] for r in folds if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    sample = sampling.balanced_sample(frame, "label", "row_key", ["A", "B"], 50)
    assert {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()} == {"A": 50, "B": 50}
    with pytest.raises(ValueError):
        sampling.balanced_sample(frame, "label", "row_key", ["A", "B"], 5000)


def test_sample_does_not_depend_on_partitions(spark):
    frame = spark.range(1000).select(F.col("id").cast("string").alias("row_key"), F.lit("A").alias("label"))
    few = sampling.rank_by_hash(frame.repartition(2), "label", "row_key", 1, first=37).collect()
    many = sampling.rank_by_hash(frame.repartition(9), "label", "row_key", 1, first=37).collect()
    assert {r["row_key"] for r in few} == {r["row_key"] for r in many} and len(few) == 37


def test_metrics_with_absent_class_and_foreign_labels(spark):
    confusion = spark.createDataFrame([("A", "A", 3), ("A", "B", 1), ("B", "Z", 9)], "label string, prediction string, rows long")
    got = {(r["scope"], r["metric"]): r["value"] for r in profiling.classification_metrics(confusion, ["A", "B", "C"]).collect()}
    assert got[("A", "precision")] == 1.0 and got[("A", "recall")] == 0.75
    assert got[("C", "f1")] == 0.0 and got[("B", "support")] == 0.0
    assert got[("overall", "accuracy")] == 0.75 and got[("overall", "total_samples")] == 4.0
    assert got[("macro_avg", "precision")] == pytest.approx(1 / 3)


def test_empty_frames_keep_their_schema(spark):
    for schema in (schemas.TRAJECTORY, schemas.WINDOW_BLOCK, schemas.AIS_FILE):
        frame = schemas.empty(spark, schema)
        assert frame.schema == schema and frame.count() == 0


def test_jdbc_options():
    whole = ranges.jdbc_options("jdbc:x", "s.t", "d")
    assert whole["dbtable"] == "(SELECT * FROM s.t) AS src" and "numPartitions" not in whole
    part = ranges.jdbc_options("jdbc:x", "s.t", "d", ["a"], "a > 1", "pk", (1, 9), 600)
    assert part["dbtable"] == '(SELECT "a", "pk" FROM s.t WHERE a > 1) AS src'
    assert part["numPartitions"] == "1000" and part["lowerBound"] == "1"
    assert ranges.range_count(1) == 8


def test_positions_accept_other_spellings(spark):
    frame = spark.createDataFrame([("7", "1000", 1.0)], "` Id` string, timestamp string, ` longitude ` double")
    row = readers.normalize_positions(frame).first()
    assert (row["id"], row["ts"], row["longitude"], row["latitude"]) == ("7", 1000, 1.0, None)
    kinds = dict(readers.normalize_positions(frame).dtypes)
    assert kinds["turn"] == "double" and kinds["annotation"] == "string"


def test_rejects_do_not_depend_on_selected_columns(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b\n1,2\nx,3\n4,5,6\n7,\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    good, bad = readers.read_with_rejects(spark, str(tmp_path / "f.csv"), schema)
    assert sorted((r["a"], r["b"]) for r in good.collect()) == [(1, 2), (7, None)]
    assert sorted(r["b"] for r in bad.select("b").collect()) == [3, 5]
    assert good.select("b").count() == 2


class FakeSession:
    """The two settings a session offers, with a cluster master."""

    def __init__(self, configured=None, checkpoint=None):
        self.conf = self.sparkContext = self
        self.configured, self.checkpoint, self.master = configured, checkpoint, "spark://host:7077"

    def get(self, key, default):
        return self.configured if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return self.checkpoint


def test_shared_folder_comes_from_the_session():
    assert shared.shared_root(FakeSession("hdfs://a/b/")) == "hdfs://a/b"
    assert shared.shared_root(FakeSession(None, "hdfs://c")) == "hdfs://c"
    with pytest.raises(RuntimeError):
        shared.shared_root(FakeSession())


def test_bucketed_write_keeps_all_rows(spark):
    path = shared.new_path(spark, "test-buckets")
    frame = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    writers.write_bucketed(frame, path, "k", 7)
    back = spark.read.parquet(path)
    assert back.count() == 1000
    assert back.groupBy("k").agg(F.count_distinct("bucket").alias("n")).agg(F.max("n")).first()[0] == 1


def draw(spark, points, resolution=120):
    frame = spark.createDataFrame(points, "k string, ts long, lon double, lat double, sog double, cog double, pos_key long")
    return raster.trajectory_raster(frame, ["k"], [resolution])


def test_line_fills_the_padded_image(spark):
    pixels = draw(spark, [("a", 1, 0.0, 0.0, 1.0, 1.0, 1), ("a", 2, 1.0, 1.0, 1.0, 1.0, 2)])
    cells = {(r["row"], r["col"]): r["grey"] for r in pixels.collect()}
    assert min(c for _, c in cells) == 3 and max(c for _, c in cells) in (115, 116, 117)
    assert all(abs(119 - r - c) <= 2 for r, c in cells)  # rising diagonal
    matrix = raster.dense_matrices(pixels, ["k"]).first()["matrix"]
    assert len(matrix) == 120 and {len(line) for line in matrix} == {120}
    assert all(matrix[r][c] == cells.get((r, c), 255) for r in range(120) for c in range(120))


def test_single_point_is_a_disc(spark):
    cells = {(r["row"], r["col"]) for r in draw(spark, [("a", 1, 5.0, 5.0, 1.0, 1.0, 1)]).collect()}
    assert (60, 60) in cells and (57, 57) not in cells and len(cells) > 9


def test_checkpoints():
    assert trainers.checkpoints(0) == [1] and trainers.checkpoints(3) == [1, 2, 3]
    steps = trainers.checkpoints(200, 20)
    assert steps[0] == 1 and steps[-1] == 200 and len(steps) == 20


def test_cross_validation_fits_inside_the_fold(spark):
    rows = [(f"{label}{i}", label, float(i % 10 + (20 if label == "A" else 0)), 1.0) for label in "AB" for i in range(60)]
    table = spark.createDataFrame(rows, "row_key string, behavior_type_label string, x double, flat double")
    trained = trainers.train(table, ["A", "B"], trainers.svm(5), folds=2, features=["x", "flat"])
    scores = {r["metric"]: r["value"] for r in trained.metrics.collect()}
    assert trained.features == ["x"]
    assert scores["cv_overall_accuracy"] == 1.0 and scores["test_overall_accuracy"] == 1.0
    assert scores["train_A_support"] == 48.0


def test_labelled_images_take_the_folder_as_label(spark, tmp_path):
    for label, name in (("NORMAL", "a.png"), ("STOPPING", "b.jpg"), ("STOPPING", "c.txt")):
        (tmp_path / label).mkdir(exist_ok=True)
        (tmp_path / label / name).write_bytes(b"xyz")
    rows = readers.read_labelled_images(spark, str(tmp_path)).collect()
    assert sorted((r["behavior_type_label"], r["length"]) for r in rows) == [("NORMAL", 3), ("STOPPING", 3)]


def test_multimodal_cells_survive_csv(spark):
    path = shared.new_path(spark, "test-multimodal")
    rows = spark.createDataFrame(
        [(1, [[255, 0], [1, 2]], [1.5, None], "NORMAL")],
        "event_index long, trajectory_image_matrix array<array<long>>, sog_array array<double>, behavior_type_label string",
    )
    writers.write_multimodal(rows, path)
    back = spark.read.option("header", True).option("escape", '"').csv(path).first()
    assert back["trajectory_image_matrix"] == "[[255,0],[1,2]]" and back["sog_array"] == "[1.5,null]"
    assert back["behavior_type_label"] == "NORMAL"
