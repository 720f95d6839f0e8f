from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakefold.functions.textual import safe_names
from wakefold.ml.trainers import pipeline
from wakefold.operators import upsert
from wakefold.sources.readers import read_events, read_positions, read_with_rejects


def test_positions_follow_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,Id,latitude,longitude\n2024-01-01 00:00:00,7,1.5,2.5\n2024-01-01 00:00:01,None,x,3\n")
    rows = read_positions(spark, str(tmp_path)).orderBy("ts").collect()
    names = [n for n in rows[0].asDict() if n.startswith(("lat", "lon"))]
    assert {n[:3]: rows[0][n] for n in names} == {"lat": 1.5, "lon": 2.5}
    assert [str(r.id) for r in rows] == ["7", "None"] and rows[0].ts == 1704067200000
    assert all(rows[1][n] is None for n in names if n.startswith("lat"))


def test_safe_names_are_unique():
    assert safe_names(["a_2", "a", "a"]) == ["a_2", "a", "a_3"]
    assert len(set(safe_names(["a", "a", "a_1", "", "7", "col_3"]))) == 6


def test_names_of_an_absent_label(spark):
    from pyspark.ml.classification import RandomForestClassifier

    rows = [(float(k % 2), ("NORMAL", "STOPPING")[k % 2]) for k in range(20)]
    table = spark.createDataFrame(rows, "speed double, behavior_type_label string")
    steps = pipeline(RandomForestClassifier(numTrees=3, seed=1), ["speed"], ["LOITERING", "NORMAL", "STOPPING"])
    got = steps.fit(table).transform(table)
    assert got.where("predicted <> behavior_type_label").count() == 0


def test_events_follow_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("T_end,MMSI,T_start,Argument,event_index\n2024-01-02 00:00:00,m,2024-01-01 00:00:00,n,x\n")
    row = read_events(spark, str(tmp_path)).first()
    assert (row.MMSI, row.MMSI_2, row.event_index, row.FluentName) == ("m", "n", None, None)
    assert row.T_start < row.T_end


def test_reject_lines_keep_empty_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,,abc\n1,,2\n")
    fields = T.StructType([T.StructField(n, T.LongType()) for n in "abc"])
    good, bad = read_with_rejects(spark, str(tmp_path), fields)
    assert [tuple(r) for r in good.collect()] == [(1, None, 2)]
    assert [r["_rejected"] for r in bad.collect()] == ["1,,abc"]


def test_rejects_have_a_reason_and_parts_count_once(spark):
    good, short = "LINESTRING(1 2, 3 4)", "LINESTRING(1 2)"
    rows = [("a", 1, "NORMAL", good, 0), ("a", 1, "NORMAL", short, 1), ("b", 2, "NORMAL", short, 0), (None, 3, "NORMAL", good, 0)]
    frame = spark.createDataFrame(rows, "id string, EventIndex long, behavior_type_label string, trajectory string, part long")
    assert tuple(upsert.validity_counts(frame).first()) == (3, 1, 2)
    reasons = [(r["mmsi"], r["part"], r["reason"]) for r in upsert.rejected(frame).collect()]
    assert sorted(reasons, key=str) == sorted([("b", 0, "trajectory"), (None, 0, "key")], key=str)


def test_upsert_keeps_all_parts_of_the_newest_revision(spark):
    schema = "mmsi string, event_index long, behavior_type_label string, part long, trajectory string, at int"
    line, point = "LINESTRING(1 2, 3 4)", "LINESTRING(5 6)"
    old = spark.createDataFrame([("a", 1, "NORMAL", p, line, 0) for p in range(4)] + [("b", 2, "NORMAL", 0, line, 0)], schema)
    new = spark.createDataFrame(
        [("a", 1, "NORMAL", p, point if p == 2 else line, at) for p in range(3) for at in (1, 2)], schema
    )
    got = upsert.upsert_trajectories(old, new, [F.desc("at")])
    assert sorted((r.mmsi, r.part, r.at) for r in got.collect()) == [("a", 0, 2), ("a", 1, 2), ("a", 2, 2), ("b", 0, 0)]
