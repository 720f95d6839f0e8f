"""Images are drawn where a trajectory's points lie; only long ones are dealt to several tasks."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from wakefold.functions.timefmt import relative_seconds
from wakefold.operators import drawing, raster

SCHEMA = "k string, ts long, lon double, lat double, sog double, cog double, pos_key long"


def tracks(spark):
    """Tracks of one to nine points, a standing one, missing positions, a missing key and rows that come twice."""
    dice = random.Random(3)
    rows = [
        (f"t{t}", i, dice.uniform(-5, 5), dice.uniform(40, 41), 1.0, 1.0, i) for t in range(12) for i in range(1 + dice.randrange(9))
    ]
    rows += [("still", i, 3.0, 7.0, 1.0, 1.0, i) for i in range(4)] + [("t1", 99, None, 2.0, 1.0, 1.0, 99), (None, 1, 1.0, 1.0, 1.0, 1.0, 1)]
    return spark.createDataFrame(rows + rows[:7], SCHEMA)


def test_both_ways_of_drawing_give_the_same_strips(spark):
    names = ["k", "resolution", "row", "strip", "mask"]
    sizes = [120, 299, 512]
    in_place = raster.ink_strips(tracks(spark), ["k"], sizes).select(names).collect()
    dealt = raster._dealt_strips(tracks(spark), ["k"], sizes).select(names).collect()
    assert len(in_place) > 1000 and sorted(map(tuple, in_place)) == sorted(map(tuple, dealt))


def test_long_trajectories_alone_are_dealt(spark, monkeypatch):
    whole = {tuple(r) for r in raster.track_images(tracks(spark), ["k"], [120]).select("k", "places", "masks").collect() for r in [(r[0], *map(tuple, r[1:]))]}
    monkeypatch.setattr(raster, "LINES_PER_SHARE", 4)
    mixed = {tuple(r) for r in raster.track_images(tracks(spark), ["k"], [120]).select("k", "places", "masks").collect() for r in [(r[0], *map(tuple, r[1:]))]}
    assert len(whole) == 13 and mixed == whole


def test_points_are_shuffled_once_and_masks_never(spark):
    frame = tracks(spark)
    images = raster.track_images(frame, ["k"], [120])._jdf.queryExecution().sparkPlan().toString()
    strips = raster.ink_strips(frame, ["k"], [120])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in images and strips.count("Exchange hashpartitioning") == 1


def test_matrices_are_made_behind_all_shuffles(spark):
    found = __spark_entry__.queries()["multimodal_dataset"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and "Exchange" not in above and "Aggregate" not in above


def test_image_folders_hold_one_row_per_image(spark, tmp_path):
    frame = tracks(spark).withColumn("behavior_type_label", F.when(F.col("k") < "t3", "A").otherwise("B"))
    raster.raster_dataset(frame, ["k", "behavior_type_label"], str(tmp_path / "images"), [120, 128])
    back = spark.read.parquet(str(tmp_path / "images"))
    assert back.count() == 2 * 13 == back.select("k", "resolution").distinct().count()
    assert {r[0] for r in back.select("behavior_type_label").distinct().collect()} == {"A", "B"}


def plain_line(x0, y0, x1, y1, width):
    dx, dy = x1 - x0, y1 - y0
    reach, flat = max(abs(dx), abs(dy)), abs(dx) >= abs(dy)
    length = max(reach, 1)
    for i in range(reach + 1):
        x, y = x0 + (dx * i * 2 + length) // (2 * length), y0 + (dy * i * 2 + length) // (2 * length)
        for o in range(-(width // 2), width - width // 2):
            yield (x, y + o) if flat else (x + o, y)


def test_lines_equal_plain_ones_and_are_cut_at_the_edge(monkeypatch):
    dice, size = random.Random(5), 40
    lines = [[dice.randrange(-20, 4 * size + 20) for _ in range(4)] for _ in range(60)] + [[3, 9, 3, 9], [0, 0, 50, 50], [50, 0, 0, 50]]
    monkeypatch.setattr(drawing, "STEPS_AT_ONCE", 100)
    for width in (1, 4, 21):
        masks = np.zeros((len(lines), size, size // 4), np.uint64)
        drawing._ink(masks, np.arange(len(lines)), *np.array(lines).T, width)
        for line, mask in zip(lines, masks, strict=True):
            want = {(x, y) for x, y in plain_line(*line, width) if 0 <= x < 4 * size and 0 <= y < 4 * size}
            bits = np.argwhere(mask[..., None] >> np.arange(64, dtype=np.uint64) & np.uint64(1))
            assert {(s * 16 + b % 16, r * 4 + b // 16) for r, s, b in bits.tolist()} == want
    dark = drawing.greys(masks.view(np.int64), size)
    assert dark.sum() == sum(
        255 * (16 - int(mask[r, c // 4] >> np.uint64(c % 4 * 4) & np.uint64(0x000F000F000F000F)).bit_count()) // 16
        for mask in masks for r in range(size) for c in range(size)
    )


def test_matrices_are_summed_in_tasks(spark):
    shapes = raster.track_shapes(tracks(spark), ["k"])
    summed = raster.summed_matrices(raster.drawn_matrices(shapes, 120)).orderBy("k").collect()
    assert summed == raster.drawn_matrices(shapes, 120, digest=True).orderBy("k").collect()
    first = raster.drawn_matrices(shapes, 120).orderBy("k").first()
    assert summed[0]["image_sum"] == sum(map(sum, first["matrix"])) and summed[0]["image_rows"] == 120
    found = __spark_entry__.queries()["multimodal_dataset"](spark, "/root/testdata/sf0.001")
    assert "aggregate(flatten" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_known_bound_saves_the_counting_pass(spark, monkeypatch):
    frame, whole = tracks(spark), raster.track_images(tracks(spark), ["k"], [120]).orderBy("k").collect()
    with monkeypatch.context() as m:
        m.setattr(type(frame), "first", lambda self: 1 / 0)
        images = raster.track_images(frame, ["k"], [120], longest=18)
    assert images.orderBy("k").collect() == whole
    ink = raster.image_ink(images, ["k"]).orderBy("k").collect()
    assert [r["inked_cells"] for r in ink] == [sum((m & 2**64 - 1).bit_count() for m in r["masks"]) for r in whole]
    assert [r["inked_strips"] for r in ink] == [len(r["places"]) for r in whole]


def test_relative_seconds_grow_with_the_cells(spark):
    cells = F.transform(F.sequence(F.lit(0), F.lit(3999)), lambda i: F.format_string("2024-01-01 00:%02d:%02d", (i / 60 % 60).cast("int"), i % 60))
    frame = spark.range(1).select(relative_seconds(cells).alias("s"))
    begun = time.time()
    assert frame.first()["s"][:3599] == list(range(3599))
    assert time.time() - begun < 20
