"""Ordered-track arithmetic that never needs a whole track in one task.

A track (all rows of one key, in time order) can be far larger than a task should hold: one
vessel may own a third of all rows. Every ordered computation here therefore works in two
levels. Rows are grouped by ``(key, time segment)``, each segment is folded to one summary row
with its first and last point, and only these summaries are ordered per key to add the step
between the last point of a segment and the first point of the next one. Sums, counts, minima
and maxima merge exactly, so the result does not depend on the segment width. Squared deviations
are kept around each part's own mean; joining two parts adds the distance of their means, so
nothing large is subtracted and small deviations of large values survive.

Points have the columns ``ts`` (epoch ms), ``lon``, ``lat``, ``sog``, ``cog`` and ``pos_key``
(unique tie-break).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakefold.functions.geo import haversine_km, planar_bearing
from wakefold.schemas import HOUR_MS

SEGMENT_MS = HOUR_MS
TARGET_SEGMENT_ROWS = 1_000_000
TURN_DEGREES = 10.0
SLOW_KNOTS = 2.0
STILL_KNOTS = 0.5

ENDS = ["ts", "lon", "lat", "cog"]
SUMS = [
    "n", "sog_n", "sog_sum", "slow", "still",
    "cog_n", "cog_sum", "km", "km_gap", "bearing_ms", "turns",
]
MOMENTS = ["sog", "cog"]
LOWS = ["sog_min", "cog_min"]
HIGHS = ["sog_max", "cog_max"]


def segment_id(ts: Column, segment_ms: int) -> Column:
    return F.floor(ts / F.lit(segment_ms)).cast("long")


def suggest_segment_ms(points: DataFrame, key: str = "id", target_rows: int = TARGET_SEGMENT_ROWS) -> int:
    """Widest segment that holds at most ``target_rows`` points of one key.

    No hour of any key has more points than the densest one, so a segment of h hours holds at
    most h times as many. Sparse tracks thus get one segment and no stitching, dense ones get
    many. One pass with map-side combine over two columns; a single number reaches the driver.
    """
    densest = (
        points.groupBy(key, segment_id(F.col("ts"), HOUR_MS).alias("seg"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .agg(F.max("rows"))
        .first()[0]
    )
    return max(1, HOUR_MS * target_rows // max(1, densest or 1))


def longest_track(points: DataFrame, key: str = "id") -> int:
    """Most points of one key; a single number reaches the driver."""
    return points.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).agg(F.max("rows")).first()[0] or 0


def point_measures(sog: Column, cog: Column) -> dict[str, Column]:
    """What one point adds to a track summary."""
    zero = F.lit(0.0)
    return {
        "n": F.lit(1).cast("long"),
        "sog_n": sog.isNotNull().cast("long"),
        "sog_sum": F.coalesce(sog, zero),
        "slow": F.coalesce(sog < SLOW_KNOTS, F.lit(False)).cast("long"),
        "still": F.coalesce(sog < STILL_KNOTS, F.lit(False)).cast("long"),
        "cog_n": cog.isNotNull().cast("long"),
        "cog_sum": F.coalesce(cog, zero),
        "sog_min": sog,
        "sog_max": sog,
        "cog_min": cog,
        "cog_max": cog,
    }


def squared_deviation(value: Column, window=None) -> Column:
    """Sum of squared deviations from the mean, null values left out; 0 where there is none."""
    spread, count = F.var_pop(value), F.count(value)
    if window is not None:
        spread, count = spread.over(window), count.over(window)
    return F.coalesce(spread * count, F.lit(0.0))


def mean_gap(n1: Column, sum1: Column, n2: Column, sum2: Column) -> Column:
    """What joining two parts adds to their squared deviations."""
    apart = F.try_divide(sum1, n1) - F.try_divide(sum2, n2)
    return F.when((n1 > 0) & (n2 > 0), n1 * F.try_divide(n2, n1 + n2) * apart * apart).otherwise(F.lit(0.0))


def _gaps(prefix: str) -> dict[str, Column]:
    """``mean_gap`` of each moment between a part and the totals whose names have the prefix."""
    return {
        f"{m}_m2": mean_gap(*[F.col(c).cast("double") for c in (f"{m}_n", f"{m}_sum", f"{prefix}_{m}_n", f"{prefix}_{m}_sum")])
        for m in MOMENTS
    }


def step_measures(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """What the step from point ``a`` to point ``b`` adds; zeros when there is no step.

    A step with a missing coordinate is counted in ``km_gap``: it makes the distance of the
    whole track unknown.
    """
    exists = a["ts"].isNotNull() & b["ts"].isNotNull()
    km = haversine_km(a["lat"], a["lon"], b["lat"], b["lon"])
    bearing = planar_bearing(b["lon"] - a["lon"], b["lat"] - a["lat"])
    turned = F.abs(b["cog"] - a["cog"]) > TURN_DEGREES
    return {
        "km": F.coalesce(km, F.lit(0.0)),
        "km_gap": (exists & km.isNull()).cast("long"),
        "bearing_ms": F.coalesce(bearing * (b["ts"] - a["ts"]), F.lit(0.0)),
        "turns": F.coalesce(turned, F.lit(False)).cast("long"),
    }


def _ends(prefix: str) -> dict[str, Column]:
    return {name: F.col(f"{prefix}_{name}") for name in ENDS}


def segment_summaries(points: DataFrame, keys: list[str], segment_ms: int = SEGMENT_MS) -> DataFrame:
    """One summary row per (keys, segment). Window and grouping share one shuffle."""
    keyed = points.withColumn("seg", segment_id(F.col("ts"), segment_ms))
    order = Window.partitionBy(*keys, "seg").orderBy("ts", "pos_key")
    here = {name: F.col(name) for name in ENDS}
    before = {name: F.lag(name).over(order) for name in ENDS}
    stepped = keyed.select(
        *keys,
        "seg",
        *ENDS,
        "sog",
        *[col.alias(f"m_{name}") for name, col in point_measures(F.col("sog"), F.col("cog")).items()],
        *[col.alias(f"p_{name}") for name, col in before.items()],
        F.lead("ts").over(order).isNull().alias("is_tail"),
    )
    steps = step_measures(_ends("p"), here)
    measured = stepped.select("*", *[col.alias(f"m_{name}") for name, col in steps.items()])
    is_head = F.col("p_ts").isNull()
    return measured.groupBy(*keys, "seg").agg(
        *[F.max(F.when(is_head, F.col(c))).alias(f"head_{c}") for c in ENDS],
        *[F.max(F.when(F.col("is_tail"), F.col(c))).alias(f"tail_{c}") for c in ENDS],
        *[F.sum(f"m_{c}").alias(c) for c in SUMS],
        *[squared_deviation(F.col(c)).alias(f"{c}_m2") for c in MOMENTS],
        *[F.min(f"m_{c}").alias(c) for c in LOWS],
        *[F.max(f"m_{c}").alias(c) for c in HIGHS],
    )


def track_summaries(points: DataFrame, keys: list[str], segment_ms: int = SEGMENT_MS) -> DataFrame:
    """One summary row per key, stitched from its segments."""
    segments = segment_summaries(points, keys, segment_ms)
    order = Window.partitionBy(*keys).orderBy("seg")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    linked = segments.select(
        "*",
        *[F.lag(f"tail_{c}").over(order).alias(f"p_{c}") for c in ENDS],
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"p_{c}") for m in MOMENTS for c in (f"{m}_n", f"{m}_sum")],
    )
    steps = step_measures(_ends("p"), _ends("head"))
    return linked.groupBy(*keys).agg(
        *[F.min_by(f"head_{c}", "seg").alias(f"head_{c}") for c in ENDS],
        *[F.max_by(f"tail_{c}", "seg").alias(f"tail_{c}") for c in ENDS],
        *[
            F.sum(F.col(c) + steps[c] if c in steps else F.col(c)).alias(c)
            for c in SUMS
        ],
        *[F.sum(F.col(c) + gap).alias(c) for c, gap in _gaps("p").items()],
        *[F.min(c).alias(c) for c in LOWS],
        *[F.max(c).alias(c) for c in HIGHS],
    )


def suffix_summaries(
    points: DataFrame, starts: DataFrame, segment_ms: int = SEGMENT_MS
) -> DataFrame:
    """Summary of the rest of a vessel's track from each start on, without pairing rows.

    ``starts`` has ``event_index``, ``id``, ``from_ms`` and any other columns, which are kept.
    Pairing every start with every later point grows with the square of the track length.
    Here a start is placed among the points of its own segment, where running totals taken
    backwards in time give the part inside the segment; totals over later segments are added
    by one join on ``(id, segment)``.
    """
    extra = [c for c in starts.columns if c not in ("event_index", "id", "from_ms")]
    fields = ENDS + ["sog", "pos_key"]
    rows = points.select("id", *fields, F.lit(True).alias("is_point")).unionByName(
        starts.select(
            "id", "event_index", *extra, F.col("from_ms").alias("ts"), F.lit(False).alias("is_point")
        ),
        allowMissingColumns=True,
    )
    rows = rows.withColumn("seg", segment_id(F.col("ts"), segment_ms))

    # Backwards in time; at equal times points come first, so a start sees them.
    back = Window.partitionBy("id", "seg").orderBy(
        F.desc("ts"), F.desc("is_point"), F.desc("pos_key"), F.desc("event_index")
    )
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    upto = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    point_only = F.when(F.col("is_point"), F.struct(*ENDS))
    rows = rows.withColumn("next", F.last(point_only, ignorenulls=True).over(later))
    here = {c: F.when(F.col("is_point"), F.col(c)) for c in ENDS}
    after = {c: F.col("next")[c] for c in ENDS}
    measures = {**point_measures(F.col("sog"), F.col("cog")), **step_measures(here, after)}
    measured = rows.select(
        "id", "seg", "event_index", *extra, "ts", "pos_key", "is_point",
        point_only.alias("spot"),
        *[F.when(F.col("is_point"), F.col(c)).alias(c) for c in MOMENTS],
        *[F.when(F.col("is_point"), col).alias(f"m_{name}") for name, col in measures.items()],
    )
    running = measured.select(
        "id", "seg", "event_index", *extra, F.col("ts").alias("from_ms"), "is_point",
        *[F.coalesce(F.sum(f"m_{c}").over(upto), F.lit(0)).alias(c) for c in SUMS],
        *[squared_deviation(F.col(c), upto).alias(f"{c}_m2") for c in MOMENTS],
        *[F.min(f"m_{c}").over(upto).alias(c) for c in LOWS],
        *[F.max(f"m_{c}").over(upto).alias(c) for c in HIGHS],
        F.last("spot", ignorenulls=True).over(upto).alias("head"),
        F.first("spot", ignorenulls=True).over(upto).alias("tail"),
        F.lead("seg").over(back).isNull().alias("is_whole"),
    )

    # The last row backwards has seen the whole segment: it is the segment's summary.
    m2 = [f"{c}_m2" for c in MOMENTS]
    totals = running.where("is_whole").select("id", "seg", *SUMS, *m2, *LOWS, *HIGHS, "head", "tail")
    by_time = Window.partitionBy("id").orderBy(F.desc("seg"))
    beyond = by_time.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("next_head", F.last("head", ignorenulls=True).over(beyond))
    stitch = step_measures(
        {c: F.col("tail")[c] for c in ENDS}, {c: F.col("next_head")[c] for c in ENDS}
    )
    full = {c: F.col(c) + stitch[c] if c in stitch else F.col(c) for c in SUMS}
    rest = totals.select("id", "seg", *[col.alias(c) for c, col in full.items()],
                         *m2, *LOWS, *HIGHS, "tail", "next_head")
    sums_beyond = [f"{c}_{part}" for c in MOMENTS for part in ("n", "sum")]
    rest = rest.select("*", *[F.coalesce(F.sum(c).over(beyond), F.lit(0)).alias(f"b_{c}") for c in sums_beyond])
    rest = rest.withColumns({c: F.col(c) + gap for c, gap in _gaps("b").items()})
    rest = rest.select(
        "id", "seg", F.col("next_head"),
        F.first("tail", ignorenulls=True).over(beyond).alias("r_tail"),
        *[F.coalesce(F.sum(c).over(beyond), F.lit(0.0)).alias(f"r_{c}") for c in m2],
        *[F.coalesce(F.sum(c).over(beyond), F.lit(0)).alias(f"r_{c}") for c in SUMS],
        *[F.min(c).over(beyond).alias(f"r_{c}") for c in LOWS],
        *[F.max(c).over(beyond).alias(f"r_{c}") for c in HIGHS],
    )

    joined = running.where(~F.col("is_point")).join(rest, ["id", "seg"])
    bridge = step_measures(
        {c: F.col("tail")[c] for c in ENDS}, {c: F.col("next_head")[c] for c in ENDS}
    )
    head = F.coalesce(F.col("head"), F.col("next_head"))
    tail = F.coalesce(F.col("r_tail"), F.col("tail"))
    return joined.select(
        "event_index", "id", *extra, "from_ms",
        *[head[c].alias(f"head_{c}") for c in ENDS],
        *[tail[c].alias(f"tail_{c}") for c in ENDS],
        *[
            (F.col(c) + F.col(f"r_{c}") + (bridge[c] if c in bridge else F.lit(0))).alias(c)
            for c in SUMS
        ],
        *[(F.col(c) + F.col(f"r_{c}") + gap).alias(c) for c, gap in _gaps("r").items()],
        *[F.least(F.col(c), F.col(f"r_{c}")).alias(c) for c in LOWS],
        *[F.greatest(F.col(c), F.col(f"r_{c}")).alias(c) for c in HIGHS],
    )
