"""Interval joins between points, events, trajectories and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakefold.sources.shared import new_path


def length_level(from_ms: Column, to_ms: Column) -> Column:
    """Length class of an interval: buckets of its level are 2**level long, a quarter of it or less."""
    length = F.greatest(to_ms.cast("double") - from_ms.cast("double"), F.lit(1.0))
    return F.greatest(F.ceil(F.log2(length)) - 2, F.lit(0)).cast("int")


def level_bucket(ts: Column, level: Column) -> Column:
    return F.call_function("shiftright", ts.cast("long"), level)


def interval_candidates(points: DataFrame, events: DataFrame, least: Column | None = None) -> DataFrame:
    """Points and events that meet in a bucket: all pairs that hold, and few others.

    Each event has the buckets of its own length class, five at most, so a few very long events make
    neither short ones coarse nor themselves into many rows. A point looks once into each class that
    occurs among the events; the classes, about 40 at most, are one value of a scalar subquery. With
    ``least``, a column of the points, it skips classes below that one.
    """
    level = length_level(F.col("from_ms"), F.col("to_ms"))
    placed = events.where(F.col("from_ms") <= F.col("to_ms")).withColumn("_level", level)
    first, last = (level_bucket(F.col(c), F.col("_level")) for c in ("from_ms", "to_ms"))
    spread = placed.withColumn("_bucket", F.explode(F.sequence(first, last)))
    present = placed.agg(F.collect_set("_level")).scalar()
    probing = points.withColumn("_level", F.explode(present))
    if least is not None:
        probing = probing.where(F.col("_level") >= least)
    return probing.withColumn("_bucket", level_bucket(F.col("ts"), F.col("_level"))).join(spread, ["id", "_level", "_bucket"])


def interval_join(points: DataFrame, events: DataFrame) -> DataFrame:
    """Points inside ``[from_ms, to_ms]`` of events of the same vessel, both ends included.

    The equality is on vessel, length class and time bucket, so a vessel with a very long track is
    spread over many tasks and a point meets only events near it. A point lies in one bucket of a
    class and an event has a bucket once, so no pair comes twice. A point in k events gives k rows.
    """
    met = interval_candidates(points, events)
    return met.where(F.col("ts").between(F.col("from_ms"), F.col("to_ms"))).drop("_level", "_bucket")


def pair_events(events: DataFrame) -> DataFrame:
    """One row per event and vessel: the event's own vessel and, if present, its partner."""
    return events.withColumn(
        "id", F.explode(F.array_compact(F.array(F.col("MMSI"), F.col("MMSI_2"))))
    )


def pair_interval_join(points: DataFrame, events: DataFrame) -> DataFrame:
    return interval_join(points, pair_events(events)).drop("MMSI", "MMSI_2")


def vessel_semi_filter(points: DataFrame, events: DataFrame) -> DataFrame:
    """Points of vessels with at least one event, inside the overall time span of the events.

    The span is a scalar subquery; the vessel list stays a frame however long it is.
    """
    span = events.agg(F.struct(F.min("from_ms").alias("lo"), F.max("to_ms").alias("hi"))).scalar()
    inside = points.where(F.col("ts").between(span["lo"], span["hi"]))
    return inside.join(events.select("id").distinct(), "id", "left_semi")


_REQUEST = ["request_id", "id", "from_ms", "to_ms"]
_SHIFT = 1 << 60  # makes times positive, so that bits tell the order


def _node(frame: DataFrame, start: str, end: str) -> DataFrame:
    """Adds the least dyadic interval that holds both ends: its level and its number.

    From level 1 on, its middle lies behind the start and not behind the end.
    """
    a, b = F.col(start) + F.lit(_SHIFT), F.col(end) + F.lit(_SHIFT)
    apart = a.bitwiseXOR(b)
    level = F.when(apart == 0, F.lit(0)).otherwise(F.length(F.bin(apart)))
    return frame.withColumn("_level", level).withColumn("_number", F.call_function("shiftright", a, F.col("_level")))


def _middle() -> Column:
    """Middle of a node of level 1 or more, in shifted time."""
    low = F.call_function("shiftleft", F.col("_number"), F.col("_level"))
    return low + F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.col("_level") - 1, F.lit(0)))


def _bit_blocks(level: Column, f) -> Column:
    return F.transform(F.sequence(F.lit(0), level - 1), f)


def _settled(frame: DataFrame) -> DataFrame:
    """The rows written once in the shared folder, as they are read several times."""
    path = new_path(frame.sparkSession, "settled")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _spans(trajectories: DataFrame) -> DataFrame:
    return _settled(trajectories.select("event_index", "id", "traj_start_ms", "traj_end_ms", "n_points"))


def covering_trajectory(trajectories: DataFrame, requests: DataFrame) -> DataFrame:
    """Shortest trajectory that covers each request; ties go to fewer points, then to the key.

    Requests are never paired with trajectories. A trajectory is kept at its dyadic node. All that
    cover a request lie at the request's node or above it. Above, the request lies on one side of the
    middle, so one end is sure and the other is a matter of order: the best so far, in order of starts
    on the left side and of ends on the right one. At the request's own node both ends count; there
    the distance of the start from the middle is cut by its bits, so that every trajectory farther out
    lies in one block for each bit at most, and inside a block the order of ends decides. Tracks that
    reach no request of their node are left out before. All orders are one window function with a
    running minimum.
    """
    return _covering(_spans(trajectories), requests)


def _covering(trajectories: DataFrame, requests: DataFrame) -> DataFrame:
    common = ["id", "_level", "_number"]
    tracks = _node(trajectories.where("traj_start_ms <= traj_end_ms"), "traj_start_ms", "traj_end_ms")
    asked = _node(requests.where("from_ms <= to_ms").withColumn("request_id", F.col("request_id").cast("long")), "from_ms", "to_ms")

    present = tracks.agg(F.collect_set("_level")).scalar()
    upper = asked.withColumn("_upper", F.explode(present)).where("_upper > _level OR (_upper = 0 AND _level = 0)")
    upper = upper.withColumn("_level", F.col("_upper")).withColumn(
        "_number", F.call_function("shiftright", F.col("from_ms") + F.lit(_SHIFT), F.col("_level"))
    )
    own = asked.where("_level > 0")
    reach = own.groupBy(*common).agg(F.max("from_ms").alias("_from"), F.min("to_ms").alias("_to"))
    outside = tracks.join(reach, common).where("traj_start_ms <= _from AND traj_end_ms >= _to")

    def rows(frame: DataFrame, kind: str, *columns: str) -> DataFrame:
        return frame.select(*common, F.lit(kind).alias("kind"), *columns)

    span, request = ["event_index", "traj_start_ms", "traj_end_ms", "n_points"], ["request_id", "from_ms", "to_ms"]
    met = rows(tracks, "track", *span).union(rows(outside, "outside", *span))
    asks = rows(upper, "upper", *request).union(rows(own, "own", *request))
    # Rows are dealt by node once and only then repeated for sides and bits.
    dealt = met.unionByName(asks, allowMissingColumns=True).repartition(*common)

    def at(side: str, position: Column, bit: Column | int = -1, block: Column | int = -1) -> Column:
        """Side, bit, block and position in the order."""
        bit, block = (F.lit(x) if isinstance(x, int) else x for x in (bit, block))
        return F.struct(F.lit(side).alias("side"), bit.cast("int").alias("bit"), block.cast("long").alias("block"), position.alias("position"))

    level, start, end = F.col("_level"), F.col("traj_start_ms"), -F.col("traj_end_ms")
    kind, far = F.col("kind"), _middle() - F.lit(_SHIFT) - F.coalesce("from_ms", "traj_start_ms")

    def shifted(bit: Column) -> Column:
        return F.call_function("shiftright", far, bit)

    is_left = (level > 0) & (F.col("to_ms") + F.lit(_SHIFT) < _middle())
    farther = F.filter(
        _bit_blocks(level, lambda i: F.when(shifted(i) % 2 == 0, at("both", -F.col("to_ms"), i, shifted(i) + 1))),
        lambda x: x.isNotNull(),
    )
    places = (
        F.when(kind == "track", F.array(at("left", start), at("right", end)))
        .when(kind == "outside", _bit_blocks(level, lambda i: at("both", end, i, shifted(i))))
        .when(kind == "upper", F.array(F.when(is_left, at("left", F.col("from_ms"))).otherwise(at("right", -F.col("to_ms")))))
        .otherwise(F.concat(farther, F.array(at("both", -F.col("to_ms"), 0, far))))
    )
    rank = F.struct(
        F.expr("traj_end_ms div 1000 - traj_start_ms div 1000").alias("seconds"),
        F.coalesce(F.col("n_points"), F.lit(2**62)).alias("points"),
        *span,
    )
    best = F.when(kind.isin("track", "outside"), rank).alias("best")
    ask = F.when(kind.isin("upper", "own"), F.struct(*request)).alias("ask")
    placed = dealt.select(*common, F.explode(places).alias("_at"), best, ask).select(*common, "_at.*", "best", "ask")

    order = Window.partitionBy(*common, "side", "bit", "block").orderBy(F.asc("position"), F.asc_nulls_first("ask.from_ms"))
    so_far = F.min("best").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = placed.withColumn("found", so_far)
    chosen = swept.where("ask IS NOT NULL AND found IS NOT NULL").groupBy("id", "ask").agg(F.min("found").alias("t"))
    return chosen.select(
        "ask.request_id", "id", "ask.from_ms", "ask.to_ms", "t.event_index", "t.traj_start_ms", "t.traj_end_ms", "t.n_points"
    )


def within_trajectories(trajectories: DataFrame, requests: DataFrame) -> DataFrame:
    """All trajectories that lie wholly inside each request."""
    # No request of a shorter class than the trajectory's own holds it.
    least = length_level(F.col("traj_start_ms"), F.col("traj_end_ms"))
    met = interval_candidates(trajectories.withColumn("ts", F.col("traj_start_ms")), requests, least)
    return met.where("ts BETWEEN from_ms AND to_ms AND traj_end_ms <= to_ms").select(*_REQUEST, "event_index", "traj_start_ms", "traj_end_ms", "n_points")


def cover_else_within(trajectories: DataFrame, requests: DataFrame) -> DataFrame:
    """The covering trajectory of each request, or else every trajectory inside it.

    Trajectories that only overlap a request are never returned.
    """
    trajectories = _spans(trajectories)
    covering = _settled(_covering(trajectories, requests))
    left = requests.join(covering.select("request_id"), "request_id", "left_anti")
    inside = within_trajectories(trajectories, left)
    return covering.withColumn("is_covering", F.lit(True)).unionByName(
        inside.withColumn("is_covering", F.lit(False))
    )


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], row_key: str, salts: int = 16) -> DataFrame:
    """Equi-join in which one key may own a large share of ``big``.

    Rows of ``big`` are dealt over ``salts`` sub-keys by a hash of ``row_key``; ``small`` holds
    one row per key and is repeated once per sub-key.
    """
    dealt = big.withColumn("salt", F.pmod(F.xxhash64(row_key), F.lit(salts)))
    repeated = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return dealt.join(repeated, [*keys, "salt"]).drop("salt")


def prediction_parent_join(
    predictions: DataFrame, trajectories: DataFrame, shared_keys: list[str] | None = None
) -> DataFrame:
    """Predictions with columns of the trajectory they were made from."""
    parents = trajectories.withColumnRenamed("primary_key", "aggregated_ais_data_id")
    return predictions.join(parents, ["aggregated_ais_data_id", *(shared_keys or [])])
