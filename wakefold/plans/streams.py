"""The flagship as a stream: the same windows, closed by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakefold.operators import loitering
from wakefold.plans.registry import Topic
from wakefold.plans.sliding import _ALL_SQL, SIZE_S, START_S, STEP_S, vessel_points
from wakefold.plans.tables import Tables, sql_with
from wakefold.sources.shared import new_path
from wakefold.streaming.loitering import run_available, window_stream

topic = Topic()

DROPS = 4
DELAY_S = 3600


def written_drops(points: DataFrame, folder: str, drops: int = DROPS):
    """Writes the points as so many deliveries, each later than the one before; yields after each."""
    edges = points.agg(F.percentile_approx("ts_s", [k / drops for k in range(1, drops)], 10_000)).first()[0] or []
    edges = [None, *sorted(set(edges)), None]
    for low, high in zip(edges, edges[1:], strict=False):
        after = F.lit(True) if low is None else F.col("ts_s") > low
        until = F.lit(True) if high is None else F.col("ts_s") <= high
        points.where(after & until).write.mode("append").parquet(folder)
        yield


def streamed(t: Tables) -> DataFrame:
    """Runs the stream over the deliveries, each run a restart from the checkpoint."""
    points, source = vessel_points(t), new_path(t.spark, "positions")
    out, state = new_path(t.spark, "windows"), new_path(t.spark, "stream-state")
    for _ in written_drops(points, source):
        arriving = t.spark.readStream.schema(points.schema).parquet(source)
        run_available(window_stream(arriving, START_S, SIZE_S, STEP_S, f"{DELAY_S} seconds"), out, state)
    return t.spark.read.parquet(out)


@topic.query(
    "stream_loitering",
    sql_with("points", extra=_ALL_SQL)
    + f"""SELECT id, window_index, n_points, round(path_km, 6) AS path_km, round(sum_sog, 6) AS sum_sog,
                round(sum_cog_delta, 6) AS sum_cog_delta, round(wn, 6) AS trajectory_redundancy,
                CASE WHEN wn > 1 THEN 'LOITERING' ELSE 'NON-LOITERING' END AS behavior_type_by_loitering_equation
         FROM scored WHERE {START_S} + window_index * {STEP_S} + {SIZE_S} + {STEP_S}
                           <= (SELECT max(ts // 1000) - {DELAY_S} FROM points)""",
)
def stream_loitering(t: Tables) -> DataFrame:
    """All windows that the watermark has closed at the end of the stream; the grid is one step."""
    scored = loitering.classify_geometry(streamed(t), "wn", threshold=1.0)
    return scored.select(
        "id", "window_index", "n_points",
        *[F.round(c, 6).alias(c) for c in ("path_km", "sum_sog", "sum_cog_delta", "trajectory_redundancy")],
        "behavior_type_by_loitering_equation",
    )
