"""Structured Streaming forms: live track pieces and latest case results."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def track_pieces(points: DataFrame, gap: str, delay: str) -> DataFrame:
    """Pieces of each track between time gaps; works on a stream with a watermark and on a table.

    ``points`` holds ``traj, ts``. Sessions keep only counts as state, never the points themselves.
    """
    timed = points.withWatermark("ts", delay) if points.isStreaming else points
    return timed.groupBy("traj", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("point_count")).select(
        "traj", F.col("w.start").alias("start_ts"), "point_count")


def latest_results(events: DataFrame) -> DataFrame:
    """Latest state of each case: a running maximum by time, ties by event id."""
    return events.groupBy("case_id").agg(F.max(F.struct("ts", "event_id", "state")).alias("m")).select("case_id", F.col("m.event_id").alias("event_id"), F.col("m.state").alias("state"))
