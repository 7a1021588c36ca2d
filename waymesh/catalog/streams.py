"""Streaming queries, driven from the events table to completion."""

from pyspark.sql import functions as F

from ..sources.sinks import scratch_path
from ..streaming.jobs import latest_results, track_pieces
from .registry import query


def _events_stream(v):
    schema = v.spark.read.parquet(f"{v.sf_dir}/events.parquet").schema
    stream = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_trajectory_segments", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events),
    p AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id AS traj, epoch_us(min(ts)) AS start_us, count(*) AS point_count FROM p GROUP BY user_id, n""")
def _(v):
    out = scratch_path(v.spark, "pieces")
    pieces = track_pieces(_events_stream(v).select(F.col("user_id").alias("traj"), "ts"), "6 hours", "1 hour")
    job = (pieces.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", scratch_path(v.spark, "stream"))
           .foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(out)).start())
    job.awaitTermination()
    return v.spark.read.parquet(out).select("traj", F.unix_micros("start_ts").alias("start_us"), "point_count")


@query("stream_case_results", """SELECT user_id AS case_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS state FROM events GROUP BY 1""")
def _(v):
    out = scratch_path(v.spark, "results")
    rows = _events_stream(v).select(F.col("user_id").alias("case_id"), "ts", "event_id", F.col("event_type").alias("state"))
    job = (latest_results(rows).writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", scratch_path(v.spark, "stream"))
           .foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(out)).start())
    job.awaitTermination()
    return v.spark.read.parquet(out)
