"""Extension: bursts and statistics over a stream of media events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.operators.sessions import camera_key


def burst_stream(events: DataFrame, *, time: str = "taken_at", window_s: int = 2, lateness: str = "1 hour") -> DataFrame:
    """Sessions per camera over a stream (or a batch): start, end, shots. Gaps equal to the window stay inside, as in batch.

    Spark's session windows are half-open, so the gap given is a microsecond wider; state is dropped
    once the watermark has passed a session, and later events for it are left out.
    """
    e = events.withColumn("camera", camera_key("camera_model")).where("camera is not null").withWatermark(time, lateness)
    gap = f"{window_s} seconds 1 microsecond"
    s = e.groupBy("camera", F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_shots"), F.min(time).alias("start"), F.max(time).alias("end"))
    return s.select("camera", "start", "end", "n_shots")


def volume_stream(events: DataFrame, *, time: str = "ts", every: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Events per tumbling window and type."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
