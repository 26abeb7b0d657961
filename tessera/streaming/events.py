"""Event streams: windowed counts with a watermark, sessions, and duplicates dropped within it. The reference has none; these are extras."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n, total of a stream or a table of events."""
    rows = timed(events).withWatermark("ts", late) if events.isStreaming else timed(events)
    return rows.groupBy(F.window("ts", width, slide or width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, session_start, session_end, n."""
    rows = timed(events).withWatermark("ts", late) if events.isStreaming else timed(events)
    return rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def unique(events: DataFrame, late: str = "2 hours") -> DataFrame:
    rows = timed(events)
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else rows.dropDuplicates(["event_id"])
