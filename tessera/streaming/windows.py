"""Event-time windows; the same plan runs on a stream, with a watermark, and on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, *, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of value by window and event_type; a stream's state ends `late` behind the newest event."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Each user's sessions, ended by `gap` without contact."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("n"))


def accept_once(results: DataFrame, key: str, *, memory: str = "20 minutes") -> DataFrame:
    """The first result of each key; a stream forgets keys `memory` behind the newest event."""
    if not results.isStreaming:
        return results.dropDuplicates([key])
    return results.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", memory).dropDuplicatesWithinWatermark([key])
