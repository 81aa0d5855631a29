"""Windows over an event stream (event_id, ts, user_id, event_type, value). Each plan takes a batch or a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Event time as a timestamp with a zone, and a watermark on streams (a stream takes no timestamp_ntz there)."""
    rows = events.withColumn("event_time", F.col("ts").cast("timestamp"))
    return rows.withWatermark("event_time", late) if events.isStreaming else rows


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    rows = with_event_time(events, late).groupBy(F.window("event_time", width), "event_type")
    counted = rows.agg(F.count("*").alias("n"), F.sum((F.col("value") * 100).cast("decimal(38,10)").cast("decimal(38,0)")).cast("long").alias("cents"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "cents")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    rows = with_event_time(events, late).groupBy(F.window("event_time", width, step), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: a pause of `gap` or more starts a new one."""
    rows = with_event_time(events, late).groupBy(F.session_window("event_time", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), "n")
