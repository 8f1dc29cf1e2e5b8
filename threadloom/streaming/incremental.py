"""Streaming extensions: sessions and volume of a message stream, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_sessions(messages: DataFrame, gap_seconds: int = 3600, late: str = "1 day") -> DataFrame:
    """Sessions of a stream with ts (epoch seconds): the gap is the same strict bound as in batch."""
    at = messages.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    s = F.session_window("at", f"{gap_seconds} seconds")
    return at.groupBy(s, "chat_id").agg(F.count("*").alias("messages")).select("chat_id", F.unix_timestamp("session_window.start").alias("start_ts"), (F.unix_timestamp("session_window.end") - gap_seconds).alias("end_ts"), "messages")


def stream_volume(messages: DataFrame, late: str = "1 day") -> DataFrame:
    at = messages.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return at.groupBy(F.window("at", "1 day"), "chat_id").agg(F.count("*").alias("count")).select("chat_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "count")
