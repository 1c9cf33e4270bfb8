"""Windowed delivery metrics; the same plan for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delivery_windows(df: DataFrame, size: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """(event_type, window_start, n, ids) per tumbling or sliding window of ts."""
    if watermark:
        df = df.withWatermark("ts", watermark)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return df.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).select("event_type", F.col("w.start").alias("window_start"), "n", "ids")


def delivery_sessions(df: DataFrame, key: str, gap: str, watermark: str | None = None) -> DataFrame:
    """(key, session_start, session_end, n, ids) per run of a key's rows that are a gap apart at most.

    A session ends a gap after its last row. In a stream, sessions that come to touch are
    merged in the state, and one is returned when the watermark has passed its end.
    """
    if watermark:
        df = df.withWatermark("ts", watermark)
    merged = df.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    return merged.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "ids")
