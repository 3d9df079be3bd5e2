"""Requests per client in fixed one-minute buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def over_quota(events: DataFrame, limit: int = 100, seconds: int = 60, late: str = "5 minutes") -> DataFrame:
    """Clients with more than ``limit`` requests in a bucket.

    Works on a table and on a stream; a stream is bounded by a watermark, which the
    caller widens when events may arrive later. Counts are combined map-side.
    """
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    counts = events.groupBy("client", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > limit).select("client", F.col("w.start").alias("window_start"), "n")
