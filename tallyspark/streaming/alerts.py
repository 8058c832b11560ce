"""Streams over the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def failures_by_window(events: DataFrame, window: str = "1 day", slide: str | None = None, least: int = 3, late: str = "2 days", kind: str = "LOGIN_FAILED") -> DataFrame:
    """(actor_id, start, n) per window of event time; works on a stream (late rows up to the watermark) and on a table alike."""
    kept = events.where(F.col("event_type") == kind)
    kept = kept.withWatermark("created_at", late) if events.isStreaming else kept
    span = F.window("created_at", window, slide) if slide else F.window("created_at", window)
    return kept.groupBy("actor_id", span.alias("w")).agg(F.count("*").alias("n")).where(F.col("n") >= least).select("actor_id", F.col("w.start").alias("start"), "n")


def rule_counter(reviews: DataFrame) -> DataFrame:
    """(field_id, signature, n): how often an equivalence was approved. Update mode keeps the table current."""
    return reviews.groupBy("field_id", "signature").agg(F.count("*").alias("n"))
