"""Windows in event time, for streams and tables alike: late rows are dropped behind the watermark in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watched(events: DataFrame, time: str, late: str) -> DataFrame:
    return events.withWatermark(time, late) if events.isStreaming else events


def windows(events: DataFrame, length: str, slide: str | None = None, by: tuple[str, ...] = ("event_type",), time: str = "ts", late: str = "1 hour") -> DataFrame:
    """window_start, the grouping columns, events, total: tumbling windows, or sliding ones."""
    spans = F.window(time, length, slide) if slide else F.window(time, length)
    out = _watched(events, time, late).groupBy(spans.alias("_w"), *by).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("_w.start").alias("window_start"), *by, "events", "total")


def sessions(events: DataFrame, gap: str, by: tuple[str, ...] = ("user_id",), time: str = "ts", late: str = "1 hour") -> DataFrame:
    """session_start, session_end, the grouping columns, events: runs without a pause as long as the gap."""
    out = _watched(events, time, late).groupBy(F.session_window(time, gap).alias("_w"), *by).agg(F.count("*").alias("events"))
    return out.select(F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *by, "events")
