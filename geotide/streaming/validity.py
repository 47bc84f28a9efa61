"""Streams of timed features: validity windows with late data, by the same calendar rules as batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed(events: DataFrame, time: str, width: str, value: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """t1, t2, n, mean of a value by tumbling or sliding window; works on static and streaming frames."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = source.groupBy(window).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    edge = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return out.select(edge(F.col("window.start")).alias("t1"), edge(F.col("window.end")).alias("t2"), "n", "mean")
