"""Debounced batches of file events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUIET, LATENESS = "400 milliseconds", "5 seconds"


def debounce(events: DataFrame, key: str = "repo_id", ts: str = "ts", quiet: str = QUIET, lateness: str = LATENESS) -> DataFrame:
    """A row per key and burst of events: a burst ends when it has been quiet. On a stream the watermark bounds the
    state; a batch needs none. (key, opened, closed, n)"""
    rows = events.withWatermark(ts, lateness) if events.isStreaming else events
    w = F.session_window(ts, quiet)
    return rows.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last")).select(key, F.col("w.start").alias("opened"), F.col("last").alias("closed"), "n")
