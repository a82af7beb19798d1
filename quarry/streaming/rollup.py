"""Usage rollups over a stream of events: an extension, the batch rollups are the reference's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_usage(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls and summed value by event type and time window; events later than ``late`` are left out.

    Works alike on a batch and on a stream of (ts, event_type, value).
    """
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return w.agg(F.count("*").alias("calls"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "calls", "value")


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event_id once, as far as repeats arrive within ``late`` of each other."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
