"""Running counts of events by time window, as the streaming side of the arrival-time operators.

The batch engine joins neighbours by arrival; a stream of arrivals can be reduced to counts per
window and group first, with a watermark that bounds the state that late arrivals may reopen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_arrivals(events: DataFrame, time: str = "ts", group: str = "event_type", value: str = "value", width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Count and value sum for each window and group; works on batch and streaming frames."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    windows = events.withWatermark(time, lateness).groupBy(F.window(time, width), group)
    return windows.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), group, "n", "total")
