"""Event-time windows; the same plan runs on a batch and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """hour (since the epoch), event_type, n and total of tumbling windows; on a stream, events later than `late` are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    out = rows.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.floor(F.unix_timestamp("window.start") / 3600).alias("hour"), "event_type", "n", "total")
