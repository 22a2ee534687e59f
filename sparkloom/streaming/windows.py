"""Event-time aggregation for streams and batches alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, value: str, width: str, late: str | None = None) -> DataFrame:
    """Count and sum per tumbling window and key. On a stream rows later than ``late`` are dropped by the watermark."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp"))
    if late:
        rows = rows.withWatermark("__t", late)
    out = rows.groupBy(F.window("__t", width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str) -> DataFrame:
    """Sessions of a key: events closer than ``gap``; number of events and first time."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp"))
    return rows.groupBy(F.session_window("__t", gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), "n")
