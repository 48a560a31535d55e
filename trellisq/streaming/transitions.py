"""Streaming form of the hourly statistics (an extension: the batch operators are in operators.stats)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, mean of a stream (or table) with ts, event_type, value.

    Rows later than ``late`` behind the newest are dropped by the watermark; null types
    and values are counted and left out of the mean.
    """
    held = events.withWatermark("ts", late) if events.isStreaming else events
    per = held.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return per.select(F.col("window.start").alias("window_start"), "event_type", "n", "mean")


def stream_table(spark, folder: str, schema) -> DataFrame:
    """A stream over the parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)
