"""Streaming sigma scoring, an extension: points far from their window's mean, per series and tumbling window.

The watermark bounds the state; points later than it are dropped, as Structured Streaming does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_statistics(events: DataFrame, *, time: str = "ts", key: str = "user_id", value: str = "value", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(key, window, n, mean, std, low, high) per tumbling event-time window; works on streams and batches alike."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))  # a time without zone counts as session time
    grouped = timed.withWatermark(time, late).groupBy(F.window(time, window), F.col(key))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))


def suspicious(statistics: DataFrame, k: float = 2.0) -> DataFrame:
    """Windows whose extremes lie ``k`` deviations or more from their mean."""
    far = F.greatest(F.col("high") - F.col("mean"), F.col("mean") - F.col("low"))
    return statistics.where((F.col("std") > 0) & (far >= k * F.col("std"))).withColumn("excess", far / F.col("std"))
