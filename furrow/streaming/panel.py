"""The weekly panel from a stream of daily facts, beyond what the batch plans need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_stream(events: DataFrame, time: str, key: str, value: str, late: str = "7 days") -> DataFrame:
    """Mean, sum and rows of value by key and Monday week of an event-time stream; a week closes when the watermark passes it.

    Weeks are tumbling windows that start on Mondays. Rows later than the
    watermark are dropped by Spark, as in any windowed aggregation.
    """
    week = F.window(F.col(time), "7 days", startTime="4 days")  # the epoch was a Thursday
    sums = events.withWatermark(time, late).where(F.col(key).isNotNull()).groupBy(key, week).agg(F.avg(value).alias(f"{value}_mean_week"), F.sum(value).alias(f"{value}_sum_week"), F.count(F.lit(1)).alias("rows_week"))
    return sums.select(key, F.col("window.start").alias("week_start"), f"{value}_mean_week", f"{value}_sum_week", "rows_week")
