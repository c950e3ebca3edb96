"""Request quotas over an event stream: counts a user and window, with late events dropped by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quota_windows(events: DataFrame, limit: int, window: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """(start, user_id, requests, over_quota) of every fixed window; works on a stream and on a table."""
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), "user_id").agg(F.count("*").alias("requests"))
    return counted.select(F.col("w.start").alias("start"), "user_id", "requests", (F.col("requests") > limit).alias("over_quota"))


def first_seen(events: DataFrame, key: str, lateness: str = "10 minutes") -> DataFrame:
    """Events whose key hasn't been seen within the watermark: the state behind continued lookups."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])
