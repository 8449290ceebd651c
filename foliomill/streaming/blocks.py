"""Ours, not the reference's: findings over an arriving table, with a watermark, as a streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_findings(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Per window and type: how many events came, and how many have a value that is missing or under zero."""
    bad = F.count_if(F.col("value").isNull() | (F.col("value") < 0))
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), bad.alias("n_bad")).select(F.col("window.start").alias("start"), "event_type", "n", "n_bad")
