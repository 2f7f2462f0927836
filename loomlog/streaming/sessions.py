"""Streams of events: activity by session and by billing block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def session_activity(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events of each user in windows that close after ``gap`` without one (user_id, ts, event_type)."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "errors")


def billing_blocks(events: DataFrame, block: str = "5 hours", late: str = "1 hour") -> DataFrame:
    """Events and value in fixed blocks (ts, value)."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", block).alias("w"))
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "n", "value")
