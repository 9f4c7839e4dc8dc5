"""Incremental counters over a stream of events: an extension, as the batch counters have no streaming form of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_a_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def windowed_counters(events: DataFrame, *, time: str = "ts", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events, users and values by type in tumbling windows; events later than ``late`` are dropped."""
    return (
        events.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"), "event_type")
        .agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users"), F.sum("value").alias("value"))
        .select(F.col("w.start").alias("window_start"), "event_type", "events", "users", "value")
    )


def sessions(events: DataFrame, *, time: str = "ts", late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Each user's sessions: runs of events with gaps under ``gap``."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy("user_id", F.session_window(time, gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
