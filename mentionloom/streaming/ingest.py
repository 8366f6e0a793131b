"""Streaming ingestion: articles read as they arrive, counted per site and day of arrival, duplicates dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A stream over the parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type; later ones than the watermark are dropped, state is bounded by it."""
    # a watermark needs a timestamp of the session's zone
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("begin"), "event_type", "n", F.round("total", 6).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: parted by a gap without events."""
    # a watermark needs a timestamp of the session's zone
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


def new_articles(articles: DataFrame, late: str = "1 day") -> DataFrame:
    """Articles without the rows that repeat one, as they arrive."""
    if articles.isStreaming:
        return articles.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["article_id"])
    return articles.dropDuplicates(["article_id"])
