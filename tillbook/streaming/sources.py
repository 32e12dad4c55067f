"""File streams of the day book."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.sources import testbed


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events as they arrive in files under ``path``, with the day book's columns."""
    reader = spark.readStream.schema(testbed.SCHEMAS["events"])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return testbed.day_events(reader.parquet(path))


def with_event_time(df: DataFrame, col: str, delay: str) -> DataFrame:
    """Watermarked event time; streams need an instant, not a local time."""
    return df.withColumn(col, F.col(col).cast("timestamp")).withWatermark(col, delay)
