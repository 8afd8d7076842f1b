"""Exports that keep arriving: the row-local operators over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folia.operators import explode


def read_stream(spark: SparkSession, folder: str, schema: StructType, files: int = 100) -> DataFrame:
    """Parquet exports as they arrive in a folder, so many files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def first_delivery(stream: DataFrame, key: str, at: str, late: str = "30 days") -> DataFrame:
    """Each record once; the state of a key is kept until the watermark has passed it."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def stream_keywords(stream: DataFrame, pub_id: str, cell: str) -> DataFrame:
    """(pub_id, keyword) rows of new records."""
    return explode.keywords(stream, pub_id, cell)


def keyword_counts(stream: DataFrame, cell: str, at: str, window: str = "7 days", late: str = "30 days") -> DataFrame:
    """(window, keyword, n) by tumbling windows of the delivery time."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    words = timed.select(at, F.explode(F.split(F.lower(F.coalesce(cell, F.lit(""))), ";")).alias("w")).select(at, F.trim("w").alias("keyword"))
    return words.filter("keyword != ''").groupBy(F.window(at, window).alias("window"), "keyword").agg(F.count("*").alias("n"))
