"""Structured Streaming over fragment files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionspark.operators import qc, quantify
from regionspark.sources.fragments import SCHEMA


def fragment_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    from pyspark.sql.types import StructType

    return spark.readStream.schema(StructType(SCHEMA.fields[:5])).option("sep", "\t").option("comment", "#").option("maxFilesPerTrigger", max_files).csv(folder)


def running_counts(stream: DataFrame) -> DataFrame:
    """Per barcode counts so far; the state has a row for each barcode."""
    return qc.count_fragments(stream)


def running_bins(stream: DataFrame, width: int = 5000) -> DataFrame:
    """Tile counts so far."""
    return quantify.bin_matrix(stream, width)


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts by event-time window and chromosome of timed fragments; rows later than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), "chrom").agg(F.count(F.lit(1)).alias("n"))
