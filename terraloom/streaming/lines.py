"""Streams of line formats: features from WKT lines as files arrive, and windowed counts of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.core import GEOMETRY


def wkt_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Geometries of WKT lines of files that arrive in a folder; blank lines are skipped."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder).select(F.trim("value").alias("v")).where(F.length("v") > 0)
    return lines.select(C.wkb_of(F.col("v")).alias(GEOMETRY), F.current_timestamp().alias("read_at"))


def counts_by_type(stream: DataFrame, time: str = "read_at", window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Geometries by type and time window; a watermark bounds the state."""
    typed = stream.withColumn("type", C.type_name(F.col(GEOMETRY)))
    return typed.withWatermark(time, late).groupBy(F.window(time, window), "type").agg(F.count("*").alias("n"))
