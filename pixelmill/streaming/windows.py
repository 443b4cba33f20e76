"""Streams: windowed histograms of events, and images decoded and measured as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def histogram(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours", bins: int = 16, top: float = 100.0) -> DataFrame:
    """start, bin, n: counts of values in equal bins for each tumbling or sliding window.

    ``events`` may be a batch or a stream; on a stream rows later than ``late`` behind the newest are dropped and windows
    come out once (append mode).  State is bounded by the windows within the watermark times the bins.
    """
    bin_ = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col("value") * bins / top))).cast("long")
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(span.alias("w"), bin_.alias("bin")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "bin", "n")


def image_stream(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Encoded images as a stream of path, modificationTime, length, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
