"""Streaming extension: a manifest of files as they arrive, and windowed stage timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import pdf


def stream_manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row for each PDF that arrives below root: pages and error."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    return pdf.read_pages(files)


def windowed_timings(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts and mean values for each window and kind; late rows are kept up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")
