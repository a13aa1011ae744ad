"""Structured Streaming: new files of a folder, probed and appended as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import limits
from ..operators.tiff_columns import tiff_info

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arrivals(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("tif", "tiff"), per_trigger: int = 1000) -> DataFrame:
    """New files as a stream, with their format."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True)
    files = reader.option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").option("maxFilesPerTrigger", per_trigger).load(path)
    return files.withColumn("format", limits.sniff(F.col("content")))


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Append the probe of every new file to a Parquet table; ends when all present are read."""
    probed = arrivals(spark, path, **options).select("path", "length", "format", tiff_info(F.col("content")).alias("info"))
    return probed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
