"""Files as tables: scans with their formats, and a sink that writes one file a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import limits


def scan(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("tif", "tiff"), max_bytes: int | None = None) -> DataFrame:
    """path, modificationTime, length, content, format of every file below a folder.

    The size limit is a pushed filter on ``length``: larger files are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(path)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    return files.withColumn("format", limits.sniff(F.col("content")))


def listing_difference(left: DataFrame, right: DataFrame, on: str = "path") -> DataFrame:
    """Files of one listing that the other lacks."""
    return left.join(right.select(on), on, "left_anti")
