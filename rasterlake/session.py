"""Makes the package importable by the Python workers of a session."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the workers once a context, unless their path has it."""
    root = Path(__file__).resolve().parent.parent
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.sparkContext.applicationId in _SHIPPED:
        return spark
    path = Path(tempfile.mkdtemp(prefix="rasterlake-")) / "rasterlake.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.glob("rasterlake/**/*.py")):
            archive.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(spark.sparkContext.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, or the one set on the context.

    Where neither is set, a temporary folder is, but only if driver and workers are one
    process: other executors could not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rasterlake-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Tables:
    """Tables of one call: compressed Parquet files in the shared folder, deleted at the end of the ``with`` block.

    What the call returns must not read them, so its last step is :func:`settled`.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def place(self) -> str:
        """A new folder, which goes at the end."""
        self.paths.append(f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}")
        return self.paths[-1]

    def write(self, df: DataFrame) -> DataFrame:
        path = self.place()
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        while self.paths:
            drop_folder(self.spark, self.paths.pop())


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a reliable checkpoint and read from there from now on.

    Its files go when nothing refers to the result any more: Spark's cleaner is asked for
    that, which by default leaves checkpoints behind.
    """
    shared_folder(df.sparkSession)
    df.sparkSession.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[Callable[[], list[str]]]:
    """Jobs started in the block carry ``tag``; call what it gives, from any thread, to stop them."""
    spark.addTag(tag)
    try:
        yield lambda: spark.interruptTag(tag)
    finally:
        spark.removeTag(tag)
