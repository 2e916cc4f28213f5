"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import gradeloom

BATCH_BYTES = "8m"


def prepare(spark: SparkSession) -> SparkSession:
    """What the operators need of a session.

    A repeated JSON key keeps its last value, and Python functions of this package travel
    with the tasks, so that workers need not have it installed. Python gets rows in batches of
    so many bytes, or one row if it is longer, since it holds a batch several times over.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    cloudpickle.register_pickle_by_value(gradeloom)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only where the cluster names none (a local test session) is a temporary folder made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="gradeloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, so that no run meets another run's files."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str):
    """Write once, read back: cuts lineage and fixes the output of non-repeatable work."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate tables that are of use for a while only: ``clear``, or leaving the block,
    removes their files. The shuffle files of the job that writes a table go with its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.clear()

    def save(self, df, name: str):
        """Write once, read back, as ``materialize``."""
        before = self.spark.conf.get(_REMOVE_SHUFFLES, "false")
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        self.spark.conf.set(_REMOVE_SHUFFLES, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_REMOVE_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        while self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
