"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a new one only where that is unset (local mode)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet and read back: rows and their order in files are fixed from here on, whatever
    executors are lost later."""
    path = f"{shared_root(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """Intermediate tables that go together, once what they were for is written. lazy: that is not written, but
    reads them whenever it is read, so they stay."""

    def __init__(self, spark: SparkSession, name: str, lazy: bool = False):
        self.lazy = lazy
        self.spark, self.folder = spark, f"{shared_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """df, written outside of the folder, which is deleted whether or not that succeeds; lazy: df as it is."""
        if self.lazy:
            return df
        try:
            return materialise(df, name)
        finally:
            self.drop()

    def drop(self) -> None:
        delete(self.spark, self.folder)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
