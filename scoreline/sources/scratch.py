"""Intermediate tables of one run, written to the cluster's shared folder.

A written table cuts the lineage and survives the loss of executors; it is deleted as soon
as the table made from it is written.  The tables that a lazy result still reads go when the
application ends, or with ``close``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scoreline.session import ensure_checkpoint_dir

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Tables:
    """Written tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self) -> str:
        """A new place of this run."""
        self.n += 1
        return f"{self.root}/{self.n}"

    def put(self, df: DataFrame, *done: DataFrame) -> DataFrame:
        """Write ``df``, read it back, and delete the tables ``done`` that it was made of.

        Shuffle files of the writing job are removed when it ends (they are not needed
        again: the table replaces its lineage)."""
        path = self.path()
        before = self.spark.conf.get(CLEAN, None)
        self.spark.conf.set(CLEAN, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEAN)
            else:
                self.spark.conf.set(CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written = path
        if self.n == 1:
            at_exit(self.spark, self.root)
        self.drop(*done)
        return out

    def close(self) -> None:
        """Delete all tables of the run, once nothing reads them any more."""
        delete(self.spark, self.root)

    def drop(self, *done: DataFrame) -> None:
        for d in done:
            delete(self.spark, d._written)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def at_exit(spark: SparkSession, path: str) -> None:
    """Have an existing folder deleted when the application ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
