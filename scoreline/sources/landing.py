"""Sinks and incremental landing.

``write_table`` replaces / appends / refuses like the reference's table writer,
returning the row count from an ``Observation`` collected while writing (no
second scan).  Raw zones are written with real ``season=...`` directories so
a season filter prunes files.  ``land_new`` appends only ids not landed yet, so
a re-run is a no-op and nothing already written is rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scoreline.operators.pairing import new_ids

_MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def write_table(df: DataFrame, path: str, if_exists: str = "replace",
                partition_by: list[str] | None = None, fmt: str = "parquet") -> int:
    """Write ``df`` to ``path``; returns the number of rows written."""
    obs = Observation("rows_written")
    w = df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode(_MODES[if_exists]).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return int(obs.get["n"])


def table_exists(spark: SparkSession, name_or_path: str) -> bool:
    """Catalog table, or a path that holds a dataset (one that cannot be read raises)."""
    if "/" not in name_or_path:
        return spark.catalog.tableExists(name_or_path)
    path = spark._jvm.org.apache.hadoop.fs.Path(name_or_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return False
    spark.read.parquet(name_or_path).schema  # noqa: B018 - unreadable data must surface
    return True


def land_new(spark: SparkSession, incoming: DataFrame, path: str, key: str,
             partition_by: list[str] | None = None) -> int:
    """Append the rows of ``incoming`` whose ``key`` is not in the landed dataset."""
    if table_exists(spark, path):
        landed = spark.read.parquet(path).select(key)
        fresh = incoming.join(new_ids(incoming.select(key).distinct(), landed, key),
                              on=key, how="left_semi")
        return write_table(fresh, path, "append", partition_by)
    return write_table(incoming, path, "fail", partition_by)


MANIFEST = "run string, key string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def landed_ids(spark: SparkSession, path: str) -> DataFrame:
    """(run, key) of every row group that a finished run has landed."""
    fs, p = _fs(spark, f"{path}/manifest")
    if not fs.exists(p):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{path}/manifest")


def read_landed(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of finished runs; what an unfinished run has written is not seen."""
    fs, p = _fs(spark, f"{path}/manifest")
    runs = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    parts = [f"{path}/data/{r}" for r in runs if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(
        f"{path}/data/{r}"))]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def land_run(spark: SparkSession, incoming: DataFrame, path: str, key: str, run: str,
             step: Callable[[str], None] = lambda name: None) -> int:
    """Land the rows of ``incoming`` whose ``key`` no finished run has landed; returns their number.

    A run has three steps: its rows (under its own name, replaced if the run is repeated), the
    list of its keys aside, and the move of that list into the manifest, which makes the run
    count.  A run that dies at any place and is repeated under its name neither loses nor doubles
    rows; a finished run that is repeated does nothing.  ``step`` is called after each of them."""
    fs, done = _fs(spark, f"{path}/manifest/{run}")
    if fs.exists(done):
        return 0
    fresh = incoming.join(landed_ids(spark, path).select(F.col("key").alias("landed")),
                          F.col(key).cast("string") == F.col("landed"), "left_anti")
    n = write_table(fresh, f"{path}/data/{run}", "replace")
    step("data")
    wrote = spark.read.schema(fresh.schema).parquet(f"{path}/data/{run}")
    aside = f"{path}/aside/{run}"
    write_table(wrote.select(F.lit(run).alias("run"), F.col(key).cast("string").alias("key")).distinct(),
                aside, "replace")
    step("keys")
    fs.mkdirs(done.getParent())
    if not fs.rename(_fs(spark, aside)[1], done):
        raise OSError(f"run {run}: its manifest could not be moved")
    step("manifest")
    return n


def read_sql(spark: SparkSession, query: str, frames: dict[str, DataFrame] | None = None,
             **params) -> DataFrame:
    """SQL text over the catalog and ``frames`` (``{name}`` in the text; no session view is
    made), with named bound parameters (``:name``), e.g. ``WHERE season = :s``."""
    return spark.sql(query, args=params, **(frames or {}))
