"""Streams whose result does not depend on the order of arrival.

A first query splits the arriving rows before any state is touched: rows not older than the
newest time of all earlier batches less the allowed delay go on to the stateful queries, the
others into a side table.  The stateful queries read the rows that are on time with the same
delay as their watermark; as their watermark never passes the split's, they drop none of
them.  ``corrected`` then recomputes, as a batch, only the keys that late rows belong to.

Every batch is written under its number in one step (rows and newest time), so a batch that is
repeated after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreline.streaming.odds_stream import WATERMARK

FRONT = "batch long, newest timestamp, n_rows long"


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def front(spark: SparkSession, base: str) -> DataFrame:
    """(batch, newest, n_rows): newest event time and number of rows of every split batch."""
    if not _exists(spark, f"{base}/front/*"):
        return spark.createDataFrame([], FRONT)
    return spark.read.schema(FRONT).option("recursiveFileLookup", "true").parquet(f"{base}/front")


def split_late(spark: SparkSession, path: str, base: str, schema: T.StructType,
               max_files: int | None = None, delay: str = WATERMARK,
               time: str = "captured_at") -> None:
    """Run over everything available under ``path``; rows land in ``base``/rows.

    A row is late if its time is not after the newest time of the earlier batches less
    ``delay``.  Rows without a time are late."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def sink(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        seen = front(session, base).where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
        at = F.col(time).cast("timestamp")
        limit = F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = at.isNull() if seen is None else at.isNull() | (at <= limit)
        got = Observation(f"split-{batch_id}")
        (batch.withColumn("late", late)
         .observe(got, F.max(at).cast("long").alias("s"), F.max(at).alias("newest"),
                  F.count(F.lit(1)).alias("n"))
         .write.mode("overwrite").partitionBy("late").parquet(f"{base}/rows/b{batch_id:09d}"))
        newest = session.createDataFrame([(batch_id, got.get["newest"], got.get["n"])], FRONT)
        newest.write.mode("overwrite").parquet(f"{base}/front/b{batch_id:09d}")

    (reader.parquet(path).writeStream.foreachBatch(sink)
     .option("checkpointLocation", f"{base}/split_checkpoint").trigger(availableNow=True)
     .start().awaitTermination())


def on_time_path(base: str) -> str:
    """Where the rows that are on time lie: the source of the stateful queries."""
    return f"{base}/rows/b*/late=false"


def _side(spark: SparkSession, base: str, late: bool, schema: T.StructType) -> DataFrame:
    path = f"{base}/rows/b*/late={str(late).lower()}"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def late_rows(spark: SparkSession, base: str, schema: T.StructType,
              key: str = "snapshot_id") -> DataFrame:
    """Late rows once each, without those that also arrived on time (re-delivered rows)."""
    on_time = _side(spark, base, False, schema).select(key).distinct()
    return (_side(spark, base, True, schema).dropDuplicates([key])
            .join(on_time, key, "left_anti").select(*schema.names))


def corrected(spark: SparkSession, base: str, streamed: DataFrame, schema: T.StructType,
              aggregate: Callable[[DataFrame], DataFrame], keys: Sequence[str],
              key_of: Callable[[DataFrame], DataFrame], key: str = "snapshot_id") -> DataFrame:
    """The stream's result with the keys of late rows computed anew.

    ``aggregate`` is the stream's aggregation (on a batch), ``key_of`` gives each row its
    result keys.  Rows on time are read for the affected keys alone."""
    late = late_rows(spark, base, schema, key)
    touched = key_of(late).select(*keys).distinct()
    on_time = key_of(_side(spark, base, False, schema)).join(touched, list(keys), "left_semi")
    rows = on_time.select(*schema.names).unionByName(late).dropDuplicates([key])
    again = aggregate(rows)
    return (streamed.join(touched, list(keys), "left_anti").select(*again.columns)
            .unionByName(again))
