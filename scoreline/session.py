"""Spark session and cluster-facing settings.

The session is configured for a cluster first: AQE on (partition coalescing,
skew-join splitting), UTC session time, Arrow for the few pandas hand-offs.
Shuffle width comes from the caller or the cluster defaults; only local test
runs pin it to the core count.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_CLUSTER_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


MB = 1 << 20


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application), so that functions
    named by import also run where the repository is not on the path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="scoreline-ship-"), "scoreline.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(here):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def scale_settings(input_bytes: int, total_cores: int, target_partition_mb: int = 256,
                   max_partitions: int | None = None) -> dict[str, str]:
    """Partition sizing from the input size and the cluster's cores.

    Scan splits and shuffle partitions aim at ``target_partition_mb`` each so a task's
    working set fits executor memory (and spills rarely); the initial shuffle width is
    at least two waves of cores (and at most ``max_partitions``, if given); AQE then
    coalesces small partitions toward the same advisory size and splits skewed join
    partitions.  Example: 100 TB on 1000 executors x 8 cores -> 381,469 shuffle partitions
    and scan splits of 256 MB.
    """
    want = max(1, input_bytes // (target_partition_mb * MB))
    parts = int(max(want, 2 * total_cores))
    if max_partitions:
        parts = min(parts, max_partitions)
    size = f"{target_partition_mb}m"
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{4 * target_partition_mb}m",
    }


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "scoreline", extra: dict | None = None,
              input_bytes: int | None = None, total_cores: int | None = None) -> SparkSession:
    """Return (or create) a session with the settings every operator assumes.

    On a cluster pass ``input_bytes`` and ``total_cores`` to size partitions with
    ``scale_settings``; local runs pass ``shuffle_partitions`` directly."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_CLUSTER_DEFAULTS)
    if input_bytes and total_cores:
        conf.update(scale_settings(input_bytes, total_cores))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", os.environ.get("SCORELINE_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # Operators compare dates and timestamps as wall-clock UTC values.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; set a scratch one only when unset.

    On a cluster the setting names a shared folder (HDFS/S3/...) that survives the
    loss of any executor, and its absence is an error.  Only a local run without the
    setting (tests, bench) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="scoreline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current
