"""Spark session helpers.

Library code never creates a session; callers pass one in.  These helpers are
for tests, the bench and the entry module, and they only fill in settings that
the cluster has not already provided.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: AQE for runtime re-planning (partition
# coalescing, skew-join splitting, broadcast switch) and a fixed session zone
# so timestamp text is stable across executors.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "batchtrail") -> SparkSession:
    """Create (or reuse) a session for local runs and tests."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        # Local mode: the driver is the only JVM; bind it to loopback.
        builder = builder.config("spark.driver.host", "127.0.0.1")
        builder = builder.config("spark.driver.memory", os.environ.get("BATCHTRAIL_DRIVER_MEM", "16g"))
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is used as
    is.  When nothing is configured a local master (tests) gets a fresh scratch
    folder, a cluster a folder of the warehouse, which all its members see.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc.master.startswith("local"):
        configured = tempfile.mkdtemp(prefix="batchtrail-ckpt-")
    elif not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for an intermediate table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, as ``--py-files`` would: they need not have it installed
    or share the driver's folders."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="batchtrail-ship-"), f"batchtrail-{uuid.uuid4().hex[:8]}")
    spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", root, "batchtrail"))
    _SHIPPED.add(app)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, whoever reads it and however often, and
    a lost executor costs a re-read, not the work before."""
    path = scratch_table_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
