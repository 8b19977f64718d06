"""Spark session helpers.

On a cluster the session is created by the platform; these helpers only fill
in settings that are unset, so a cluster's own values always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults used when this library creates the session itself (tests, bench).
_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def get_spark(master: str | None = None, app: str = "tessera", **conf: str) -> SparkSession:
    """Return the active session or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(_LOCAL_DEFAULTS)
    settings.update(conf)
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only when unset.

    On a cluster the setting names a shared folder (HDFS/S3/...) that survives
    executor loss. Only in local runs (tests, bench) do we fall back to a
    fresh scratch folder under /tmp.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; set it to a shared folder on the cluster"
        )
    path = tempfile.mkdtemp(prefix="tessera-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def materialize(df):
    """Cut lineage with a reliable checkpoint in ``spark.checkpoint.dir``.

    Used where a result is read by several branches of a plan or by many
    passes (tree learners), so it is computed once and survives executor
    loss. Never ``localCheckpoint``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df, *cols):
    """Hash-partition narrow rows by ``cols`` before a CPU-heavy expansion.

    An explicit partition count (the session's shuffle partitions) keeps
    AQE from coalescing the small pre-expansion shuffle into a few tasks;
    later windows and aggregates on the same keys reuse the partitioning.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(n, *cols)
