"""Session and scratch-location helpers.

Everything that has to be written between stages (checkpoints, materialised
layouts, streaming sources and sinks) goes under the shared folder named by
``spark.checkpoint.dir``.  That setting is read from the session; only when it
is unset (local tests) do we create a folder of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "quire", extra_conf: dict | None = None) -> SparkSession:
    """Session for tests and the bench: AQE on, UI off, UTC clock (``extra_conf`` e.g. an event log)."""
    builder = SparkSession.builder
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # AQE broadcasts a join side only after measuring it; 64 MB lets the
        # class-level ledger tables (groups x classes) broadcast instead of a
        # many-to-many sort-merge join
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "64MB")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; where it is unset, create one in local mode and fail on a cluster."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get(_CKPT_KEY, None) or spark.conf.get(_CKPT_KEY, None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"{_CKPT_KEY} must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="quire-ckpt-", dir="/tmp")
        spark.conf.set(_CKPT_KEY, configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the session's Python workers this package, once per application.

    Functions that run in workers are pickled by reference, so a worker started
    anywhere must be able to import the package.  It travels as a zip over
    Spark's own file distribution.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="quire-ship-"), "quire.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def ensure_parallel(df, min_partitions: int | None = None, by=None):
    """Spread ``df`` when it arrives in fewer partitions than the cluster can run.

    A single large file (e.g. one parquet file of long texts) is scanned as one
    split, so every downstream narrow operator runs in one task.  When the
    planned partition count is below ``min_partitions`` (default: the default
    parallelism) the rows are round-robin repartitioned; on a real cluster with
    many input splits this is a no-op.  Call it on scans: on a plan that
    already holds a shuffle, adaptive execution would run that shuffle just to
    count partitions.  ``by``: spread by these columns instead of round-robin,
    so a later grouping that includes them needs no further shuffle.
    """
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want, *by) if by else df.repartition(want)
    return df


def materialize(df, name: str):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    For an intermediate that several consumers read (each would otherwise
    re-run its shuffles); also cuts the lineage, so a lost executor re-reads
    the files instead of recomputing upstream stages.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
