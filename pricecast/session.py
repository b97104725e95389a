"""SparkSession construction and checkpoint-directory handling.

On a cluster the session is created by the platform; ``get_session`` then
just returns it. The local defaults (UI off, UTC, AQE on, 8 shuffle
partitions) are only applied when this module builds the session itself.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "pricecast") -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = (
        SparkSession.builder.appName(app_name)
        .master(master or os.environ.get("PRICECAST_MASTER", "local[8]"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PRICECAST_DRIVER_MEM", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; invent one only in local mode.

    A machine-local folder is never used on a cluster: executors could not
    read each other's checkpoint files after a loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if sc.master != "local" and not sc.master.startswith("local["):   # local-cluster is a cluster
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="pricecast-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path


def together(spark: SparkSession, *steps: Callable[[], Any]) -> list[Any]:
    """The results of steps that do not need each other, each run from a thread of its own: the
    jobs of one fill the cores that the other's short jobs leave idle. The first error is raised."""
    with ThreadPool(len(steps)) as pool:
        return pool.map(lambda step: step(), [inheritable_thread_target(spark)(step) for step in steps], chunksize=1)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by writing ``df`` as a Parquet table under the checkpoint dir.

    The folder is the shared one the cluster names in ``spark.checkpoint.dir``
    (never a machine-local temp dir on a cluster), so the table survives an
    executor loss. Parquet is used rather than an RDD checkpoint: it is
    columnar and compressed, and Spark writes it in one job (an eager RDD
    checkpoint runs a second job and serializes rows generically).
    """
    base = ensure_checkpoint_dir(df.sparkSession)
    path = f"{base.rstrip('/')}/pricecast-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path)
