"""Session helpers: building a local session for tests/bench, table paths, and
the shared scratch location (always under ``spark.checkpoint.dir``)."""

from __future__ import annotations

import os
import uuid
from typing import Optional

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "jobsight", checkpoint_dir: Optional[str] = None) -> SparkSession:
    """A session for tests and the bench. On a cluster, use the cluster's
    session instead; operators never change session configuration."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, split as ``spark.sql.files.maxPartitionBytes`` says."""
    return spark.read.parquet(table_path(sf_dir, name))


def app_key(spark: SparkSession) -> str:
    """Identity of the running application (for per-session plan reuse)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:                      # e.g. a Spark Connect session
        return f"session-{id(spark)}"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the session names none, a local session (driver and executors in one
    process) uses a folder of its warehouse; a cluster without a shared folder
    is an error, as executors could not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:                      # e.g. a Spark Connect session
        sc = None
    if not root and sc is not None:
        root = sc.getCheckpointDir() or None
    if not root:
        if sc is None or not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


_CLEARED: set = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder of this application under the shared checkpoint
    root; all of them are deleted when the application ends."""
    base = f"{checkpoint_root(spark).rstrip('/')}/jobsight-{app_key(spark)}"
    if base not in _CLEARED:
        _CLEARED.add(base)
        try:
            jvm = spark._jvm
            folder = jvm.org.apache.hadoop.fs.Path(base)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
        except Exception:                  # no JVM at hand (Spark Connect): the folder stays
            pass
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
