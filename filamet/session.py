"""Session helper for tests, the bench and local use."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, app: str = "filamet", partitions: int | None = None) -> SparkSession:
    """A local session.  On a cluster, pass in the session the cluster gives you instead."""
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FILAMET_DRIVER_MEMORY", "12g"))
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .getOrCreate()
    )


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from its folder, whatever folder the driver was started in.

    On a cluster the package is installed or shipped with ``--py-files``; an unknown path does no harm.
    """
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def tune(spark: SparkSession) -> None:
    """Adaptive settings the operators count on.

    A join of rows with a per-group table followed by an aggregate on the same key would keep a
    hot group in one task; forcing the skew split lets Spark deal such a group out over tasks.
    """
    find_package(spark)
    for key in ("adaptive.enabled", "adaptive.skewJoin.enabled", "adaptive.forceOptimizeSkewedJoin"):
        spark.conf.set(f"spark.sql.{key}", "true")


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may leave it unset and gets
    a temporary folder; elsewhere executors do not share the driver's disk, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(root)
    return root


def stored(df, name: str = "table"):
    """Write a table once to the shared folder and read it back; unlike a checkpoint it is computed once."""
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df):
    """Reliable checkpoint: survives the loss of executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
