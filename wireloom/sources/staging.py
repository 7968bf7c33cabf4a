"""Intermediate tables in the shared folder the cluster names.

An intermediate result that several branches read is written once as parquet
and read back: columnar, prunable, and independent of the executors that
produced it.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


@functools.cache
def _own_root(application: str) -> str:
    return tempfile.mkdtemp(prefix="wireloom-")


def staging_root(spark: SparkSession) -> str:
    """The shared folder from ``spark.checkpoint.dir``.

    Where it is unset, a session whose driver and tasks are one process (tests)
    gets a temporary folder; a cluster is refused, because its machines would
    each see a folder of their own.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all machines share")
        root = _own_root(spark.sparkContext.applicationId)
    return root.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/wireloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the staging folder and return a scan of the written table."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
