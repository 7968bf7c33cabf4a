"""Streaming twins of the batch operators."""

from __future__ import annotations

from pyspark.sql import SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def require_rocksdb(spark: SparkSession) -> None:
    """Stateful processors keep several kinds of state, which only this store can."""
    spark.conf.set(STATE_STORE, ROCKSDB)
