"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keyed processors need a state store with column families; set it where it is not."""
    if "RocksDB" not in spark.conf.get(STATE_STORE, ""):
        spark.conf.set(STATE_STORE, ROCKSDB)


def placed(rows: DataFrame, key: str) -> DataFrame:
    """Rows that have a place in a sequence; the others are ``unplaced``."""
    return rows.where(F.col(key).isNotNull() & F.col("seq").isNotNull())


def unplaced(rows: DataFrame, key: str) -> DataFrame:
    """Rows without key or ``seq``, among them malformed lines, for an error output.

    The stateful streams leave them out.
    """
    return rows.where(F.col(key).isNull() | F.col("seq").isNull())
