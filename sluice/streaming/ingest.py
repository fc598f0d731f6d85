"""Incremental loading: a file stream, and running totals that a replay does not change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Keeps state on the executors' disks rather than in their heap, and its changes in the checkpoint's folder.
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str, files_per_batch: int = 100) -> None:
    """Append new Parquet files of `source` to `target`, each key once, and stop when all are read.

    The keys met so far are the stream's state, kept by key in the checkpoint's folder, so a batch looks up its own keys
    and never reads the target. The batch's number is part of the written folder: a batch that runs again starts
    from the same state and replaces its own rows. Rows without a key are one key.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source).dropDuplicates([key])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={number}")

    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STATE_STORE, before)
    query.awaitTermination()


def stored_rows(spark: SparkSession, target: str) -> DataFrame | None:
    """Rows written so far, or None before the first batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.option("basePath", target).parquet(target)


def add_totals(stored: DataFrame, batch: DataFrame, keys: list[str], seen: DataFrame, row_key: str) -> DataFrame:
    """Stored sums (keys, amt, txs) with a batch of rows (keys, row_key, tx_amt) added; rows already counted are left out."""
    fresh = batch.dropDuplicates([row_key]).join(seen.select(row_key), row_key, "left_anti")
    part = fresh.groupBy(*keys).agg(F.sum("tx_amt").alias("amt"), F.count("*").alias("txs"))
    both = stored.select(*keys, "amt", "txs").union(part.select(*keys, "amt", "txs"))
    return both.groupBy(*keys).agg(F.sum("amt").alias("amt"), F.sum("txs").alias("txs"))
