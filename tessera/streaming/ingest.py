"""Incremental ingest: a file-source stream whose batches are merged into a partitioned store of file rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.corpus import changed, file_rows
from tessera.schemas import struct
from tessera.session import cut, shared_folder
from tessera.sources.store import Store, Table

__all__ = ["ingest", "merge_batch", "shared_folder", "snapshot", "store_of"]


def store_of(spark: SparkSession, root: str, parts: int = 16) -> Store:
    store = Store(spark, root, {"file": Table(struct("path string;name string;extension string;hash string;size long"), "path")}, parts=parts)
    if not store.exists():
        store.create()
    return store


def merge_batch(spark: SparkSession, batch: DataFrame, root: str) -> None:
    """Merges one batch of (path, content) into the store: the partitions of new and changed files are rewritten. Repeating a batch changes nothing."""
    store = store_of(spark, root)
    # of several rows for a path in one batch the last by hash counts, so the outcome doesn't depend on their order
    incoming = file_rows(batch).groupBy("path").agg(F.max_by(F.struct("name", "extension", "hash", "size"), "hash").alias("_r")).select("path", "_r.*")
    fresh = cut(changed(incoming, store.table("file")))
    store.replace(fresh, {"file": fresh})


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    return store_of(spark, root).table("file")


def ingest(spark: SparkSession, source: str, schema: str, store: str, path, content) -> DataFrame:
    """Runs a stream over the Parquet files of a directory until it has seen all that is there, and returns the snapshot. path, content: columns of it."""
    rows = spark.readStream.schema(schema).parquet(source).select(path.alias("path"), content.alias("content"))
    query = rows.writeStream.foreachBatch(lambda batch, _: merge_batch(batch.sparkSession, batch, store)).option("checkpointLocation", os.path.join(store, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return snapshot(spark, store)
