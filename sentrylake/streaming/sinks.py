"""A table that a stream appends to, where a batch that comes twice adds nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import stored


def append_once(table: str, stream: str = "s") -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that adds each batch of a stream to ``table`` once.

    A batch is written under a hidden name and renamed to ``batch=<stream>-<number>``, which happens once: a batch that a
    restarted query repeats finds its name taken, and its work is dropped. Streams that share a table need names of their own.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own, name = f"{table}/.{uuid.uuid4().hex}", f"{table}/batch={stream}-{number}"
        if stored.exists(spark, name):
            return
        batch.write.parquet(own)
        if not stored.rename(spark, own, name):
            stored.remove(spark, own)

    return put


def appended(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The rows of the batches so far; none if nothing has arrived."""
    if not stored.exists(spark, table):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch string").parquet(table).drop("batch")
