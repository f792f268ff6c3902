"""Tables an operator writes between its steps, in the folder all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else that of the context's checkpoints.

    Where both are unset a temporary folder serves, but only for a local master: on
    a cluster other machines could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/sentrylake/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


#: Makes Spark delete the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a write go once it is done: what it wrote stands for them."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: its lineage ends at the written files,
    which outlive any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _own_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def materialise_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """:func:`materialise`, in ``buckets`` files by ``key``: joins on it need not shuffle the table again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"{name}_{uuid.uuid4().hex}"
    with _own_shuffles(spark):
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._scratch_path, out._scratch_table = path, table
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path:
            spark = table.sparkSession
            if hasattr(table, "_scratch_table"):
                spark.sql(f"DROP TABLE IF EXISTS `{table._scratch_table}`")
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
