"""Counts of what a filter leaves out, taken in the pass that filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def filtered(rows: DataFrame, reasons: dict[str, Column], name: str = "filtered") -> tuple[DataFrame, Observation]:
    """The rows that none of ``reasons`` (conditions to leave a row out) holds for, and an observation of them.

    A row counts under the first reason that holds; null is no. The observation has ``seen``, ``kept`` and a number for
    each reason, once an action on the rows has read them all; until then its ``get`` waits. No second scan is made.
    """
    first = reduce(lambda case, kv: case.when(kv[1], kv[0]), reasons.items(), F.when(F.lit(False), ""))
    told = rows.withColumn("_left_out", first)
    seen = Observation(name)
    counts = [F.count(F.lit(1)).alias("seen"), F.count_if(F.col("_left_out").isNull()).alias("kept")]
    counts += [F.count_if(F.col("_left_out") == r).alias(r) for r in reasons]
    return told.observe(seen, *counts).where(F.col("_left_out").isNull()).drop("_left_out"), seen


def as_rows(spark: SparkSession, seen: Observation) -> DataFrame:
    """name, files: the numbers of an observation, as a table."""
    return spark.createDataFrame(sorted((k, int(v)) for k, v in seen.get.items()), "name string, files long")
