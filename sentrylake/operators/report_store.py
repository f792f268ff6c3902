"""Whole reports of differing shape in one VARIANT column: kept as they came, read by path.

Scanners of three generations wrote their counters in three places; nothing is lost by fitting them into columns
when they arrive, and a reader says once where each counter may stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import COUNTERS

#: Where a counter may stand, by generation; {} is its name.
PLACES = ("$.summary.{}", "$.scan.counts.{}", "$.{}_files")
KEYS = ("tenant_id", "scan_id")


def parsed(rows: DataFrame, column: str = "report") -> DataFrame:
    """``rows`` with the JSON text of ``column`` as VARIANT; text that is no JSON becomes null and stays visible as ``broken``."""
    return rows.withColumn("broken", F.col(column).isNotNull() & F.try_parse_json(column).isNull()).withColumn(column, F.try_parse_json(column))


def counter(name: str, column: str = "report") -> Column:
    """A counter of a report, wherever its generation keeps it; 0 if none does."""
    found = [F.try_variant_get(column, place.format(name), "bigint") for place in PLACES]
    if name == "total_files":
        found.append(F.try_variant_get(column, "$.total", "bigint"))
    return F.coalesce(*found, F.lit(0))


def counters(reports: DataFrame) -> DataFrame:
    """The keys of stored reports, their generation and their counters as columns."""
    generation = F.coalesce(F.try_variant_get("report", "$.version", "int"), F.lit(1))
    return reports.select(*KEYS, "created_at", generation.alias("generation"), *[counter(c).alias(c) for c in COUNTERS])


def keep_last(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``stored`` with ``incoming`` in place of reports of the same tenant and scan; of several that come at once the last by
    ``created_at``, then by its text."""
    last = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("created_at"), F.desc(F.to_json("report"))))
    newest = incoming.withColumn("_place", last).where("_place = 1").drop("_place")
    return stored.join(newest.select(*KEYS), list(KEYS), "left_anti").unionByName(newest)


def shapes(reports: DataFrame) -> DataFrame:
    """shape, reports: the schemas that stored reports have, most frequent first."""
    return reports.groupBy(F.schema_of_variant("report").alias("shape")).agg(F.count(F.lit(1)).alias("reports")).orderBy(F.desc("reports"), "shape")
