"""A scan after a scan: only new and changed contents are read again.

A store is a folder of versions and a small file ``CURRENT`` that names the one to read. A version is
written whole and then named by a rename, so readers see the old or the new one, never a mixture, and a job
that dies leaves the old one. Findings are kept by place and checksum; access rights, ages and scores
follow from what the new scan says of every file, for they may change while the content stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import props
from ..sources import stored
from . import findings, risk

POINTER = "CURRENT"


def current(spark: SparkSession, store: str) -> DataFrame | None:
    """The table that the store names; None if there is none yet."""
    if not stored.exists(spark, f"{store}/{POINTER}"):
        return None
    version = spark.read.text(f"{store}/{POINTER}").first()["value"]
    return spark.read.parquet(f"{store}/{version}")


def publish(spark: SparkSession, rows: DataFrame, store: str) -> DataFrame:
    """Write ``rows`` as the store's new version and name it; returns it as read from there.

    The version before stays until :func:`tidy`, for readers that have begun.
    """
    version = f"v-{uuid.uuid4().hex}"
    rows.write.parquet(f"{store}/{version}")
    name = f"{store}/.{version}"
    at, system = stored._at(spark, name)
    out = system.create(at)
    out.write(bytearray(version.encode()))
    out.close()
    stored.rename(spark, name, f"{store}/{POINTER}", overwrite=True)
    return spark.read.parquet(f"{store}/{version}")


def tidy(spark: SparkSession, store: str) -> int:
    """Delete the versions that the store does not name; returns how many."""
    named = spark.read.text(f"{store}/{POINTER}").first()["value"]
    at, system = stored._at(spark, store)
    old = [s.getPath().toString() for s in system.listStatus(at) if s.getPath().getName().startswith("v-") and s.getPath().getName() != named]
    for path in old:
        stored.remove(spark, path)
    return len(old)


def _pair(rows: DataFrame) -> list:
    return [props.compare_key().alias("key"), F.lower(F.trim("sha256")).alias("hash")]


def refresh(spark: SparkSession, store: str, records: DataFrame, classify: Callable[[DataFrame], DataFrame] = findings.classify) -> tuple[DataFrame, Observation]:
    """Assess ``records`` (normalised, with content) into the store, detecting only where place or checksum is new.

    Returns the new table, whose ``fresh`` says which rows were detected now, and an observation with their number
    (``detected``). Files that are gone drop out; without a checksum a file is always detected.
    """
    known = current(spark, store)
    detected = Observation("detected")
    light = [c for c in records.columns if c != "content"]
    if known is None:
        fresh, reused = records, None
    else:
        # of stored rows with one place and checksum any will do: their texts are equal
        old = known.select(*_pair(known), "findings").where("hash <> ''").dropDuplicates(["key", "hash"])
        # checksums alone decide; texts of what stays are never read
        fresh = records.select("*", *_pair(records)).join(old.select("key", "hash"), ["key", "hash"], "left_anti").drop("key", "hash")
        reused = records.select(*light, *_pair(records)).join(old, ["key", "hash"]).select(*light, "findings", F.lit(False).alias("fresh"))
    found = classify(fresh.observe(detected, F.count(F.lit(1)).alias("detected"))).withColumn("fresh", F.lit(True)).select(*light, "findings", "fresh")
    every = found if reused is None else found.unionByName(reused)
    return publish(spark, risk.assess(every), store), detected
