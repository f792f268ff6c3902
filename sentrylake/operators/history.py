"""Scans compared with each other: integrity, trends, portfolios, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import props
from .rollups import posture_from_counts

COUNTERS = ("critical", "high", "medium", "low", "total_files")


def indexed(records: DataFrame) -> DataFrame:
    """key, hash, doc_id, path, name of the files with a hash, the last (by doc_id) of each key."""
    rows = records.select(props.compare_key().alias("key"), F.lower(F.trim("sha256")).alias("hash"), "doc_id", "path", "name")
    last = rows.where(F.col("hash") != "").groupBy("key").agg(F.max_by(F.struct("hash", "doc_id", "path", "name"), F.col("doc_id")).alias("r"))
    return last.select("key", "r.*")


def changed(latest: DataFrame, earlier: DataFrame) -> DataFrame:
    """key, path, previous_hash, current_hash of files whose content differs between two scans."""
    before = indexed(earlier).select("key", F.col("hash").alias("previous_hash"))
    return indexed(latest).join(before, "key").where("hash <> previous_hash").select("key", "path", "previous_hash", F.col("hash").alias("current_hash"))


def only_in(one: DataFrame, other: DataFrame) -> DataFrame:
    """key, path of files of ``one`` whose key ``other`` does not have."""
    return indexed(one).join(indexed(other).select("key"), "key", "left_anti").select("key", "path")


def duplicate_groups(records: DataFrame, paths: int = 20) -> DataFrame:
    """hash, files, first_key, first_name, paths of contents under more than one key.

    A content may have any number of places: they are counted, and a number of the first
    is listed, from ranks within the group.
    """
    places = records.select(F.lower(F.trim("sha256")).alias("hash"), props.compare_key().alias("key"), "name", "path").where("hash <> ''").dropDuplicates(["hash", "key"])
    counted = places.groupBy("hash").agg(F.count(F.lit(1)).alias("files"), F.min(F.struct("key", "name")).alias("first")).where("files > 1")
    rank = F.row_number().over(Window.partitionBy("hash").orderBy("key"))
    listed = (
        places.join(counted.select("hash"), "hash", "left_semi")
        .withColumn("rank", rank)
        .where(F.col("rank") <= paths)
        .groupBy("hash")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "path"))), lambda x: x["path"]).alias("paths"))
    )
    return counted.join(listed, "hash").select("hash", "files", F.col("first.key").alias("first_key"), F.col("first.name").alias("first_name"), "paths")


def _recent(key: str = "tenant_id"):
    return Window.partitionBy(key).orderBy(F.col("created_at").desc(), F.col("scan_id").desc())


def latest(scans: DataFrame) -> DataFrame:
    """The newest scan of each tenant."""
    row = F.struct(*[c for c in scans.columns if c != "tenant_id"])
    return scans.groupBy("tenant_id").agg(F.max_by(row, F.struct("created_at", "scan_id")).alias("r")).select("tenant_id", "r.*")


def trend(scans: DataFrame, n: int = 14) -> DataFrame:
    """The last ``n`` scans of each tenant, numbered back from the newest."""
    return scans.withColumn("back", F.row_number().over(_recent())).where(F.col("back") <= n)


def deltas(scans: DataFrame) -> DataFrame:
    """tenant_id, metric, current, prior, delta between the two newest scans of each tenant that has two."""
    two = trend(scans, 2).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.max(F.when(F.col("back") == k, F.col(c))).alias(f"{c}_{k}") for c in COUNTERS for k in (1, 2)],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"{c}_1").alias("current"), F.col(f"{c}_2").alias("prior")) for c in COUNTERS])
    return two.where("n = 2").select("tenant_id", F.inline(rows)).withColumn("delta", F.col("current") - F.col("prior"))


def portfolio(tenants: DataFrame, scans: DataFrame, counted: dict[str, DataFrame]) -> DataFrame:
    """Tenants with the posture of their newest scan and their row counts in other tables."""
    out = tenants.join(latest(scans), "tenant_id", "left").withColumn("posture", F.when(F.col("scan_id").isNotNull(), posture_from_counts()))
    for name, rows in {"scans": scans, **counted}.items():
        out = out.join(rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias(f"n_{name}")), "tenant_id", "left").fillna(0, [f"n_{name}"])
    return out


def registry(tenants: DataFrame, *sources: DataFrame) -> DataFrame:
    """Tenant ids that any of ``sources`` names and ``tenants`` lacks."""
    seen = None
    for s in sources:
        ids = s.select(F.trim(F.col("tenant_id").cast("string")).alias("tenant_id")).where("tenant_id <> ''")
        seen = ids if seen is None else seen.unionByName(ids)
    return seen.distinct().join(tenants.select(F.col("tenant_id").cast("string").alias("tenant_id")), "tenant_id", "left_anti")


def tail(log: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The last ``n`` rows of a log, oldest first."""
    return log.orderBy(F.col(order).desc()).limit(n).orderBy(order)


def failures_in_window(failures: DataFrame, key: str, moment: str, seconds: int) -> DataFrame:
    """Each failure with the number of failures of its key in the ``seconds`` up to it.

    A key with very many failures is handled by time: counts per second first, so the
    window runs over seconds, not rows.
    """
    ticks = failures.select(key, F.unix_seconds(F.col(moment).cast("timestamp")).alias("second")).groupBy(key, "second").agg(F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy(key).orderBy("second").rangeBetween(-seconds, 0)
    return ticks.withColumn("failures", F.sum("n").over(window))


def alerts(scans: DataFrame) -> DataFrame:
    """An alert for every scan with critical files."""
    return scans.where("critical > 0").select("tenant_id", "scan_id", F.lit("CRITICAL").alias("severity"), "critical")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``incoming`` in place of those with the same keys."""
    return stored.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def level_policy(overrides: DataFrame) -> DataFrame:
    """name, severity, action, reason of (pattern, level, reason) rows, for a data-loss policy."""
    act: Column = F.when(F.col("level").isin("CRITICAL", "HIGH"), "block-and-alert").otherwise("monitor")
    return overrides.select(F.col("pattern").alias("name"), F.col("level").alias("severity"), act.alias("action"), "reason")
