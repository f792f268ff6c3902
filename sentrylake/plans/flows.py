"""Queries that write on their way: listings, folders, stores, streams, sinks. Each derives what it reads from the given tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import props
from ..operators import history, observed, report_store, rescan, rollups
from ..operators.filters import depth_at_most
from ..sources import inflate, inventory, listings, walk
from ..sources.stored import kept, new_folder
from ..streaming import sinks, tokens
from ..streaming.watch import watch_scans
from . import oracle as o
from .catalogue import _EARLIER, _SCANS, assessed, query, scans


@contextmanager
def set_conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for as long as the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _documents(sf_dir: str) -> str:
    return f"{sf_dir}/documents.parquet"


# -- listings of shares and machines -------------------------------------------------------


_LISTED = {
    "listed": "SELECT *, CASE WHEN source = 'smb' THEN 'share' ELSE 'host' END AS kind, CASE WHEN source = 'smb' THEN CASE WHEN doc_id % 10 = 0 THEN 'ADMIN$' WHEN share = '' THEN 'C$' ELSE share END ELSE 'host' || doc_id % 7 END AS target FROM files WHERE source <> 'local'"
}


def exported(spark, sf_dir) -> DataFrame:
    """Answers of shares and machines that list the stand-in's files."""

    def write(path: str) -> None:
        files = inventory.stand_in(spark, sf_dir).drop("content").where("source <> 'local'")
        shares = F.when(F.col("doc_id") % 10 == 0, "ADMIN$").when(F.col("share") == "", "C$").otherwise(F.col("share"))
        target = F.when(F.col("source") == "smb", shares).otherwise(F.concat(F.lit("host"), F.col("doc_id") % 7))
        kind = F.when(F.col("source") == "smb", "share").otherwise("host")
        listings.export(files.select(kind.alias("kind"), target.alias("target"), F.expr(f"doc_id div {listings.PAGE}").alias("page"), "*"), path)

    return listings.answers(spark, kept("listings", _documents(sf_dir), write, spark))


@query(o.sql("SELECT doc_id, kind, target, path, size, owner, len(principals) AS n_principals FROM listed WHERE kind = 'host' AND target IN ('host1', 'host4')", "files", more=_LISTED))
def remote_hosts(spark, sf_dir):
    """Two machines of all: the other machines' and all shares' partitions are not made."""
    pages = exported(spark, sf_dir).where("kind = 'host' AND target IN ('host1', 'host4')")
    return listings.records(pages).select("doc_id", "kind", "target", "path", "size", "owner", F.size("principals").cast("long").alias("n_principals"))


@query(o.sql("SELECT doc_id, target, path, sha256 FROM listed WHERE kind = 'share' AND target <> 'ADMIN$'", "files", more=_LISTED))
def remote_shares(spark, sf_dir):
    """Files of the shares that scans open, and of the one administrative drive asked for."""
    pages = exported(spark, sf_dir).where(F.col("kind") == "share").where(listings.ordinary_shares(admin_drive="c"))
    return listings.records(pages).select("doc_id", "target", "path", "sha256")


@query(o.sql(f"SELECT kind, target, count(DISTINCT doc_id // {listings.PAGE}) AS pages, count(*) AS records, count(*) FILTER (len(principals) = 0) AS denied, 0 AS errors, 0 AS bad_pages FROM listed GROUP BY kind, target", "files", more=_LISTED))
def remote_diagnostics(spark, sf_dir):
    return listings.diagnostics(exported(spark, sf_dir))


# -- folders ---------------------------------------------------------------------------------


def tree(spark, sf_dir) -> str:
    """A folder that holds the stand-in's files."""
    return kept("tree", _documents(sf_dir), lambda path: walk.put(inventory.stand_in(spark, sf_dir).select("path", "content"), path), spark)


@query(o.sql("SELECT path, CAST(strlen(content) AS BIGINT) AS size, sha256, substr(content, 1, 60) AS head FROM files WHERE NOT contains(path, '/.') AND NOT contains(path, '/node_modules/') AND NOT contains(path, '/Windows/') AND regexp_matches(name, '\\.(csv|txt|json|env)$')", "files"))
def folder_scan(spark, sf_dir):
    """Checksums and first words of the files of four extensions outside hidden, system and skipped folders."""
    folder = tree(spark, sf_dir)
    found = walk.walk(spark, folder, extensions=["csv", ".TXT", "json", "env"], include_hidden=False)
    return walk.contents(found, folder).select("path", "size", "sha256", F.substring("preview", 1, 60).alias("head"))


@query(
    o.sql(
        "SELECT 'skipped' AS reason, count(DISTINCT split_part(path, '/node_modules/', 1)) AS folders, 0 AS files FROM files WHERE contains(path, '/node_modules/') UNION ALL "
        "SELECT 'system', count(DISTINCT split_part(path, '/Windows/', 1)), 0 FROM files WHERE contains(path, '/Windows/') UNION ALL "
        "SELECT 'too deep', count(DISTINCT regexp_replace(path, '/[^/]*$', '')), 0 FROM files WHERE contains(path, '/.') UNION ALL "
        "SELECT 'extension', 0, count(*) FROM files WHERE len(string_split(path, '/')) = 5 AND NOT regexp_matches(name, '\\.(csv|txt)$')",
        "files",
    )
)
def folder_left_out(spark, sf_dir):
    """What a walk of three levels left out, by reason; hidden folders are taken but lie too deep."""
    return walk.left_out(walk.walk(spark, tree(spark, sf_dir), depth=3, extensions=["csv", "txt"]))


# -- counts beside rows ------------------------------------------------------------------------


_PLACES = "CASE WHEN is_system THEN 'system' WHEN is_hidden THEN 'hidden' WHEN contains(path, '/node_modules/') OR contains(lower(path), '/windows/') THEN 'skipped' WHEN len(list_filter(string_split(path, '/'), lambda p: p <> '')) - 1 > 3 THEN 'deep' WHEN NOT regexp_matches(path, '^/src1') THEN 'other profile' END"


@query(o.sql(f"SELECT name, count(r.doc_id) AS files FROM (VALUES ('system'), ('hidden'), ('skipped'), ('deep'), ('other profile'), ('kept'), ('seen')) n(name) LEFT JOIN (SELECT doc_id, unnest([coalesce({_PLACES}, 'kept'), 'seen']) AS why FROM files) r ON why = name GROUP BY name", "files"))
def filtered_scan_counts(spark, sf_dir):
    """Records of one profile written out, and how many each rule left out, from one pass over the records."""
    rows = inventory.stand_in(spark, sf_dir).drop("content", "sha256")
    reasons = {
        "system": F.col("is_system"), "hidden": F.col("is_hidden"), "skipped": props.skipped_path("path"), "deep": ~depth_at_most(3), "other profile": ~F.col("path").startswith("/src1"),
    }
    left, seen = observed.filtered(rows, reasons)
    left.write.parquet(new_folder(spark, "filtered"))
    return observed.as_rows(spark, seen)


# -- a scan after a scan -------------------------------------------------------------------------


_SAME = "EXISTS (SELECT 1 FROM earlier e WHERE e.path = r.path AND e.source = r.source AND e.share = r.share AND e.sha256 = r.sha256)"


@query(o.sql(f"SELECT doc_id, score, level, NOT {_SAME} AS fresh FROM risk r", "risk", more=_EARLIER))
def incremental_assessment(spark, sf_dir):
    """The earlier scan's store brought up to date: equal to a full run, with detection on what differs."""
    store, now = new_folder(spark, "store"), inventory.stand_in(spark, sf_dir)
    rescan.refresh(spark, store, inventory.normalise(inventory.previous(now)))
    table, _ = rescan.refresh(spark, store, inventory.normalise(now))
    rescan.tidy(spark, store)
    return table.select("doc_id", "score", "level", "fresh")


@query(o.sql(f"SELECT count(*) AS files, count(*) FILTER (NOT {_SAME}) AS detected FROM files r", "files", more=_EARLIER))
def incremental_texts_read(spark, sf_dir):
    """How many of the texts the second scan of :func:`incremental_assessment` sends through detection."""
    store, now = new_folder(spark, "store"), inventory.stand_in(spark, sf_dir)
    rescan.refresh(spark, store, inventory.normalise(inventory.previous(now)))
    table, seen = rescan.refresh(spark, store, inventory.normalise(now))
    return table.agg(F.count(F.lit(1)).alias("files")).withColumn("detected", F.lit(int(seen.get["detected"])).cast("long"))


# -- streams and sinks -----------------------------------------------------------------------------


def _in_files(rows: DataFrame, order: str, name: str, files: int = 4) -> tuple[str, str]:
    """The rows as a folder of files by ``order``, for a stream to read; its path and schema."""
    path = new_folder(rows.sparkSession, name)
    rows.repartitionByRange(files, order).write.parquet(path)
    return path, rows.schema


_LAST = "(SELECT max(ts) FROM events)"


@query(
    f"SELECT event_id FROM events WHERE event_type <> 'error' AND ts > {_LAST} - INTERVAL 7 DAYS AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND ts > {_LAST} - INTERVAL 7 DAYS)"
)
def live_tokens_streamed(spark, sf_dir):
    """Tokens alive at the last event's moment; the list of revocations comes from a stream with state and timers."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    revoked = events.where("event_type = 'error'").select(F.col("user_id").cast("string").alias("token_id"), F.col("ts").alias("revoked_at"))
    path, schema = _in_files(revoked, "revoked_at", "revocations")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)
    changes = new_folder(spark, "changes")
    with set_conf(spark, *tokens.STORE):
        run = tokens.revocation_changes(stream, 7, "7 days").writeStream.foreachBatch(sinks.append_once(changes)).option("checkpointLocation", new_folder(spark, "checkpoint"))
        run.trigger(availableNow=True).start().awaitTermination()
    last = events.agg(F.max("ts").alias("last"))
    moment = F.lit(last.first()["last"])
    gone = tokens.revoked_at_moment(sinks.appended(spark, changes, tokens.CHANGE), moment)
    alive = events.where(F.col("event_type") != "error").where(F.col("ts") > moment - F.expr("INTERVAL 7 DAYS"))
    return alive.withColumn("token_id", F.col("user_id").cast("string")).join(gone, "token_id", "left_anti").select("event_id")


ALERT = "tenant_id long, scan_id long, severity string, critical long"


@query(o.sql("SELECT CAST(tenant_id AS BIGINT) AS tenant_id, scan_id, 'CRITICAL' AS severity, critical FROM scans WHERE critical > 0", more=_SCANS))
def alert_log(spark, sf_dir):
    """Scans arrive in files; each alerting one is logged once, though the first batch is handed on twice."""
    path, schema = _in_files(scans(spark, sf_dir), "scan_id", "scans")
    table = new_folder(spark, "alerts")
    put = sinks.append_once(table)

    def tell(found: DataFrame, number: int) -> None:
        rows = found.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in ALERT.split(", ")])
        put(rows, number)
        if number == 0:
            put(rows, number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    watch_scans(stream, tell, new_folder(spark, "checkpoint")).awaitTermination()
    return sinks.appended(spark, table, ALERT)


# -- reports as documents ----------------------------------------------------------------------------


def reports(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Stored reports of three generations, and later ones that replace every fifth; as (JSON) text, the way they arrive."""
    every = scans(spark, sf_dir)
    shapes = {
        0: F.struct(F.struct(*history.COUNTERS).alias("summary"), F.lit("first").alias("format")),
        1: F.struct(F.lit(2).alias("version"), F.struct(F.struct(*history.COUNTERS).alias("counts"), F.array("tenant_id").alias("tenants")).alias("scan")),
        2: F.struct(F.lit(3).alias("version"), F.col("total_files").alias("total"), *[F.col(c).cast("string").alias(f"{c}_files") for c in history.COUNTERS[:-1]]),
    }
    text = F.coalesce(*[F.when(F.col("scan_id") % 3 == k, F.to_json(s)) for k, s in shapes.items()])
    later = every.where("scan_id % 5 = 0").withColumns({"critical": F.col("critical") + 1, "created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY")})
    again = every.where("scan_id % 10 = 0").withColumn("critical", F.lit(99).cast("long"))
    named = lambda rows: report_store.parsed(rows.select("tenant_id", "scan_id", F.col("created_at").cast("timestamp").alias("created_at"), text.alias("report"))).drop("broken")
    return named(every), named(later).unionByName(named(again))


def upserted(spark, sf_dir) -> DataFrame:
    path = new_folder(spark, "reports")
    report_store.keep_last(*reports(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


@query(o.sql("SELECT tenant_id, scan_id, CAST(scan_id % 3 + 1 AS INTEGER) AS generation, critical + CASE WHEN scan_id % 5 = 0 THEN 1 ELSE 0 END AS critical, high, medium, low, total_files FROM scans", more=_SCANS))
def report_counters(spark, sf_dir):
    """Counters read out of stored reports of three shapes, after later reports have replaced some."""
    return report_store.counters(upserted(spark, sf_dir)).drop("created_at")


@query(o.sql("SELECT CAST(scan_id % 3 AS BIGINT) AS shape, count(*) AS reports FROM scans GROUP BY 1", more=_SCANS))
def report_shapes(spark, sf_dir):
    """How many stored reports there are of each shape; shapes are told by their own schemas."""
    found = report_store.shapes(upserted(spark, sf_dir))
    number = F.when(F.col("shape").contains("summary"), 0).when(F.col("shape").contains("counts"), 1).otherwise(2).cast("long")
    return found.groupBy(number.alias("shape")).agg(F.sum("reports").alias("reports"))


# -- archives ------------------------------------------------------------------------------------------


def archive_folder(spark, sf_dir) -> str:
    """A folder of ZIP archives of twenty files each; every third archive holds another with the first of them.

    Contents that would shrink beyond the cap on ratios, inner archives too, are stored as they are.
    """
    import io
    import zipfile
    import zlib

    import pandas as pd

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        group, out, inner = int(rows["part"].iloc[0]), io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            files = [(name, content.encode()) for name, content in zip(rows["name"], rows["content"], strict=True)]
            if group % 3 == 0:
                with zipfile.ZipFile(inner, "w") as second:
                    second.writestr(*files[0])
                files.append(("inner.zip", inner.getvalue()))
            for name, raw in files:
                dense = len(raw) < 50 * len(zlib.compress(raw))
                archive.writestr(name, raw, zipfile.ZIP_DEFLATED if dense else zipfile.ZIP_STORED)
        return pd.DataFrame({"path": [f"/part_{group}.zip"], "content": [out.getvalue()]})

    def write(path: str) -> None:
        files = inventory.stand_in(spark, sf_dir).select("doc_id", "name", "content", F.expr("doc_id div 20").alias("part"))
        walk.put(files.groupBy("part").applyInPandas(pack, "path string, content binary"), path)

    return kept("archives", _documents(sf_dir), write, spark)


@query(
    o.sql(
        "SELECT '/part_' || doc_id // 20 || '.zip::' || name AS entry, CAST(strlen(content) AS BIGINT) AS size, sha256, substr(content, 1, 40) AS head FROM files UNION ALL "
        "SELECT '/part_' || doc_id // 20 || '.zip::inner.zip::' || name, strlen(content), sha256, substr(content, 1, 40) FROM files WHERE (doc_id // 20) % 3 = 0 QUALIFY row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) = 1",
        "files",
    )
)
def archive_entries(spark, sf_dir):
    """Entries of the archives that a walk finds, inflated and hashed in pieces; archives themselves are left out of the list."""
    folder = archive_folder(spark, sf_dir)
    found = inflate.contents(walk.walk(spark, folder).select("path"), folder)
    return found.where("entry LIKE '%::%' AND entry NOT LIKE '%::inner.zip' AND protection IS NULL").select("entry", F.col("entry_size").alias("size"), "sha256", F.substring("preview", 1, 40).alias("head"))


# -- one pass ------------------------------------------------------------------------------------------


def _rollup(name: str, value: str) -> str:
    return f"SELECT '{name}' AS rollup, {value} AS value, count(*) AS files, count(*) FILTER (level = 'CRITICAL') AS critical, count(*) FILTER (level = 'HIGH') AS high, CAST(sum(score) AS BIGINT) AS score, NULL::BIGINT AS matches FROM risk GROUP BY 2"


@query(
    o.sql(
        " UNION ALL ".join(_rollup(*x) for x in (("department", o.DEPARTMENT), ("folder", o.FOLDER), ("label", o.HEAT), ("level", "level")))
        + " UNION ALL SELECT 'bucket', bucket, count(*), NULL, NULL, NULL, NULL FROM (SELECT 'ALL' AS bucket FROM risk UNION ALL SELECT level FROM risk UNION ALL SELECT 'PROTECTED' FROM risk WHERE locked) GROUP BY bucket "
        "UNION ALL SELECT 'finding', type, count(*), NULL, NULL, NULL, CAST(sum(count) AS BIGINT) FROM findings GROUP BY type UNION ALL SELECT 'category', category, count(*), NULL, NULL, NULL, NULL FROM categories GROUP BY category",
        "risk", "categories",
    )
)
def dashboard_one_pass(spark, sf_dir):
    return rollups.dashboard(assessed(spark, sf_dir))
