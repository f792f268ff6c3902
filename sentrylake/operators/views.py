"""What lists, pages, exports and dashboards take from stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from . import history

MOST_STORED, PAGE = 500, (1, 1000)
RANKS = {"viewer": 1, "analyst": 2, "admin": 3}
# Groups of extensions.
EXTENSION_GROUPS = {
    "Secrets & config": (".env", ".pem", ".key", ".crt", ".cer", ".pfx", ".p12", ".kdbx", ".npmrc", ".pypirc", ".netrc", ".aws", ".ovpn", ".pcf", ".mobileconfig", ".rdp"),
    "Documents": (
        ".doc", ".docx", ".docm", ".dotx", ".dotm", ".rtf", ".odt", ".ott", ".pages", ".pdf", ".ppt", ".pptx", ".pptm", ".odp", ".otp", ".keynote", ".one", ".pub",
        ".vsd", ".vsdx", ".dwg", ".dxf",
    ),
    "Data & exports": (
        ".csv", ".tsv", ".json", ".xml", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".config", ".properties", ".sql", ".dump", ".backup", ".bak", ".db", ".sqlite",
        ".sqlite3", ".mdb", ".accdb", ".xls", ".xlsx", ".xlsm", ".xlsb", ".ods", ".ots", ".numbers", ".pst", ".ost", ".msg", ".eml", ".mbox", ".ics", ".dat",
    ),
    "Source code": (
        ".ps1", ".psm1", ".psd1", ".bat", ".cmd", ".sh", ".py", ".js", ".ts", ".tsx", ".jsx", ".html", ".htm", ".css", ".scss", ".java", ".cs", ".go", ".rb", ".php", ".c",
        ".cpp", ".h", ".hpp", ".md", ".adoc", ".rst", ".yara", ".reg", ".tf", ".tfvars", ".tfstate", ".hcl", ".dockerfile",
    ),
    "Archives": (".zip", ".7z", ".rar", ".tar", ".gz", ".tgz", ".bz2", ".xz", ".cab", ".jar", ".iso", ".vhd", ".vhdx"),
    "System & binaries": (".sys", ".dll", ".exe", ".msi", ".lnk", ".tmp", ".temp", ".old", ".swp", ".bin", ".gpg", ".pgp"),
    "Media": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".heic", ".svg", ".mp3", ".wav", ".mp4", ".mov", ".avi", ".mkv"),
}


def extension_group(extension: Column | str, custom: tuple[str, ...] = ()) -> Column:
    e = F.col(extension) if isinstance(extension, str) else extension
    out = F.when(e.isin(*custom), "Custom") if custom else F.when(F.lit(False), "")
    return reduce(lambda c, kv: c.when(e.isin(*kv[1]), kv[0]), EXTENSION_GROUPS.items(), out).otherwise("Other")


def posture_label(score: Column | str, short: bool = False) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    good, fair, bad = ("Healthy", "Watch", "At risk") if short else ("healthy exposure", "watch risk concentration", "remediate at once")
    return F.when(s >= 80, good).when(s >= 55, fair).otherwise(bad)


def of_tenant(rows: DataFrame, tenant: str, role: str = "viewer", least: str = "viewer") -> DataFrame:
    """The rows of one tenant, for a role that may see them; a folder per tenant makes it a partition filter."""
    if RANKS.get(role, 0) < RANKS[least]:
        raise PermissionError(f"{role} may not read what needs {least}")
    return rows.where(F.col("tenant_id") == tenant)


def page(rows: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """One page of ``rows`` in an order that must be total."""
    size = min(max(size, PAGE[0]), PAGE[1])
    return rows.orderBy(*order).offset(size * max(number - 1, 0)).limit(size)


def history_page(scans: DataFrame, limit: int = 200) -> DataFrame:
    """The newest scans, oldest first, 1 to 1000 of them."""
    limit = min(max(limit, PAGE[0]), PAGE[1])
    newest = [F.col("created_at").desc(), F.col("scan_id").desc()]
    return scans.orderBy(*newest).limit(limit).orderBy("created_at", "scan_id")


def truncated(assessed: DataFrame, most: int = MOST_STORED) -> DataFrame:
    """The first ``most`` records by doc_id with total_files and whether some are left out."""
    total = assessed.agg(F.count(F.lit(1)).alias("total_files"))
    return assessed.orderBy("doc_id").limit(most).crossJoin(F.broadcast(total)).withColumn("result_truncated", F.col("total_files") > most)


def report_order(assessed: DataFrame) -> DataFrame:
    """All records, worst first: a range-partitioned sort."""
    return assessed.orderBy(F.col("score").desc(), "doc_id")


def executive(assessed: DataFrame, k: int = 6) -> DataFrame:
    return report_order(assessed).limit(k)


def listing(users: DataFrame) -> DataFrame:
    """Users or tenants as they are shown: without secrets, by name."""
    hidden = [c for c in users.columns if any(x in c.lower() for x in ("password", "hash", "secret", "token"))]
    shown = users.drop(*hidden)
    return shown.orderBy(*[c for c in ("username", "name", "tenant_id") if c in shown.columns])


def allowed(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose key is on a list."""
    return rows.join(known.select(key).distinct(), key, "left_semi")


def integrity_flags(records: DataFrame, earlier: DataFrame) -> DataFrame:
    """doc_id, hash_changed, hash_duplicate of records with a hash, against an earlier scan."""
    now = history.indexed(records)
    moved = history.changed(records, earlier).select("key", F.lit(True).alias("hash_changed"))
    twice = now.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", F.lit(True).alias("hash_duplicate"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("hash_changed", "hash_duplicate")]
    return now.join(moved, "key", "left").join(twice, "hash", "left").select("doc_id", *flags)


def hash_changes(latest: DataFrame, earlier: DataFrame, k: int = 100) -> DataFrame:
    """The first changed files by key, and how many there are in all."""
    rows = history.changed(latest, earlier)
    return rows.orderBy("key").limit(k).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("changed_files"))))


def hash_duplicates(records: DataFrame, k: int = 100) -> DataFrame:
    """The largest groups of equal contents."""
    return history.duplicate_groups(records).orderBy(F.col("files").desc(), "first_name", "hash").limit(k)


def wrong_profile(files: DataFrame, profile: str) -> DataFrame:
    """One row: files of the profile, and how many lie in others'."""
    from .report import of_profile

    mine = of_profile("path", profile)
    return files.agg(F.coalesce(F.sum(mine.cast("long")), F.lit(0)).alias("kept"), F.coalesce(F.sum((~mine).cast("long")), F.lit(0)).alias("excluded"))


def owners(records: DataFrame) -> DataFrame:
    """One row: files with and without a known owner."""
    known = F.coalesce(F.trim("owner"), F.lit("")) != ""
    return records.agg(F.coalesce(F.sum(known.cast("long")), F.lit(0)).alias("owner_resolved"), F.coalesce(F.sum((~known).cast("long")), F.lit(0)).alias("owner_missing"))


def demo_path(path: Column | str) -> Column:
    """Whether a path lies among sample data."""
    p = F.lower(F.translate(F.col(path) if isinstance(path, str) else path, "\\", "/"))
    return p.rlike(r"(?:^|/)(?:test_data|demo|sample[_ -]?data|samples?)(?:/|$)")


def archive_protection(extension: Column | str, status: Column | str) -> Column:
    """kind, inspected of an archive; null for other files."""
    e, s = (F.col(c) if isinstance(c, str) else c for c in (extension, status))
    zipped = e == ".zip"
    return F.when(
        e.isin(*fixed.ARCHIVE_EXTENSIONS),
        F.struct(F.when(zipped, F.coalesce(F.nullif(s, F.lit("")), F.lit("open"))).otherwise("unsupported_archive").alias("kind"), (zipped & ~F.coalesce(s, F.lit("")).rlike("protected|bad")).alias("inspected")),
    )


def comparison(scans: DataFrame) -> DataFrame:
    """tenant_id, label, current, prior, delta as reports show them."""
    labels = F.create_map(*[F.lit(x) for kv in (("critical", "Critical"), ("high", "High"), ("medium", "Medium"), ("low", "Low"), ("total_files", "Total files")) for x in kv])
    return history.deltas(scans).select("tenant_id", labels[F.col("metric")].alias("label"), "current", "prior", "delta")


def sheets(assessed: DataFrame, scans: DataFrame) -> dict[str, DataFrame]:
    """The sheets of a workbook, a table each, from the same assessed records."""
    from . import rollups
    from .risk import remediation

    total = F.broadcast(assessed.agg(F.count(F.lit(1)).alias("all_files")))
    signals = assessed.select("doc_id", F.explode("findings").alias("f")).groupBy(F.col("f.type").alias("signal")).agg(F.count_distinct("doc_id").alias("files"), F.sum("f.count").alias("hits"))
    plan = F.struct(*[remediation()[c].alias(c) for c in ("status", "owner", "sla", "ticket")])
    return {
        "departments": rollups.by_department(assessed),
        "folders": rollups.by_folder(assessed),
        "signals": signals.crossJoin(total).select("signal", "files", "hits", F.round(F.col("files") * 100 / F.greatest("all_files", F.lit(1)), 1).alias("percent_of_files")),
        "comparison": comparison(scans),
        "remediation": report_order(rollups.remediation_queue(assessed, 50)).select("doc_id", "name", "level", "score", plan.alias("plan")).select("doc_id", "name", "level", "score", "plan.*"),
    }


def rescan(earlier: DataFrame, now: DataFrame) -> DataFrame:
    """key, state (added, removed, changed) of the files that differ between two scans; the rest need no new assessment."""
    gone, came = history.only_in(earlier, now), history.only_in(now, earlier)
    rows = [came.select("key", F.lit("added").alias("state")), gone.select("key", F.lit("removed").alias("state")), history.changed(now, earlier).select("key", F.lit("changed").alias("state"))]
    return reduce(DataFrame.unionByName, rows)


def live_tokens(tokens: DataFrame, revoked: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Tokens (token_id, issued_at) that are neither older than ``days`` nor revoked; revocations as old need no look."""
    since = now - F.make_interval(days=F.lit(days))
    return tokens.where(F.col("issued_at") > since).join(revoked.where(F.col("revoked_at") > since).select("token_id").distinct(), "token_id", "left_anti")


def portfolio_totals(tenants: DataFrame, scans: DataFrame, first: int = 4) -> DataFrame:
    """One row: tenants, critical files of their newest scans, and the first tenants by name with their posture."""
    from .rollups import posture_from_counts

    rows = tenants.join(history.latest(scans).withColumn("posture", posture_from_counts()).select("tenant_id", "critical", "posture"), "tenant_id", "left")
    shown = F.broadcast(rows.orderBy("name").limit(first).agg(F.array_sort(F.collect_list(F.struct("name", "posture"))).alias("shown")))
    return rows.agg(F.count(F.lit(1)).alias("tenants"), F.coalesce(F.sum("critical"), F.lit(0)).alias("critical")).crossJoin(shown)


def pick_lists(assessed: DataFrame) -> DataFrame:
    """list, value: the sorted distinct sources and finding types that filters offer."""
    from . import rollups

    both = rollups.source_facet(assessed).select(F.lit("source").alias("list"), F.col("source").alias("value"))
    return both.unionByName(rollups.finding_facet(assessed).select(F.lit("finding").alias("list"), F.col("finding").alias("value"))).where("value <> ''").orderBy("list", "value")


def diagnostics(files: DataFrame, depth: int, first: int = 5) -> DataFrame:
    """One row: what a scan found and left out (by reason), its first extensions, and a line that says so."""
    from ..functions import props
    from .filters import depth_at_most

    marks = {"hidden": props.hidden_path("path"), "system": props.system_path("path"), "skipped": props.skipped_path("path"), "too_deep": ~depth_at_most(depth)}
    counts = [F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in marks.items()]
    row = files.agg(F.count(F.lit(1)).alias("seen"), *counts, F.slice(F.array_sort(F.collect_set(props.extension("path"))), 1, first).alias("extensions"))
    told = F.concat_ws("; ", *[F.concat(F.lit(f"{n.replace('_', ' ')} "), F.col(n).cast("string")) for n in ("seen", *marks)], F.concat(F.lit("extensions "), F.array_join("extensions", ", ")))
    return row.withColumn("text", told)
