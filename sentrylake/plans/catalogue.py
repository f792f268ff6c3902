"""Registered queries of the posture engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, props
from ..functions import personal_rules
from ..operators import compliance, filters, findings, history, keywords, personal, report, risk, rollups, validated, views
from ..sources import endpoints, inventory
from ..sources.stored import stored
from . import oracle as o

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.normalise(inventory.stand_in(spark, sf_dir))


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings, access and scores of all records: worked out once a scan, then read by every view."""
    source = f"{sf_dir}/documents.parquet"
    rules = (fixed.DETECTORS, fixed.CONTEXTS, fixed.FINDING_WEIGHTS, fixed.EXTENSION_RISK)
    return stored("assessed", source, lambda: risk.assess(findings.classify(records(spark, sf_dir))), spark, rules)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).drop("access", "score", "level")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- filters and properties ------------------------------------------------------------


@query(o.sql("SELECT doc_id, extension FROM normal WHERE extension IN ('.csv', '.env', '.sql')", "normal"))
def scan_filter_extension(spark, sf_dir):
    return records(spark, sf_dir).where(filters.scan_filter(["CSV", ".env", " sql "], include_system=True)).select("doc_id", "extension")


@query(o.sql("SELECT doc_id FROM normal WHERE NOT is_hidden AND NOT is_system", "normal"))
def scan_filter_hidden(spark, sf_dir):
    return records(spark, sf_dir).where(filters.scan_filter(include_hidden=False)).select("doc_id")


@query(o.sql("SELECT doc_id FROM normal WHERE is_system", "normal"))
def scan_filter_system(spark, sf_dir):
    return records(spark, sf_dir).where(filters.scan_filter(only_system=True)).select("doc_id")


@query(o.sql("SELECT doc_id, contains(path, '/node_modules/') OR contains(lower(path), '/windows/') AS skipped, contains(path, '/.') AS hidden, contains(lower(path), '/windows/') AS system, len(list_filter(string_split(path, '/'), lambda p: p <> '')) - 1 <= 3 AS shallow FROM files", "files"))
def path_filters(spark, sf_dir):
    return inventory.stand_in(spark, sf_dir).select(
        "doc_id", props.skipped_path("path").alias("skipped"), props.hidden_path("path").alias("hidden"), props.system_path("path").alias("system"), filters.depth_at_most(3).alias("shallow")
    )


@query(o.sql("SELECT doc_id, extension, scan_mode, content_status, protected FROM normal", "normal"))
def record_states(spark, sf_dir):
    return records(spark, sf_dir).select("doc_id", "extension", "scan_mode", "content_status", "protected")


@query(o.sql(f"SELECT doc_id, protected OR {o.marked(chr(39) + chr(39) + ' || content_status || ' + chr(39) + ' ' + chr(39) + ' || scan_error || ' + chr(39) + ' ' + chr(39) + ' || protection_type')} AS in_summary, protected OR {o.marked(o.FIRST_OF_THREE)} AS in_risk, protected OR {o.marked('coalesce(nullif(content_status, ' + chr(39) * 2 + '), nullif(scan_error, ' + chr(39) * 2 + '), ' + chr(39) * 2 + ')')} AS in_remediation, {o.VIEW} AS in_views FROM normal", "normal"))
def protected_variants(spark, sf_dir):
    return records(spark, sf_dir).select(
        "doc_id", props.protected_for_summary().alias("in_summary"), props.protected_for_risk().alias("in_risk"), props.protected_for_remediation().alias("in_remediation"), props.protected_in_views().alias("in_views")
    )


@query(o.sql("SELECT coalesce(nullif(extension, ''), 'no extension') AS extension, count(*) AS files FROM normal GROUP BY 1", "normal"))
def extension_histogram(spark, sf_dir):
    return rollups.extension_histogram(records(spark, sf_dir))


@query(
    o.sql(
        "SELECT doc_id, coalesce(nullif(concat_ws(', ', CASE WHEN bits & 32 <> 0 THEN 'A' END, CASE WHEN bits & 1 <> 0 THEN 'R' END, CASE WHEN is_hidden OR bits & 2 <> 0 THEN 'H' END, CASE WHEN is_system OR bits & 4 <> 0 THEN 'S' END), ''), 'Normal') AS attributes "
        "FROM (SELECT *, CASE WHEN doc_id % 6 <> 5 THEN doc_id % 64 ELSE 0 END AS bits FROM files)",
        "files",
    )
)
def attribute_labels(spark, sf_dir):
    """Labels from flags and from attribute bits, of which every sixth file has none."""
    files = inventory.stand_in(spark, sf_dir).withColumn("bits", F.when(F.col("doc_id") % 6 != 5, F.col("doc_id") % 64))
    return files.select("doc_id", props.attribute_label("is_hidden", "is_system", "bits").alias("attributes"))


@query(
    o.sql(
        "SELECT doc_id, content <> '' AS available, substr(text, 1, 1800) AS lines, len(every) > 8 AND content <> '' OR length(text) > 1800 AS truncated FROM "
        "(SELECT doc_id, content, every, array_to_string(every[1:8], chr(10)) AS text FROM (SELECT doc_id, content, string_split(regexp_replace(content, chr(13) || chr(10) || '?', chr(10), 'g'), chr(10)) AS every FROM files))",
        "files",
    )
)
def preview_lines(spark, sf_dir):
    rows = inventory.stand_in(spark, sf_dir).select("doc_id", props.preview("content").alias("p"))
    return rows.select("doc_id", "p.available", F.array_join("p.lines", "\n").alias("lines"), "p.truncated")


# -- detection and risk ----------------------------------------------------------------


@query(o.sql("SELECT doc_id, pos, type, risk, count FROM findings", "findings"))
def regex_findings(spark, sf_dir):
    return findings.long_form(findings.classify(records(spark, sf_dir))).drop("samples")


@query(
    o.sql(
        "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(content, '(?i)\\b(?:password|passwd|pwd)\\s*[:=]\\s*[^\\s''\"]+', 0)[1:10], lambda v: CASE WHEN length(v) <= 6 THEN '***' ELSE substr(v, 1, 3) || '***' || right(v, 2) END), ';') AS samples "
        "FROM files WHERE regexp_matches(content, '(?i)\\b(?:password|passwd|pwd)\\s*[:=]\\s*[^\\s''\"]+')",
        "files",
    )
)
def redacted_samples(spark, sf_dir):
    rows = findings.long_form(classified(spark, sf_dir))
    return rows.where("type = 'password'").select("doc_id", F.array_join("samples", ";").alias("samples"))


@query(o.sql("SELECT type, CAST(sum(count) AS BIGINT) AS matches FROM findings GROUP BY type ORDER BY matches DESC, type LIMIT 6", "findings"))
def finding_stats_top(spark, sf_dir):
    return rollups.top_findings(classified(spark, sf_dir))


@query(
    o.sql(
        "SELECT type, matches, CAST(96 + floor(matches / max(matches) OVER () * 70 + 0.5) AS BIGINT) AS size FROM (SELECT type, CAST(sum(count) AS BIGINT) AS matches FROM findings GROUP BY type ORDER BY matches DESC, type LIMIT 6)",
        "findings",
    )
)
def signal_sizes(spark, sf_dir):
    return rollups.signal_sizes(classified(spark, sf_dir))


@query(
    o.sql(
        "SELECT count(DISTINCT doc_id) AS sensitive, count(DISTINCT doc_id) FILTER (regexp_matches(type, 'secret|password|token|key|credential|private')) AS secrets, count(DISTINCT doc_id) FILTER (regexp_matches(type, 'pii|personal|gdpr|hipaa|pci|card|passport|ssn|iban')) AS regulated FROM findings",
        "findings",
    )
)
def finding_kpis(spark, sf_dir):
    return rollups.finding_kpis(classified(spark, sf_dir))


@query(o.sql("SELECT doc_id, CAST(acl AS INTEGER) AS score, wide, writable, privileged, CAST(n_issues AS INTEGER) AS n_issues FROM access", "access"))
def acl_assessment(spark, sf_dir):
    return records(spark, sf_dir).select("doc_id", risk.access().alias("a")).select("doc_id", "a.score", "a.wide", "a.writable", "a.privileged", F.size("a.issues").alias("n_issues"))


@query(o.sql("SELECT doc_id, CAST(fold AS INTEGER) AS fold FROM scored", "scored"))
def risk_score_fold(spark, sf_dir):
    return classified(spark, sf_dir).select("doc_id", risk.folded("findings").alias("fold"))


@query(o.sql("SELECT doc_id, score, level FROM risk", "risk"))
def risk_score_full(spark, sf_dir):
    return assessed(spark, sf_dir).select("doc_id", "score", "level")


@query(
    o.sql(
        "SELECT level, count(doc_id) AS files FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) l(level) LEFT JOIN risk USING (level) GROUP BY level", "risk"
    )
)
def risk_level_distribution(spark, sf_dir):
    return rollups.level_distribution(assessed(spark, sf_dir))


SUMMARY_SQL = (
    "SELECT count(*) AS total_files, count(*) FILTER (level = 'CRITICAL') AS critical, count(*) FILTER (level = 'HIGH') AS high, count(*) FILTER (level = 'MEDIUM') AS medium, count(*) FILTER (level = 'LOW') AS low, "
    "count(*) FILTER (n_findings > 0) AS sensitive_files, count(*) FILTER (is_hidden) AS hidden_files, "
    f"count(*) FILTER (protected OR {o.marked('content_status || chr(32) || scan_error || chr(32) || protection_type')}) AS protected_files FROM risk"
)


@query(o.sql(SUMMARY_SQL, "risk"))
def scan_summary(spark, sf_dir):
    return rollups.summary(assessed(spark, sf_dir))


@query(
    o.sql(
        f"SELECT CAST(greatest(0, least(100, round_even(100 - (critical * 95 + high * 80 + medium * 55 + low * 20) / total_files, 0))) AS BIGINT) AS posture FROM ({SUMMARY_SQL})", "risk"
    )
)
def posture_score_summary(spark, sf_dir):
    return rollups.summary(assessed(spark, sf_dir)).select(rollups.posture_from_counts().alias("posture"))


@query(o.sql("SELECT CAST(greatest(0, least(100, 100 - floor(avg(score) + 0.5))) AS BIGINT) AS posture FROM risk", "risk"))
def posture_score_files(spark, sf_dir):
    return rollups.posture_from_files(assessed(spark, sf_dir))


OVERRIDES = [("finance", "HIGH", "ledgers"), ("credit_card", "critical", ""), ("/src1/", "LOW", "test share"), ("", "HIGH", "no pattern"), ("fr/", "MEDIUM", "")]


@query(
    o.sql(
        "SELECT doc_id, level, score FROM (SELECT r.doc_id, coalesce(v.level, r.level) AS level, CAST(coalesce(v.score, r.score) AS INTEGER) AS score, row_number() OVER (PARTITION BY r.doc_id ORDER BY v.ord) AS k "
        "FROM risk r LEFT JOIN (SELECT doc_id, string_agg(type, ' ') AS types FROM findings GROUP BY doc_id) t USING (doc_id) "
        "LEFT JOIN (VALUES (1, 'finance', 'HIGH', 80), (2, 'credit_card', 'CRITICAL', 95), (3, '/src1/', 'LOW', 20), (5, 'fr/', 'MEDIUM', 55)) v(ord, pattern, level, score) "
        "ON contains(lower(path), pattern) OR contains(lower(name), pattern) OR contains(coalesce(types, ''), pattern)) WHERE k = 1",
        "risk",
    )
)
def asset_override_first_match(spark, sf_dir):
    return risk.assess(classified(spark, sf_dir), OVERRIDES).select("doc_id", "level", "score")


@query(
    o.sql(
        "SELECT r.doc_id, CASE WHEN l.toxic IS NULL THEN r.level WHEN l.toxic = 1 THEN 'CRITICAL' WHEN l.quality = 0 THEN 'MEDIUM' ELSE 'LOW' END AS level, "
        "CAST(CASE WHEN l.toxic IS NULL THEN r.score WHEN l.toxic = 1 THEN 95 WHEN l.quality = 0 THEN 55 ELSE 20 END AS INTEGER) AS score FROM risk r LEFT JOIN labels l ON l.doc_id = r.doc_id",
        "risk",
    )
)
def row_override_effective_risk(spark, sf_dir):
    rows = assessed(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    forced = F.when(F.col("toxic") == 1, "CRITICAL").when(F.col("quality") == 0, "MEDIUM").otherwise("LOW")
    keys = inventory.stand_in(spark, sf_dir).select("doc_id", props.file_key().alias("file_key"))
    manual = keys.join(labels.select("doc_id", forced.alias("forced_level")), "doc_id").select("file_key", "forced_level")
    return risk.effective(rows, manual).select("doc_id", "level", "score")


_TICKET = "'TICKET-' || lpad(CAST(CAST('0x' || substr(sha1(path), 1, 8) AS BIGINT) % 100000 AS VARCHAR), 5, '0')"


@query(
    o.sql(
        "SELECT doc_id, " + ", ".join(f"CASE level {o.PLAN[n]} END AS {n}" for n in o.PLAN) + f", {_TICKET} AS ticket, "
        "CAST(CASE WHEN 3 * secret + 3 * regulated + 2 * issue + 3 * sealed = 0 THEN 1 ELSE 3 * secret + 3 * regulated + 2 * issue + 3 * sealed END AS INTEGER) AS n_actions FROM ("
        "SELECT r.*, coalesce(secret, 0) AS secret, coalesce(regulated, 0) AS regulated, CAST(n_issues > 0 AS INTEGER) AS issue, "
        f"CAST(protected OR {o.marked('coalesce(nullif(content_status, ' + chr(39) * 2 + '), nullif(scan_error, ' + chr(39) * 2 + '), ' + chr(39) * 2 + ')')} AS INTEGER) AS sealed "
        "FROM risk r LEFT JOIN (SELECT doc_id, max(CAST(regexp_matches(type, 'key|token|secret|password') AS INTEGER)) AS secret, max(CAST(type IN ('credit_card', 'iban', 'swift_bic', 'passport_number', 'national_id') AS INTEGER)) AS regulated FROM findings GROUP BY doc_id) t USING (doc_id))",
        "risk",
    )
)
def remediation_plan(spark, sf_dir):
    rows = assessed(spark, sf_dir).select("doc_id", risk.remediation().alias("r"))
    return rows.select("doc_id", "r.status", "r.owner", "r.sla", "r.ticket", F.size("r.actions").alias("n_actions"))


@query(
    o.sql(
        "SELECT doc_id, CASE level WHEN 'CRITICAL' THEN 'Immediate remediation' WHEN 'HIGH' THEN 'Restrict and review' WHEN 'MEDIUM' THEN 'Owner review' ELSE CASE WHEN score > 0 THEN 'Monitor' ELSE 'No action' END END AS label FROM risk",
        "risk",
    )
)
def risk_labels(spark, sf_dir):
    return assessed(spark, sf_dir).select("doc_id", props.risk_label("level", "score").alias("label"))


@query(o.sql("SELECT r.doc_id, coalesce(string_agg(reason, '; ' ORDER BY place), 'no signal') AS reasons FROM risk r LEFT JOIN told t ON t.doc_id = r.doc_id GROUP BY r.doc_id", "told"))
def risk_reasons(spark, sf_dir):
    return assessed(spark, sf_dir).select("doc_id", F.array_join(risk.reasons(), "; ").alias("reasons"))


# -- rollups and lists -----------------------------------------------------------------


@query(o.sql(f"SELECT {o.DEPARTMENT} AS department, count(*) AS files, count(*) FILTER (level = 'CRITICAL') AS critical, count(*) FILTER (level = 'HIGH') AS high, CAST(sum(score) AS BIGINT) AS score FROM risk GROUP BY 1", "risk"))
def department_risk(spark, sf_dir):
    return rollups.by_department(assessed(spark, sf_dir))


@query(o.sql(f"SELECT {o.FOLDER} AS folder, count(*) AS files, count(*) FILTER (level = 'CRITICAL') AS critical, CAST(sum(score) AS BIGINT) AS score, CAST(floor(sum(score) / count(*) + 0.5) AS BIGINT) AS average FROM risk GROUP BY 1 ORDER BY score DESC, folder LIMIT 6", "risk"))
def folder_risk_top(spark, sf_dir):
    return rollups.riskiest_folders(assessed(spark, sf_dir))


@query(
    o.sql(
        "SELECT *, least(CAST(0.32 AS DOUBLE), greatest(CAST(0.06 AS DOUBLE), score / CAST(files * 95 AS DOUBLE) * CAST(0.32 AS DOUBLE))) AS intensity FROM ("
        f"SELECT {o.HEAT} AS label, count(*) AS files, count(*) FILTER (level = 'CRITICAL') AS critical, CAST(sum(score) AS BIGINT) AS score FROM risk GROUP BY 1 ORDER BY score DESC, label LIMIT 12)",
        "risk",
    )
)
def folder_heatmap(spark, sf_dir):
    return rollups.folder_heatmap(assessed(spark, sf_dir))


@query(
    o.sql(
        f"SELECT folder, files, score, greatest(CAST(0.16 AS DOUBLE), score / CAST(max(score) OVER () AS DOUBLE)) AS opacity FROM (SELECT {o.FOLDER} AS folder, count(*) AS files, CAST(sum(score) AS BIGINT) AS score FROM risk GROUP BY 1 ORDER BY score DESC, folder LIMIT 8)",
        "risk",
    )
)
def report_heatmap(spark, sf_dir):
    return rollups.report_heatmap(assessed(spark, sf_dir))


@query(o.sql("SELECT doc_id, level, score FROM risk WHERE level IN ('CRITICAL', 'HIGH') OR locked ORDER BY score DESC, doc_id LIMIT 16", "risk"))
def priority_files(spark, sf_dir):
    return rollups.priority_files(assessed(spark, sf_dir)).select("doc_id", "level", "score")


@query(o.sql("SELECT doc_id, level, score FROM risk WHERE level IN ('CRITICAL', 'HIGH', 'MEDIUM') OR locked ORDER BY score DESC, doc_id LIMIT 18", "risk"))
def remediation_queue(spark, sf_dir):
    return rollups.remediation_queue(assessed(spark, sf_dir)).select("doc_id", "level", "score")


@query(o.sql("SELECT doc_id, score FROM risk WHERE n_findings > 0 OR level IN ('CRITICAL', 'HIGH') ORDER BY score DESC, doc_id LIMIT 10", "risk"))
def findings_queue(spark, sf_dir):
    return rollups.findings_queue(assessed(spark, sf_dir)).select("doc_id", "score")


@query(o.sql("SELECT doc_id FROM risk WHERE level = 'HIGH' AND source = 'local' AND (contains(lower(path), 'finance') OR contains(lower(owner), 'finance') OR doc_id IN (SELECT doc_id FROM findings WHERE contains(type, 'finance')))", "risk"))
def inventory_filter(spark, sf_dir):
    return filters.inventory(assessed(spark, sf_dir), "HIGH", "local", query=" Finance ").select("doc_id")


@query(
    o.sql(
        "SELECT CAST(sum(n) AS BIGINT) AS visible, CAST(sum(s) AS BIGINT) AS sensitive, CAST(floor(sum(s) / sum(n) * 100 + 0.5) AS BIGINT) AS sensitive_percent, CAST(floor(sum(sc) / sum(n) + 0.5) AS BIGINT) AS average_risk, first(source ORDER BY n DESC, source) AS top_source "
        "FROM (SELECT source, count(*) AS n, count(*) FILTER (n_findings > 0) AS s, sum(score) AS sc FROM risk WHERE locked GROUP BY source)",
        "risk",
    )
)
def inventory_metrics(spark, sf_dir):
    return rollups.inventory_metrics(filters.inventory(assessed(spark, sf_dir), "PROTECTED"))


@query(
    o.sql(
        "SELECT 'ALL' AS bucket, count(*) AS files FROM risk UNION ALL SELECT 'PROTECTED', count(*) FROM risk WHERE locked UNION ALL SELECT level, count(r.doc_id) FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) l(level) LEFT JOIN risk r USING (level) GROUP BY level",
        "risk",
    )
)
def risk_bucket_counts(spark, sf_dir):
    return rollups.bucket_counts(assessed(spark, sf_dir))


@query(o.sql("SELECT source, count(*) AS files FROM risk GROUP BY source", "risk"))
def facet_sources(spark, sf_dir):
    return rollups.source_facet(assessed(spark, sf_dir))


@query(o.sql("SELECT type AS finding, count(*) AS files FROM findings GROUP BY type UNION ALL SELECT 'Protected / locked', count(*) FROM risk WHERE locked", "risk"))
def facet_findings(spark, sf_dir):
    return rollups.finding_facet(assessed(spark, sf_dir))


# -- compliance ------------------------------------------------------------------------


def evaluated(spark, sf_dir):
    return compliance.evaluate(assessed(spark, sf_dir))


@query(o.sql("SELECT doc_id, category FROM categories", "categories"))
def compliance_categories(spark, sf_dir):
    return compliance.with_categories(classified(spark, sf_dir)).select("doc_id", F.explode("categories").alias("category"))


@query(o.sql("SELECT doc_id, framework, base, data, evidence, exposure, location, protection, CAST(compliance_score AS INTEGER) AS score, control FROM evaluated", "evaluated"))
def compliance_scores(spark, sf_dir):
    return evaluated(spark, sf_dir).select("doc_id", "framework", "base", "data", "evidence", "exposure", "location", "protection", F.col("compliance_score").alias("score"), "control")


@query(
    o.sql(
        "SELECT doc_id, CAST(max(compliance_score) AS INTEGER) AS score, CASE WHEN max(compliance_score) >= 85 THEN 'CRITICAL' WHEN max(compliance_score) >= 70 THEN 'HIGH' WHEN max(compliance_score) >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity, "
        "count(*) AS n_frameworks, string_agg(framework, ',' ORDER BY framework) AS frameworks, "
        "CASE WHEN bool_or(wide) THEN 'broad access' WHEN doc_id IN (SELECT doc_id FROM categories WHERE category IN ('pci_payment', 'phi', 'credentials_secrets', 'government_ids')) THEN 'high impact' ELSE 'relevant' END AS criticality "
        "FROM evaluated GROUP BY doc_id",
        "evaluated",
    )
)
def compliance_file_summary(spark, sf_dir):
    return compliance.per_file(evaluated(spark, sf_dir))


@query(o.sql("SELECT category, count(*) AS files FROM categories WHERE doc_id IN (SELECT doc_id FROM evaluated) GROUP BY category ORDER BY files DESC, category LIMIT 8", "evaluated"))
def compliance_top_categories(spark, sf_dir):
    return compliance.top_categories(evaluated(spark, sf_dir))


@query(o.sql("SELECT control, count(DISTINCT doc_id) AS files FROM evaluated GROUP BY control ORDER BY files DESC, control LIMIT 8", "evaluated"))
def compliance_top_controls(spark, sf_dir):
    return compliance.top_controls(evaluated(spark, sf_dir))


# -- scans compared --------------------------------------------------------------------

_EARLIER = {
    "earlier": "SELECT doc_id, source, share, path, name, CASE WHEN doc_id % 10 = 0 THEN sha256(sha256 || 'earlier') ELSE sha256 END AS sha256 FROM files WHERE doc_id % 13 <> 0 UNION ALL SELECT doc_id, source, share, '/gone' || path, name, sha256 FROM files WHERE doc_id % 19 = 0"
}


def two_scans(spark, sf_dir):
    now = inventory.stand_in(spark, sf_dir).drop("content")
    return now, inventory.previous(now)


@query(o.sql(f"SELECT {o.KEY.replace('source', 'f.source').replace('share', 'f.share').replace('path', 'f.path')} AS key, f.path, e.sha256 AS previous_hash, f.sha256 AS current_hash FROM files f JOIN earlier e ON f.path = e.path AND f.source = e.source AND f.share = e.share WHERE f.sha256 <> e.sha256", "files", more=_EARLIER))
def hash_changed(spark, sf_dir):
    return history.changed(*two_scans(spark, sf_dir))


@query(o.sql(f"SELECT {o.KEY} AS key, path FROM files WHERE {o.KEY} NOT IN (SELECT {o.KEY} FROM earlier)", "files", more=_EARLIER))
def hash_added(spark, sf_dir):
    return history.only_in(*two_scans(spark, sf_dir))


@query(o.sql(f"SELECT {o.KEY} AS key, path FROM earlier WHERE {o.KEY} NOT IN (SELECT {o.KEY} FROM files)", "files", more=_EARLIER))
def hash_removed(spark, sf_dir):
    return history.only_in(*reversed(two_scans(spark, sf_dir)))


@query(
    o.sql(
        f"SELECT sha256 AS hash, count(*) AS files, min({o.KEY}) AS first_key, first(name ORDER BY {o.KEY}) AS first_name, array_to_string(list(path ORDER BY {o.KEY})[1:20], ';') AS paths FROM files GROUP BY sha256 HAVING count(*) > 1", "files"
    )
)
def hash_duplicate_groups(spark, sf_dir):
    rows = history.duplicate_groups(inventory.stand_in(spark, sf_dir).drop("content"))
    return rows.withColumn("paths", F.array_join("paths", ";"))


def scans(spark, sf_dir):
    """Orders as scans: the customer's nation is the tenant, line items are the files by level."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), "o_custkey", F.col("o_orderdate").alias("created_at"))
    tenant = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("tenant_id"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("scan_id")).agg(
        F.count_if(F.expr("l_quantity > 40")).alias("critical"), F.count_if(F.expr("l_quantity > 25 AND l_quantity <= 40")).alias("high"),
        F.count_if(F.expr("l_quantity > 10 AND l_quantity <= 25")).alias("medium"), F.count_if(F.expr("l_quantity <= 10")).alias("low"), F.count(F.lit(1)).alias("total_files"),
    )
    counters = ["critical", "high", "medium", "low", "total_files"]
    return orders.join(tenant, "o_custkey").drop("o_custkey").join(lines, "scan_id", "left").fillna(0, counters).select("tenant_id", "scan_id", "created_at", *counters)


_SCANS = {
    "scans": "SELECT c_nationkey AS tenant_id, o_orderkey AS scan_id, o_orderdate AS created_at, count(l_orderkey) FILTER (l_quantity > 40) AS critical, count(l_orderkey) FILTER (l_quantity > 25 AND l_quantity <= 40) AS high, "
    "count(l_orderkey) FILTER (l_quantity > 10 AND l_quantity <= 25) AS medium, count(l_orderkey) FILTER (l_quantity <= 10) AS low, count(l_orderkey) AS total_files "
    "FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
    "ranked": "SELECT *, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, scan_id DESC) AS INTEGER) AS back FROM scans",
}


@query(o.sql("SELECT * EXCLUDE (back) FROM ranked WHERE back = 1", more=_SCANS))
def history_latest_per_tenant(spark, sf_dir):
    return history.latest(scans(spark, sf_dir))


@query(o.sql("SELECT * FROM ranked WHERE back <= 14", more=_SCANS))
def history_trend_14(spark, sf_dir):
    return history.trend(scans(spark, sf_dir))


@query(
    o.sql(
        " UNION ALL ".join(f"SELECT a.tenant_id, '{c}' AS metric, a.{c} AS current, b.{c} AS prior, a.{c} - b.{c} AS delta FROM ranked a JOIN ranked b ON a.tenant_id = b.tenant_id AND a.back = 1 AND b.back = 2" for c in history.COUNTERS),
        more=_SCANS,
    )
)
def history_delta(spark, sf_dir):
    return history.deltas(scans(spark, sf_dir))


@query(o.sql("SELECT tenant_id, scan_id, 'CRITICAL' AS severity, critical FROM scans WHERE critical > 0", more=_SCANS))
def scan_alerts(spark, sf_dir):
    return history.alerts(scans(spark, sf_dir))


@query(
    o.sql(
        "SELECT n.n_nationkey AS tenant_id, n_name AS name, r.scan_id, coalesce(s.n, 0) AS n_scans, coalesce(c.n, 0) AS n_users, "
        "CASE WHEN r.scan_id IS NULL THEN NULL WHEN total_files <= 0 THEN 100 ELSE CAST(greatest(0, least(100, round_even(100 - (critical * 95 + high * 80 + medium * 55 + low * 20) / total_files, 0))) AS BIGINT) END AS posture "
        "FROM nation n LEFT JOIN (SELECT * FROM ranked WHERE back = 1) r ON r.tenant_id = n_nationkey LEFT JOIN (SELECT tenant_id, count(*) AS n FROM scans GROUP BY tenant_id) s ON s.tenant_id = n_nationkey LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) c ON c.c_nationkey = n_nationkey",
        more=_SCANS,
    )
)
def portfolio_posture(spark, sf_dir):
    tenants = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tenant_id"), F.col("n_name").alias("name"))
    users = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("tenant_id"))
    return history.portfolio(tenants, scans(spark, sf_dir), {"users": users}).select("tenant_id", "name", "scan_id", "n_scans", "n_users", "posture")


@query("SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS tenant_id FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)")
def tenant_registry_union(spark, sf_dir):
    known = table(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("tenant_id"))
    users = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("tenant_id"))
    vendors = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("tenant_id"))
    return history.registry(known, users, vendors)


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 200")
def audit_tail(spark, sf_dir):
    return history.tail(table(spark, sf_dir, "events").select("event_id", "event_type"), 200, "event_id")


#: Instead of the clock, so that results stay as they are.
NOW = datetime(2024, 1, 20, 12, 0, 0)


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-19 12:00:00'")
def time_range_rolling(spark, sf_dir):
    return filters.in_range(table(spark, sf_dir, "events"), "ts", days=1, now=NOW).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-14 00:00:00'")
def time_range_days(spark, sf_dir):
    return filters.in_range(table(spark, sf_dir, "events"), "ts", days=7, now=NOW).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-09 23:59:59'")
def time_range_custom(spark, sf_dir):
    return filters.in_range(table(spark, sf_dir, "events"), "ts", start="2024-01-05", end="2024-01-09").select("event_id")


@query(
    "WITH t AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL) "
    "SELECT user_id, second, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY second RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS BIGINT) AS failures FROM t"
)
def login_failure_window(spark, sf_dir):
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    return history.failures_in_window(errors, "user_id", "ts", 86400)


_WORST = f"SELECT {o.DEPARTMENT} AS department, max(CASE level WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS worst, count(*) FILTER (level = 'CRITICAL') AS critical FROM risk GROUP BY 1"


@query(o.sql(f"SELECT lower(department) AS name, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][worst] AS severity, CASE WHEN worst >= 3 THEN 'block-and-alert' ELSE 'monitor' END AS action, critical || ' critical files' AS reason FROM ({_WORST})", "risk"))
def dlp_policy(spark, sf_dir):
    """Each department's worst level as an override of its paths, turned into a policy."""
    rank = F.array_position(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "CRITICAL"))), F.col("level"))
    worst = assessed(spark, sf_dir).groupBy(props.department().alias("department")).agg(F.max_by("level", rank).alias("level"), F.count_if(F.col("level") == "CRITICAL").alias("critical"))
    return history.level_policy(worst.select(F.lower("department").alias("pattern"), "level", F.concat("critical", F.lit(" critical files")).alias("reason")))


@query(
    o.sql(
        SUMMARY_SQL.replace("FROM risk", "FROM (SELECT r.* REPLACE (CASE WHEN l.toxic IS NULL THEN r.level WHEN l.toxic = 1 THEN 'CRITICAL' WHEN l.quality = 0 THEN 'MEDIUM' ELSE 'LOW' END AS level) FROM risk r LEFT JOIN labels l ON l.doc_id = r.doc_id)"),
        "risk",
    )
)
def effective_summary(spark, sf_dir):
    """The summary after manual overrides of levels."""
    forced = F.when(F.col("toxic") == 1, "CRITICAL").when(F.col("quality") == 0, "MEDIUM").otherwise("LOW")
    keys = inventory.stand_in(spark, sf_dir).select("doc_id", props.file_key().alias("file_key"))
    manual = keys.join(table(spark, sf_dir, "labels").select("doc_id", forced.alias("forced_level")), "doc_id").select("file_key", "forced_level")
    return rollups.summary(risk.effective(assessed(spark, sf_dir), manual))


@query(
    o.sql(
        "SELECT type, CAST(sum(count) AS BIGINT) AS matches, count(DISTINCT doc_id) AS files FROM findings GROUP BY type UNION ALL SELECT 'Hash changed', count(*), count(*) FROM files f JOIN earlier e ON f.path = e.path AND f.source = e.source AND f.share = e.share WHERE f.sha256 <> e.sha256 HAVING count(*) > 0 "
        "UNION ALL SELECT 'Duplicate hash', count(*), count(*) FROM (SELECT count(*) OVER (PARTITION BY sha256) AS n FROM files) WHERE n > 1 HAVING count(*) > 0",
        "findings", "files", more=_EARLIER,
    )
)
def finding_stats_with_integrity(spark, sf_dir):
    return rollups.findings_and_changes(classified(spark, sf_dir), views.integrity_flags(*two_scans(spark, sf_dir)))


@query(
    o.sql(
        f"SELECT doc_id, name, level, score, {_TICKET} AS ticket, CASE level {o.PLAN['sla']} END AS sla, CASE level {o.PLAN['status']} END AS status, coalesce(nullif(trim(owner), ''), CASE level {o.PLAN['owner']} END) AS owner "
        "FROM risk WHERE level IN ('CRITICAL', 'HIGH', 'MEDIUM') OR locked ORDER BY score DESC, doc_id LIMIT 18",
        "risk",
    )
)
def remediation_tickets(spark, sf_dir):
    return rollups.remediation_tickets(assessed(spark, sf_dir))


# -- keyword library -------------------------------------------------------------------


def library(spark, sf_dir, rows: str):
    """Keyword groups from the parts table: brands as languages, types as finding types, names as terms."""
    part = table(spark, sf_dir, "part").where(rows)
    words = F.split(F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9]+", " ")), " ")
    return part.select(
        F.lit("gdpr").alias("framework"), keywords.language("p_brand").alias("language"), F.lit("custom").alias("category"), keywords.token("p_type").alias("type"),
        F.filter(words, lambda w: w != "").alias("terms"), F.col("p_partkey").cast("int").alias("ord"),
    )


def _library_sql(rows: str) -> str:
    token = "regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g')"
    return (
        f"SELECT 'gdpr' AS framework, regexp_replace(lower(trim(p_brand)), '[^a-z0-9_-]', '', 'g') AS language, 'custom' AS category, {token} AS type, "
        f"list_filter(string_split(lower(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS terms, p_partkey AS ord FROM part WHERE {rows}"
    )


_LIBRARY = {
    "current": _library_sql("p_partkey % 3 <> 0"),
    "incoming": _library_sql("p_partkey % 3 = 0"),
    "have": "SELECT DISTINCT language, type, unnest(terms) AS term FROM current",
    "give": "SELECT language, type, unnest(terms) AS term FROM incoming",
}


@query(o.sql("SELECT language, type, CAST(count(DISTINCT term) AS INTEGER) AS count FROM (SELECT * FROM have UNION ALL SELECT * FROM give) GROUP BY language, type", more=_LIBRARY))
def keyword_merge(spark, sf_dir):
    merged = keywords.apply_import(library(spark, sf_dir, "p_partkey % 3 <> 0"), library(spark, sf_dir, "p_partkey % 3 = 0"))
    return merged.select("language", "type", "count")


@query(
    o.sql(
        "SELECT (SELECT count(*) FROM (SELECT DISTINCT language, type, term FROM give EXCEPT SELECT language, type, term FROM have)) AS new, "
        "(SELECT count(*) FROM give) - (SELECT count(*) FROM (SELECT DISTINCT language, type, term FROM give EXCEPT SELECT language, type, term FROM have)) AS duplicates",
        more=_LIBRARY,
    )
)
def keyword_import_preview(spark, sf_dir):
    return keywords.preview(library(spark, sf_dir, "p_partkey % 3 <> 0"), library(spark, sf_dir, "p_partkey % 3 = 0"))


@query(
    o.sql(
        "SELECT language, type, CAST(count(DISTINCT term) AS INTEGER) AS count FROM (SELECT * FROM have WHERE type NOT IN (SELECT type FROM incoming) UNION ALL SELECT * FROM give) GROUP BY language, type",
        more=_LIBRARY,
    )
)
def keyword_import_replace_type(spark, sf_dir):
    after = keywords.apply_import(library(spark, sf_dir, "p_partkey % 3 <> 0"), library(spark, sf_dir, "p_partkey % 3 = 0"), "replace_type")
    return after.select("language", "type", "count")


@query(o.sql('SELECT count(*) AS "groups", CAST(sum(len(terms)) AS BIGINT) AS terms, count(DISTINCT language) AS languages, count(DISTINCT category) AS categories FROM every', more={"every": _library_sql("true")}))
def keyword_totals(spark, sf_dir):
    return keywords.totals(library(spark, sf_dir, "true"))


# -- validated personal data -----------------------------------------------------------


def _validated(spark, sf_dir, kind: str) -> DataFrame:
    rows = inventory.stand_in(spark, sf_dir).select("doc_id", F.explode(validated.values("content", kind)).alias("value"))
    return rows


@query(
    o.sql(
        "SELECT DISTINCT doc_id, value FROM (SELECT doc_id, unnest(regexp_extract_all(content, '" + o.EMAIL + "')) AS value FROM files) WHERE NOT contains(value, '..') "
        "AND NOT starts_with(value, '.') AND len(list_filter(string_split(split_part(value, '@', 2), '.'), lambda x: starts_with(x, '-') OR ends_with(x, '-'))) = 0",
        "files",
    )
)
def gdpr_email(spark, sf_dir):
    return _validated(spark, sf_dir, "gdpr_email_address")


@query(
    o.sql(
        "SELECT DISTINCT doc_id, replace(replace(upper(value), ' ', ''), '-', '') AS value FROM (SELECT doc_id, unnest(regexp_extract_all(content, '(?i)(?:^|[^A-Za-z0-9])((?:AZE|OR|AA)[ -]?[0-9]{7,8})(?:$|[^A-Za-z0-9])', 1)) AS value FROM files)", "files"
    )
)
def gdpr_national_id(spark, sf_dir):
    return _validated(spark, sf_dir, "gdpr_national_id")


@query()
def gdpr_card_luhn(spark, sf_dir):
    return _validated(spark, sf_dir, "gdpr_payment_card_data")


@query(
    o.sql(
        "SELECT DISTINCT doc_id, value FROM (SELECT doc_id, upper(unnest(string_split_regex(content, '[^A-Za-z0-9]+'))) AS value FROM files) WHERE regexp_full_match(value, '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}') AND length(value) BETWEEN 15 AND 34 "
        "AND list_reduce(list_transform(string_split(substr(value, 5) || substr(value, 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END), lambda r, c: (r * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97, 0) = 1",
        "files",
    )
)
def gdpr_iban_mod97(spark, sf_dir):
    return _validated(spark, sf_dir, "gdpr_bank_account_data")


def _rules(*types: str) -> tuple:
    return tuple(r for r in personal_rules.RULES if r.type in types or not types)


#: The year that dates of birth are compared with, in place of the clock's.
THIS_YEAR = 2026


#: Values after context words that the SQL of the two contextual queries looks at in a text.
SQL_VALUES = 20


def _personal(spark, sf_dir, *types: str, most_values: int | None = None) -> DataFrame:
    return personal.detect(inventory.stand_in(spark, sf_dir), _rules(*types), this_year=THIS_YEAR, most_values=most_values)


@query()
def gdpr_near_keywords(spark, sf_dir):
    found = _personal(spark, sf_dir, "gdpr_phone_number", "gdpr_birth_details", "gdpr_fin_pin", "gdpr_salary_compensation")
    return found.select("doc_id", "type", F.explode("samples").alias("value"))


@query()
def personal_findings(spark, sf_dir):
    """All rules, over whole texts and paths."""
    return _personal(spark, sf_dir)


@query(o.sql(o.contextual({r.type: r.words for r in _rules("gdpr_race_ethnicity", "gdpr_religious_philosophical_belief")}, 220, 3, 160, 140), "files"))
def personal_contextual(spark, sf_dir):
    return _personal(spark, sf_dir, "gdpr_race_ethnicity", "gdpr_religious_philosophical_belief", most_values=SQL_VALUES).select("doc_id", "type", F.explode("samples").alias("sample"))


@query(o.sql("SELECT CAST(count(DISTINCT doc_id) AS BIGINT) AS files, category, count(*) AS findings FROM (" + o.contextual({r.type: r.words for r in _rules("gdpr_race_ethnicity", "gdpr_religious_philosophical_belief")}, 220, 3, 160, 140, "DISTINCT doc_id, type, 'special_category_context' AS category") + ") GROUP BY category", "files"))
def personal_categories(spark, sf_dir):
    found = _personal(spark, sf_dir, "gdpr_race_ethnicity", "gdpr_religious_philosophical_belief", most_values=SQL_VALUES)
    return found.groupBy("category").agg(F.count_distinct("doc_id").alias("files"), F.count(F.lit(1)).alias("findings"))


@query()
def personal_risk(spark, sf_dir):
    """Score and level where personal data counts as well."""
    rows = findings.classify(records(spark, sf_dir), keep_content=True)
    return risk.assess(personal.into_findings(rows.drop("content"), personal.detect(rows, this_year=THIS_YEAR))).select("doc_id", "score", "level", F.size("findings").alias("n_findings"))


TERMS = [("custom_ledger", ["invoice register", "export"]), ("custom_code", ["git clone", "api_key"]), ("custom_people", ["patient", "board minutes"])]


@query(
    o.sql(
        "SELECT doc_id, type, term FROM (SELECT doc_id, lower(content || ' ' || coalesce(name, '') || ' ' || coalesce(path, '') || ' ') AS evidence FROM files) "
        "JOIN (VALUES " + ", ".join(f"('{k}', '{t}')" for k, ts in TERMS for t in ts) + ") t(type, term) ON regexp_matches(evidence, '(^|[^a-z0-9_])' || term || '($|[^a-z0-9_])')",
        "files",
    )
)
def custom_keyword_findings(spark, sf_dir):
    groups = spark.createDataFrame([(k, t, "custom", k, "HIGH") for k, t in TERMS], "type string, terms array<string>, category string, label string, risk string")
    found = personal.custom_terms(inventory.stand_in(spark, sf_dir), groups)
    return found.select("doc_id", "type", F.explode("terms").alias("term"))


# -- reports ---------------------------------------------------------------------------


@query(
    o.sql(
        "SELECT doc_id, type, label FROM findings JOIN (VALUES " + ", ".join(f"('{p}', '{label}')" for p, label in report.DATA_TYPES) + ") l(pattern, label) ON regexp_matches(type, pattern)",
        "findings",
    )
)
def finding_data_types(spark, sf_dir):
    rows = findings.long_form(classified(spark, sf_dir))
    return rows.select("doc_id", "type", F.explode(report.data_types(F.col("type"))).alias("label"))


@query()
def risk_register(spark, sf_dir):
    return report.register(assessed(spark, sf_dir))


@query(
    o.sql(
        "SELECT category, count(DISTINCT doc_id) AS files FROM (SELECT r.doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(reason), '{pattern}') THEN '{name}'" for pattern, name in report.REASONS) + " ELSE 'Risk context' END AS category FROM risk r LEFT JOIN told t ON t.doc_id = r.doc_id) GROUP BY category",
        "told",
    )
)
def reason_categories(spark, sf_dir):
    return report.reason_counts(assessed(spark, sf_dir))


# -- views -----------------------------------------------------------------------------


@query(
    o.sql(
        "SELECT CASE " + " ".join(f"WHEN extension IN ({', '.join(repr(e) for e in v)}) THEN '{k}'" for k, v in {"Custom": (".txt",), **views.EXTENSION_GROUPS}.items()) + " ELSE 'Other' END AS extension_group, count(*) AS files FROM normal GROUP BY 1",
        "normal",
    )
)
def extension_groups(spark, sf_dir):
    return records(spark, sf_dir).groupBy(views.extension_group("extension", (".txt",)).alias("extension_group")).agg(F.count(F.lit(1)).alias("files"))


@query(o.sql("SELECT tenant_id, CASE WHEN posture >= 80 THEN 'healthy exposure' WHEN posture >= 55 THEN 'watch risk concentration' ELSE 'remediate at once' END AS label FROM (SELECT tenant_id, CASE WHEN total_files <= 0 THEN 100 ELSE greatest(0, least(100, round_even(100 - (critical * 95 + high * 80 + medium * 55 + low * 20) / total_files, 0))) END AS posture FROM ranked WHERE back = 1)", more=_SCANS))
def posture_labels(spark, sf_dir):
    return history.latest(scans(spark, sf_dir)).select("tenant_id", views.posture_label(rollups.posture_from_counts()).alias("label"))


@query(o.sql("SELECT scan_id, tenant_id FROM scans WHERE tenant_id = 3 ORDER BY created_at DESC, scan_id DESC LIMIT 200", more=_SCANS))
def history_page(spark, sf_dir):
    return views.history_page(views.of_tenant(scans(spark, sf_dir), 3)).select("scan_id", "tenant_id")


@query(o.sql("SELECT scan_id FROM scans ORDER BY created_at DESC, scan_id LIMIT 50 OFFSET 100", more=_SCANS))
def scans_third_page(spark, sf_dir):
    return views.page(scans(spark, sf_dir), 3, 50, F.col("created_at").desc(), "scan_id").select("scan_id")


@query(o.sql("SELECT tenant_id, CASE metric WHEN 'total_files' THEN 'Total files' ELSE upper(metric[1]) || metric[2:] END AS label, current, prior, delta FROM (" + " UNION ALL ".join(f"SELECT a.tenant_id, '{c}' AS metric, a.{c} AS current, b.{c} AS prior, a.{c} - b.{c} AS delta FROM ranked a JOIN ranked b ON a.tenant_id = b.tenant_id AND a.back = 1 AND b.back = 2" for c in history.COUNTERS) + ")", more=_SCANS))
def report_comparison(spark, sf_dir):
    return views.comparison(scans(spark, sf_dir))


@query(o.sql(f"SELECT {o.KEY.replace('source', 'f.source').replace('share', 'f.share').replace('path', 'f.path')} AS key, f.path, e.sha256 AS previous_hash, f.sha256 AS current_hash, count(*) OVER () AS changed_files FROM files f JOIN earlier e ON f.path = e.path AND f.source = e.source AND f.share = e.share WHERE f.sha256 <> e.sha256 ORDER BY key LIMIT 100", "files", more=_EARLIER))
def hash_changes_first_100(spark, sf_dir):
    return views.hash_changes(*two_scans(spark, sf_dir))


@query(o.sql(f"SELECT sha256 AS hash, count(*) AS files, first(name ORDER BY {o.KEY}) AS first_name FROM files GROUP BY sha256 HAVING count(*) > 1 ORDER BY files DESC, first_name, hash LIMIT 100", "files"))
def hash_duplicates_first_100(spark, sf_dir):
    return views.hash_duplicates(inventory.stand_in(spark, sf_dir).drop("content")).select("hash", "files", "first_name")


@query(o.sql("SELECT f.doc_id, coalesce(f.sha256 <> e.sha256, false) AS hash_changed, count(*) OVER (PARTITION BY f.sha256) > 1 AS hash_duplicate FROM files f LEFT JOIN earlier e ON f.path = e.path AND f.source = e.source AND f.share = e.share", "files", more=_EARLIER))
def integrity_flags(spark, sf_dir):
    return views.integrity_flags(*two_scans(spark, sf_dir))


@query(o.sql("SELECT count(*) FILTER (coalesce(trim(owner), '') <> '') AS owner_resolved, count(*) FILTER (coalesce(trim(owner), '') = '') AS owner_missing FROM files", "files"))
def owners_resolved(spark, sf_dir):
    return views.owners(inventory.stand_in(spark, sf_dir))


@query(o.sql("SELECT doc_id, level, score FROM risk ORDER BY score DESC, doc_id LIMIT 6", "risk"))
def executive_six(spark, sf_dir):
    return views.executive(assessed(spark, sf_dir)).select("doc_id", "level", "score")


@query(o.sql("SELECT doc_id, score, (SELECT count(*) FROM risk) AS total_files, (SELECT count(*) FROM risk) > 500 AS result_truncated FROM risk ORDER BY doc_id LIMIT 500", "risk"))
def result_first_500(spark, sf_dir):
    return views.truncated(assessed(spark, sf_dir)).select("doc_id", "score", "total_files", "result_truncated")


@query(o.sql("SELECT type AS signal, count(DISTINCT doc_id) AS files, CAST(sum(count) AS BIGINT) AS hits, round(count(DISTINCT doc_id) * 100 / (SELECT count(*) FROM files), 1) AS percent_of_files FROM findings GROUP BY type", "findings", "files"))
def workbook_signals(spark, sf_dir):
    return views.sheets(assessed(spark, sf_dir), scans(spark, sf_dir))["signals"]


@query(o.sql("SELECT doc_id, contains(lower(path), '/samples/') AS demo FROM files", "files"))
def demo_paths(spark, sf_dir):
    return inventory.stand_in(spark, sf_dir).select("doc_id", views.demo_path("path").alias("demo"))


@query(
    o.sql(
        "SELECT *, 'seen ' || seen || '; hidden ' || hidden || '; system ' || system || '; skipped ' || skipped || '; too deep ' || too_deep || '; extensions ' || extensions AS text FROM ("
        "SELECT count(*) AS seen, count(*) FILTER (contains(path, '/.')) AS hidden, count(*) FILTER (contains(lower(path), '/windows/')) AS system, count(*) FILTER (contains(lower(path), '/windows/') OR contains(path, '/node_modules/')) AS skipped, "
        "count(*) FILTER (len(list_filter(string_split(path, '/'), lambda p: p <> '')) - 1 > 3) AS too_deep, array_to_string(list_sort(list(DISTINCT extension))[1:5], ', ') AS extensions FROM normal)",
        "normal",
    )
)
def scan_diagnostics(spark, sf_dir):
    found = views.diagnostics(inventory.stand_in(spark, sf_dir).drop("content"), 3)
    return found.withColumn("extensions", F.array_join("extensions", ", "))


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'click')")
def allowed_events(spark, sf_dir):
    known = spark.createDataFrame([("error",), ("click",), ("error",)], "event_type string")
    return views.allowed(table(spark, sf_dir, "events"), known, "event_type").select("event_id")


@query(o.sql("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS place, type, risk, CAST(greatest(count, 1) AS INTEGER) AS count FROM findings", "findings"))
def compliance_evidence(spark, sf_dir):
    return compliance.evidence(assessed(spark, sf_dir)).select("doc_id", F.col("place").cast("long").alias("place"), "type", "risk", "count")


_CHOSEN = {
    "chosen": "SELECT * FROM evaluated WHERE framework IN ('gdpr', 'iso27001')",
    "per_file": "SELECT doc_id, max(compliance_score) AS score, string_agg(framework, ',' ORDER BY framework) AS frameworks FROM chosen GROUP BY doc_id",
    "first_categories": "SELECT category, count(*) AS files FROM categories WHERE doc_id IN (SELECT doc_id FROM chosen) GROUP BY category ORDER BY files DESC, category LIMIT 8",
    "first_controls": "SELECT control, count(DISTINCT doc_id) AS files FROM chosen GROUP BY control ORDER BY files DESC, control LIMIT 8",
    "first_files": "SELECT *, CASE WHEN score >= 85 THEN 'CRITICAL' WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM per_file ORDER BY score DESC, doc_id LIMIT 10",
}


@query(
    o.sql(
        "SELECT count(*) AS total, count(*) FILTER (score >= 85) AS critical, count(*) FILTER (score >= 70 AND score < 85) AS high, count(*) FILTER (score >= 40 AND score < 70) AS medium, count(*) FILTER (score < 40) AS low, "
        "(SELECT string_agg(category || ' ' || files, '; ' ORDER BY files DESC, category) FROM first_categories) AS categories, (SELECT string_agg(control || ' ' || files, '; ' ORDER BY files DESC, control) FROM first_controls) AS controls, "
        "(SELECT string_agg(doc_id || ' ' || score || ' ' || severity || ' ' || frameworks, '; ' ORDER BY score DESC, doc_id) FROM first_files) AS files FROM per_file",
        "evaluated", more=_CHOSEN,
    )
)
def compliance_summary(spark, sf_dir):
    """Counts by severity, and the first categories, controls and files as text."""
    found = compliance.summary(assessed(spark, sf_dir), ["GDPR", "iso27001", "gdpr"])
    told = lambda name, *fields: F.array_join(F.transform(name, lambda x: F.concat_ws(" ", *[x[f].cast("string") for f in fields])), "; ")
    return found.select(
        F.col("total_compliance_findings").alias("total"), "critical", "high", "medium", "low", told("top_violated_categories", "category", "files").alias("categories"),
        told("remediation_priorities", "control", "files").alias("controls"), told("top_risky_files", "doc_id", "score", "severity", "frameworks").alias("files"),
    )


@query(o.sql("SELECT r.doc_id, CAST(row_number() OVER (PARTITION BY r.doc_id ORDER BY place) - 1 AS INTEGER) AS place, coalesce(advice, 'keep watching and confirm the owner') AS advice FROM risk r LEFT JOIN advised a ON a.doc_id = r.doc_id", "advised"))
def risk_recommendations(spark, sf_dir):
    return assessed(spark, sf_dir).select("doc_id", F.posexplode(risk.recommendations()).alias("place", "advice"))


_USER_PATH = "'C:\\Users\\' || CASE doc_id % 3 WHEN 0 THEN 'test.user01' WHEN 1 THEN 'Other' ELSE 'Third' END || CASE doc_id % 5 WHEN 0 THEN '\\Desktop' WHEN 1 THEN '\\Documents' WHEN 2 THEN '\\Projects\\Secure' WHEN 3 THEN '\\AppData' ELSE '' END || '\\doc_' || doc_id || '.txt'"


@query("WITH f AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'D:/data/doc_' || doc_id ELSE " + _USER_PATH + " END AS path FROM documents) SELECT doc_id, path FROM f WHERE starts_with(path, 'D:/data/') OR starts_with(path, 'C:\\Users\\test.user01\\Desktop\\') OR starts_with(path, 'C:\\Users\\test.user01\\Projects\\Secure\\')")
def endpoint_scopes(spark, sf_dir):
    """Documents as files of three users of a machine: those in one user's desktop, a folder below that profile and a folder of a drive."""
    path = F.expr("CASE WHEN doc_id % 7 = 0 THEN 'D:/data/doc_' || doc_id ELSE " + _USER_PATH.replace("\\", "\\\\") + " END")
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return endpoints.in_scopes(files, endpoints.scopes(["desktop", "D:/data", "Projects/Secure"], "test.user01"))


@query(o.sql(f"SELECT {o.KEY} AS key, 'added' AS state FROM files WHERE {o.KEY} NOT IN (SELECT {o.KEY} FROM earlier) UNION ALL SELECT {o.KEY}, 'removed' FROM earlier WHERE {o.KEY} NOT IN (SELECT {o.KEY} FROM files) UNION ALL SELECT {o.KEY.replace('source', 'f.source').replace('share', 'f.share').replace('path', 'f.path')}, 'changed' FROM files f JOIN earlier e ON f.path = e.path AND f.source = e.source AND f.share = e.share WHERE f.sha256 <> e.sha256", "files", more=_EARLIER))
def rescan_states(spark, sf_dir):
    now, earlier = two_scans(spark, sf_dir)
    return views.rescan(earlier, now)


@query(
    o.sql(
        "SELECT count(*) AS tenants, CAST(sum(critical) AS BIGINT) AS critical, string_agg(n_name || ' ' || posture, ', ' ORDER BY n_name) FILTER (place <= 4) AS shown FROM ("
        "SELECT n_name, critical, row_number() OVER (ORDER BY n_name) AS place, CASE WHEN critical IS NULL THEN NULL WHEN total_files <= 0 THEN 100 ELSE CAST(greatest(0, least(100, round_even(100 - (critical * 95 + high * 80 + medium * 55 + low * 20) / total_files, 0))) AS BIGINT) END AS posture "
        "FROM nation LEFT JOIN (SELECT * FROM ranked WHERE back = 1) ON tenant_id = n_nationkey)",
        more=_SCANS,
    )
)
def portfolio_totals(spark, sf_dir):
    tenants = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tenant_id"), F.col("n_name").alias("name"))
    found = views.portfolio_totals(tenants, scans(spark, sf_dir))
    return found.select("tenants", "critical", F.array_join(F.transform("shown", lambda x: F.concat(x["name"], F.lit(" "), x["posture"].cast("string"))), ", ").alias("shown"))


@query(o.sql("SELECT 'source' AS list, source AS value FROM (SELECT DISTINCT source FROM risk) UNION ALL SELECT 'finding', type FROM (SELECT DISTINCT type FROM findings) UNION ALL SELECT 'finding', 'Protected / locked' WHERE EXISTS (SELECT 1 FROM risk WHERE locked)", "risk", "findings"))
def pick_lists(spark, sf_dir):
    return views.pick_lists(assessed(spark, sf_dir))


@query("SELECT event_id FROM events e WHERE ts > TIMESTAMP '2024-01-14 00:00:00' AND event_type <> 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-14 00:00:00')")
def live_tokens(spark, sf_dir):
    """Events as tokens of their users, errors as revocations, at a fixed moment."""
    events = table(spark, sf_dir, "events")
    tokens = events.where("event_type <> 'error'").select("event_id", F.col("user_id").alias("token_id"), F.col("ts").alias("issued_at"))
    revoked = events.where("event_type = 'error'").select(F.col("user_id").alias("token_id"), F.col("ts").alias("revoked_at"))
    return views.live_tokens(tokens, revoked, F.lit(datetime(2024, 1, 21))).select("event_id")
