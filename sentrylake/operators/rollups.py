"""Counts, posture scores, concentrations and top lists over assessed records.

Every list that is cut has a last sort key that makes it unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import props
from . import filters
from .risk import LEVELS


def _count_if(condition: Column) -> Column:
    return F.count_if(condition)


def _levels() -> list[Column]:
    return [_count_if(F.col("level") == x).alias(x.lower()) for x in LEVELS]


def summary(assessed: DataFrame) -> DataFrame:
    """One row: files, files per level, with findings, hidden, protected."""
    return assessed.agg(
        F.count(F.lit(1)).alias("total_files"), *_levels(),
        _count_if(F.size("findings") > 0).alias("sensitive_files"), _count_if(F.col("is_hidden")).alias("hidden_files"),
        _count_if(props.protected_for_summary()).alias("protected_files"),
    )


def level_distribution(assessed: DataFrame) -> DataFrame:
    """level, files of the four levels, zeros included."""
    counts = assessed.agg(*_levels())
    pairs = F.array(*[F.struct(F.lit(x).alias("level"), F.col(x.lower()).alias("files")) for x in LEVELS])
    return counts.select(F.inline(pairs))


def posture_from_counts() -> Column:
    """Posture of a summary row, rounded half to even; 100 without files."""
    exposure = (F.col("critical") * 95 + F.col("high") * 80 + F.col("medium") * 55 + F.col("low") * 20) / F.col("total_files").cast("double")
    # rint rounds halves to even and keeps to doubles
    return F.when(F.col("total_files") <= 0, F.lit(100)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.rint(100 - exposure)))).cast("long")


def posture_from_files(assessed: DataFrame) -> DataFrame:
    """Posture from the average score of the files, which is rounded half up; 100 without files."""
    mean = props.half_up(F.avg("score"))
    return assessed.agg(F.coalesce(F.greatest(F.lit(0), F.least(F.lit(100), 100 - mean)), F.lit(100)).cast("long").alias("posture"))


def extension_histogram(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce(props.blank("extension"), F.lit("no extension")).alias("extension")).agg(F.count(F.lit(1)).alias("files"))


def _grouped(assessed: DataFrame, key: Column, name: str) -> DataFrame:
    return assessed.groupBy(key.alias(name)).agg(
        F.count(F.lit(1)).alias("files"), _count_if(F.col("level") == "CRITICAL").alias("critical"), _count_if(F.col("level") == "HIGH").alias("high"),
        F.sum("score").alias("score"),
    )


def by_department(assessed: DataFrame) -> DataFrame:
    return _grouped(assessed, props.department(), "department")


def by_folder(assessed: DataFrame) -> DataFrame:
    return _grouped(assessed, props.folder(), "folder").withColumn("average", props.half_up(F.col("score") / F.col("files"))).drop("high")


def riskiest_folders(assessed: DataFrame, k: int = 6) -> DataFrame:
    return by_folder(assessed).orderBy(F.col("score").desc(), "folder").limit(k)


def report_heatmap(assessed: DataFrame, k: int = 8) -> DataFrame:
    """The riskiest folders as a report shades them: each by its score's share of the largest, 0.16 at least."""
    largest = F.greatest(F.max("score").over(Window.partitionBy(F.lit(1))), F.lit(1)).cast("double")  # k rows
    return riskiest_folders(assessed, k).select("folder", "files", "score", F.greatest(F.lit(0.16), F.col("score") / largest).alias("opacity"))


def folder_heatmap(assessed: DataFrame, k: int = 12) -> DataFrame:
    """The groups with the most risk, with an intensity between 0.06 and 0.32."""
    top = _grouped(assessed, props.heat_group(), "label").drop("high").orderBy(F.col("score").desc(), "label").limit(k)
    share = F.col("score") / F.greatest(F.col("files") * 95, F.lit(1)).cast("double") * F.lit(0.32)
    return top.withColumn("intensity", F.least(F.lit(0.32), F.greatest(F.lit(0.06), share)))


def finding_totals(classified: DataFrame) -> DataFrame:
    return classified.select(F.explode("findings").alias("f")).groupBy(F.col("f.type").alias("type")).agg(F.sum("f.count").alias("matches"))


def top_findings(classified: DataFrame, k: int = 6) -> DataFrame:
    return finding_totals(classified).orderBy(F.col("matches").desc(), "type").limit(k)


def findings_and_changes(classified: DataFrame, flags: DataFrame) -> DataFrame:
    """type, matches, files: :func:`finding_totals` and how many files each type has, with the pseudo types that integrity
    flags (doc_id, hash_changed, hash_duplicate) make of files: ``Hash changed`` and ``Duplicate hash``, one match a file."""
    own = classified.select("doc_id", F.explode("findings").alias("f")).select("doc_id", F.col("f.type").alias("type"), F.greatest("f.count", F.lit(1)).alias("count"))
    names = F.array(F.when(F.col("hash_changed"), "Hash changed"), F.when(F.col("hash_duplicate"), "Duplicate hash"))
    pseudo = flags.select("doc_id", F.explode(F.array_compact(names)).alias("type"), F.lit(1).alias("count"))
    return own.unionByName(pseudo).groupBy("type").agg(F.sum("count").alias("matches"), F.count_distinct("doc_id").alias("files"))


def signal_sizes(classified: DataFrame, k: int = 6) -> DataFrame:
    """The top findings with a size relative to the largest."""
    largest = F.max("matches").over(Window.partitionBy(F.lit(1)))  # k rows
    return top_findings(classified, k).withColumn("size", 96 + props.half_up(F.col("matches") / largest * 70))


def finding_kpis(classified: DataFrame) -> DataFrame:
    """Files with any finding, with a secret, with regulated data; the groups overlap."""
    kind = lambda pattern: F.exists("findings", lambda f: f["type"].rlike("(?i)" + pattern))
    return classified.agg(
        _count_if(F.size("findings") > 0).alias("sensitive"),
        _count_if(kind("secret|password|token|key|credential|private")).alias("secrets"),
        _count_if(kind("pii|personal|gdpr|hipaa|pci|card|passport|ssn|iban")).alias("regulated"),
    )


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.col("score").desc(), "doc_id").limit(k)


def priority_files(assessed: DataFrame, k: int = 16) -> DataFrame:
    return _ranked(assessed.where(F.col("level").isin("CRITICAL", "HIGH") | props.protected_in_views()), k)


def remediation_queue(assessed: DataFrame, k: int = 18) -> DataFrame:
    return _ranked(assessed.where(F.col("level").isin("CRITICAL", "HIGH", "MEDIUM") | props.protected_in_views()), k)


def remediation_tickets(assessed: DataFrame, k: int = 18) -> DataFrame:
    """The remediation queue with what its rows show: ticket, term and status of the plan, and as owner the file's own, else the plan's."""
    from .risk import remediation

    rows = remediation_queue(assessed, k).withColumn("plan", remediation())
    return rows.select("doc_id", "name", "level", "score", "plan.ticket", "plan.sla", "plan.status", F.coalesce(props.blank(F.trim("owner")), F.col("plan.owner")).alias("owner"))


def findings_queue(assessed: DataFrame, k: int = 10) -> DataFrame:
    return _ranked(assessed.where((F.size("findings") > 0) | F.col("level").isin("CRITICAL", "HIGH")), k)


def bucket_counts(assessed: DataFrame) -> DataFrame:
    """bucket, files of the overlapping risk buckets of the inventory."""
    counts = assessed.agg(F.count(F.lit(1)).alias("all"), _count_if(props.protected_in_views()).alias("protected"), *_levels())
    pairs = F.array(*[F.struct(F.lit(x).alias("bucket"), F.col(x.lower()).alias("files")) for x in ("ALL", "PROTECTED", *LEVELS)])
    return counts.select(F.inline(pairs))


def inventory_metrics(visible: DataFrame) -> DataFrame:
    """One row: visible, sensitive, their percentage, average risk (both half up), most frequent source."""
    by_source = visible.groupBy(props.inventory_source().alias("source")).agg(
        F.count(F.lit(1)).alias("n"), _count_if(F.size("findings") > 0).alias("sensitive"), F.sum("score").alias("score")
    )
    top = F.min_by("source", F.struct(-F.col("n"), F.col("source")))
    total = by_source.agg(F.sum("n").alias("n"), F.sum("sensitive").alias("sensitive"), F.sum("score").alias("score"), top.alias("top"))
    n = F.coalesce("n", F.lit(0))
    return total.select(
        n.alias("visible"), F.coalesce("sensitive", F.lit(0)).alias("sensitive"),
        F.coalesce(props.half_up(F.col("sensitive") / F.greatest(n, F.lit(1)) * 100), F.lit(0)).alias("sensitive_percent"),
        F.coalesce(props.half_up(F.col("score") / n), F.lit(0)).alias("average_risk"), F.coalesce("top", F.lit("none")).alias("top_source"),
    )


def source_facet(assessed: DataFrame) -> DataFrame:
    return assessed.groupBy(props.inventory_source().alias("source")).agg(F.count(F.lit(1)).alias("files"))


def finding_facet(assessed: DataFrame) -> DataFrame:
    return assessed.select(F.explode(filters.facet_values()).alias("finding")).groupBy("finding").agg(F.count(F.lit(1)).alias("files"))


def dashboard(assessed: DataFrame) -> DataFrame:
    """rollup, value, files, critical, high, score, matches: seven rollups of a dashboard from one pass over the records.

    ``department``, ``folder``, ``label`` (of the heat map) and ``level`` are grouping sets over the records; ``bucket`` (overlapping),
    ``finding`` and ``category`` are a further set over what each record unfolds into, for which ``files`` counts records and ``matches`` their
    findings. Levels and buckets without records have no row.
    """
    from .compliance import with_categories

    one = lambda kind, value, n: F.struct(F.lit(kind).alias("kind"), value.alias("facet"), n.cast("long").alias("n"))
    none = F.array().cast("array<struct<kind:string,facet:string,n:bigint>>")
    each = F.concat(
        F.array(one("record", F.lit(""), F.lit(0)), one("bucket", F.lit("ALL"), F.lit(0)), one("bucket", F.col("level"), F.lit(0))),
        F.when(props.protected_in_views(), F.array(one("bucket", F.lit("PROTECTED"), F.lit(0)))).otherwise(none),
        F.transform("findings", lambda f: one("finding", f["type"], f["count"])),
        F.transform("categories", lambda c: one("category", c, F.lit(0))),
    )
    sets = ("department", "folder", "label", "level")
    rows = with_categories(assessed).select(props.department().alias("department"), props.folder().alias("folder"), props.heat_group().alias("label"), "level", "score", F.explode(each).alias("e"))
    rows = rows.select(*sets, "score", F.col("level").alias("own"), "e.kind", "e.facet", "e.n")
    record = F.col("kind") == "record"
    # grouped columns are null in the other sets, so counts use copies of them
    rows = rows.withColumns({"is_record": record, "critical_record": record & (F.col("own") == "CRITICAL"), "high_record": record & (F.col("own") == "HIGH"), "points": F.when(record, F.col("score"))})
    found = rows.groupingSets([*[[F.col(c)] for c in sets], [F.col("kind"), F.col("facet")]], *sets, "kind", "facet").agg(
        F.grouping("facet").alias("whole"), *[F.grouping(c).alias(f"no_{c}") for c in sets], F.count_if("is_record").alias("records"), F.count_if("critical_record").alias("critical"),
        F.count_if("high_record").alias("high"), F.sum("points").alias("score"), F.count(F.lit(1)).alias("times"), F.sum("n").alias("matches"),
    )
    name, value = F.when(F.col("whole") == 0, F.col("kind")), F.when(F.col("whole") == 0, F.col("facet"))
    for c in sets:
        name, value = name.when(F.col(f"no_{c}") == 0, c), value.when(F.col(f"no_{c}") == 0, F.col(c))
    own = F.col("whole") == 1
    files = F.when(own, F.col("records")).otherwise(F.col("times"))
    only = lambda c: F.when(own, F.col(c)).alias(c)
    out = found.where(own | (F.col("kind") != "record")).select(name.alias("rollup"), value.alias("value"), files.alias("files"), only("critical"), only("high"), only("score"), "matches")
    return out.withColumn("matches", F.when(F.col("rollup") == "finding", F.col("matches")))
