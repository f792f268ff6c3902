"""Mapping of assessed records to compliance frameworks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, props

#: Frameworks that exposure alone brings in.
BY_EXPOSURE = ("nist_csf", "iso27001")
EVIDENCE = {"CRITICAL": 20, "HIGH": 15, "MEDIUM": 9, "LOW": 4}
BUSY_PLACES = ("downloads", "desktop", "temp", "export", "backup", "share")
EXPORT_EXTENSIONS = (".csv", ".xlsx", ".xls", ".zip", ".pst", ".ost", ".sql", ".db", ".bak", ".json")


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _type_map() -> Column:
    return F.create_map(*[x for k, v in fixed.CATEGORY_OF_TYPE.items() for x in (F.lit(k), _strings(v))])


# Categories that a finding's own category stands for, where it is none itself; labels of categories.
CATEGORY_OF_NAME = {
    "personal_data": ("pii",), "identifier": ("pii",), "identity": ("pii", "government_ids"), "special_category": ("special_category_context",), "health": ("phi",), "medical": ("phi",),
    "financial": ("financial_records",), "employment": ("hr_documents", "pii"), "hr": ("hr_documents", "pii"), "security": ("security_operations",), "secret": ("credentials_secrets",),
}
LABELS = {
    "pii": "Personal data", "government_ids": "Government ID", "phi": "Health / PHI", "biometric_data": "Biometric data", "genetic_data": "Genetic data",
    "special_category_context": "Special-category data", "financial_records": "Financial records", "customer_data": "Customer data", "hr_documents": "HR / employee data",
    "online_identifiers": "Online identifier", "device_identifiers": "Device identifier", "location_data": "Location data", "behavioral_data": "Behavioral data",
    "credentials_secrets": "Credentials / secrets", "identity_access": "Identity access", "security_operations": "Security operations",
    "confidential_business": "Confidential business data", "source_code": "Source code", "legal_documents": "Legal documents", "contracts": "Contracts",
    "audit_accounting": "Audit evidence", "pci_payment": "Payment card data",
}


def framework_ids(wanted: list[str] | None) -> list[str] | None:
    """Ids of frameworks, each once: lower case, underscores; an unknown one is refused."""
    if wanted is None:
        return None
    known = {f[0] for f in fixed.FRAMEWORKS}
    out = [x.strip().lower().replace("-", "_") for x in wanted if x and x.strip()]
    strange = [x for x in out if x not in known]
    if strange:
        raise ValueError(f"unknown compliance framework: {', '.join(strange)}")
    return list(dict.fromkeys(out))


def label(category: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, category), F.initcap(F.replace(category, F.lit("_"), F.lit(" "))))


def categories_of_name(category: Column) -> Column:
    """Categories that a finding's own category names."""
    name = F.regexp_replace(F.lower(F.trim(F.coalesce(category, F.lit("")))), "[- ]", "_")
    known = F.create_map(*[x for k, v in CATEGORY_OF_NAME.items() for x in (F.lit(k), _strings(v))])
    return F.when(name.isin(*fixed.CATEGORY_WEIGHTS), F.array(name)).otherwise(F.coalesce(F.try_element_at(known, name), _strings(())))


def categories_of_types(findings: Column | str, types: Column, labels: bool = True) -> Column:
    """Categories of each finding: by its type, by its label, and by its own category."""

    def of(f: Column) -> Column:
        found = [F.coalesce(F.try_element_at(types, F.lower(f["type"])), _strings(()))]
        if labels:
            found.append(F.coalesce(F.try_element_at(types, F.lower(f["label"])), _strings(())))
        return F.array_distinct(F.concat(*found, categories_of_name(f["category"])))

    return F.transform(findings, of)


def categories() -> Column:
    """Sorted data categories of a record, from its findings' types and from words in its names."""
    blob = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("path", F.lit("")), F.coalesce("share", F.lit("")), F.coalesce("extension", F.lit(""))))
    by_path = [F.when(blob.contains(word), _strings(found)).otherwise(_strings(())) for word, found in fixed.CATEGORY_OF_PATH]
    return F.array_sort(F.array_distinct(F.concat(F.flatten(F.col("type_categories")), *by_path)))


def with_categories(assessed: DataFrame) -> DataFrame:
    typed = props.once(assessed, type_categories=categories_of_types("findings", _type_map()), evidence_categories=categories_of_types("findings", _type_map(), labels=False))
    return props.once(typed, categories=categories())


def _percent(points: Column) -> Column:
    """35 % of a whole number, rounded half to even."""
    return F.rint(points.cast("double") * F.lit(0.35)).cast("int")


def score_parts(matched: Column) -> list[tuple[str, Column]]:
    """The six parts of a record's score under a framework with these matched categories."""
    weights = F.create_map(*[x for k, v in fixed.CATEGORY_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    strongest = F.aggregate(matched, F.lit(0), lambda a, c: F.greatest(a, F.coalesce(F.try_element_at(weights, c), F.lit(0))))
    data = F.when(F.size(matched) == 0, 8).otherwise(F.least(strongest + F.least(F.greatest(F.size(matched) - 1, F.lit(0)) * 3, F.lit(9)), F.lit(30)))
    level_points = F.create_map(*[x for k, v in EVIDENCE.items() for x in (F.lit(k), F.lit(v))])

    def evidence_step(total: Column, pair: Column) -> Column:
        f, cats = pair["f"], pair["c"]
        relevant = (F.size(matched) == 0) | F.arrays_overlap(cats, matched)
        points = F.coalesce(F.try_element_at(level_points, F.upper(f["risk"])), F.lit(4)) + F.least(F.greatest(f["count"], F.lit(1)) - 1, F.lit(4))
        return total + F.when(F.coalesce(relevant, F.lit(False)), points).otherwise(0)

    pairs = F.zip_with("findings", "evidence_categories", lambda f, c: F.struct(f.alias("f"), c.alias("c")))
    evidence = F.least(F.aggregate(pairs, F.lit(0), evidence_step), F.lit(25))
    acl = F.col("access")
    exposure = F.least(
        F.least(_percent(acl["score"]), F.lit(12)) + F.when(acl["wide"], 8).otherwise(0) + F.when(acl["writable"], 5).otherwise(0), F.lit(20)
    )
    path = F.lower(F.coalesce(props.blank("path"), props.blank("name"), F.lit("")))
    location = F.least(
        F.when(props.contains_any(path, BUSY_PLACES), 5).otherwise(0)
        + F.when(F.col("extension").isin(*EXPORT_EXTENSIONS), 5).otherwise(0)
        + F.when(F.col("is_hidden") | F.col("is_system"), 2).otherwise(0),
        F.lit(10),
    )
    sealed = F.col("protected") | F.lower("content_status").contains("encrypted")
    protection = F.when(F.size("categories") == 0, 0).when(sealed, -5).otherwise(5)
    return [("base", _percent(F.least("score", F.lit(90)))), ("data", data), ("evidence", evidence), ("exposure", exposure), ("location", location), ("protection", protection)]


def control(framework: Column, matched: Column) -> Column:
    """The control a match falls under: exposure, health, cards, access, else the framework's first."""
    out = F.when(F.lit(False), F.lit(""))
    exposed = F.col("access.wide") | F.col("access.writable")
    has = lambda c: F.array_contains(matched, c)
    for name, _, _, controls in fixed.FRAMEWORKS:
        mine = framework == name
        for key, when in (
            ("exposure", exposed), ("phi", has("phi")), ("cardholder_data", has("pci_payment")), ("access", has("credentials_secrets") | has("identity_access")),
        ):
            if controls.get(key):
                out = out.when(mine & when, controls[key])
        out = out.when(mine & (F.size(matched) > 0), next(iter(controls.values())))
    return out.otherwise("Compliance Exposure Risk")


def severity(score: Column) -> Column:
    return F.when(score >= 85, "CRITICAL").when(score >= 70, "HIGH").when(score >= 40, "MEDIUM").when(score > 0, "LOW").otherwise("NONE")


def evaluate(assessed: DataFrame, frameworks: list[str] | None = None) -> DataFrame:
    """A row per record and framework that it falls under: matched categories, parts, score, control."""
    frameworks = framework_ids(frameworks)
    chosen = [(k, f) for k, f in enumerate(fixed.FRAMEWORKS) if frameworks is None or f[0] in frameworks]
    listed = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(f[0]).alias("framework"), _strings(f[2]).alias("scope")) for k, f in chosen])
    # a handful of frameworks: each record unfolds into them without a join
    rows = with_categories(assessed).withColumn("f", F.explode(listed))
    rows = props.once(rows, matched=F.array_sort(F.array_intersect("categories", "f.scope")))
    exposed = F.col("access.wide") | F.col("access.writable")
    by_exposure = F.col("f.framework").isin(*BY_EXPOSURE) & exposed & (F.size("categories") > 0)
    rows = props.once(rows.where((F.size("matched") > 0) | by_exposure), **dict(score_parts(F.col("matched"))))
    total = reduce(lambda a, b: a + b, (F.col(c) for c in ("base", "data", "evidence", "exposure", "location", "protection")))
    return rows.withColumns(
        {"compliance_score": F.greatest(F.lit(1), F.least(F.lit(100), total)), "framework": F.col("f.framework"), "control": control(F.col("f.framework"), F.col("matched"))}
    ).drop("f")


def per_file(evaluated: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """doc_id, score, severity, frameworks, criticality: a row per record under any framework; with ``every`` (the
    assessed records) one for each of these, score 0 and severity NONE where it falls under none."""
    if every is not None:
        matched = per_file(evaluated)
        found = with_categories(every).select("doc_id", F.col("access.wide").alias("wide"), "categories").join(matched, "doc_id", "left")
        return found.select(
            "doc_id", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("severity", F.lit("NONE")).alias("severity"), F.coalesce("n_frameworks", F.lit(0).cast("long")).alias("n_frameworks"),
            F.coalesce("frameworks", F.lit("")).alias("frameworks"), F.coalesce("criticality", criticality()).alias("criticality"),
        )
    rows = evaluated.groupBy("doc_id").agg(
        F.max("compliance_score").alias("score"), F.count(F.lit(1)).alias("n_frameworks"), F.array_join(F.array_sort(F.collect_list("framework")), ",").alias("frameworks"),
        F.first("categories").alias("categories"), F.first("access.wide").alias("wide"),
    )
    return rows.select("doc_id", "score", severity(F.col("score")).alias("severity"), "n_frameworks", "frameworks", criticality().alias("criticality"))


def criticality() -> Column:
    """What the columns wide and categories make a record: none, relevant, high impact, broad access."""
    high = F.arrays_overlap("categories", _strings(("pci_payment", "phi", "credentials_secrets", "government_ids")))
    any_of = F.size("categories") > 0
    return F.when(F.col("wide") & any_of, "broad access").when(F.coalesce(high, F.lit(False)), "high impact").when(any_of, "relevant").otherwise("none")


def evidence(assessed: DataFrame) -> DataFrame:
    """doc_id, place, type, label, risk, count, data_types, samples: a row per finding, as compliance shows it."""
    rows = with_categories(assessed).select("doc_id", F.posexplode(F.arrays_zip("findings", "evidence_categories")).alias("place", "e"))
    f = F.col("e.findings")
    shown = F.coalesce(F.nullif(f["label"], F.lit("")), F.initcap(F.replace(f["type"], F.lit("_"), F.lit(" "))))
    return rows.select("doc_id", "place", f["type"].alias("type"), shown.alias("label"), f["risk"].alias("risk"), F.greatest(f["count"], F.lit(1)).alias("count"), F.transform("e.evidence_categories", label).alias("data_types"), f["samples"].alias("samples"))


def summary(assessed: DataFrame, frameworks: list[str] | None, enabled: bool = True, k: int = 8, files: int = 10) -> DataFrame:
    """One row: findings by severity, and the first categories, controls and files; nothing if it is not enabled or no framework is chosen."""
    ids = framework_ids(frameworks or [])
    spark = assessed.sparkSession
    if not enabled or not ids:
        return spark.createDataFrame([(False, [], 0, 0, 0, 0, 0, [], [], [])], SUMMARY)
    found = evaluate(assessed, ids)
    by_file = per_file(found)
    counts = by_file.agg(F.count(F.lit(1)).alias("total"), *[F.coalesce(F.sum((F.col("severity") == s).cast("long")), F.lit(0)).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")])

    def first(rows: DataFrame, name: str, order: list[Column]) -> DataFrame:
        """One row with a short list in its order."""
        return rows.agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*rows.columns).alias("row")))).alias(name)).select(F.transform(name, lambda x: x["row"]).alias(name))

    top = by_file.orderBy(F.col("score").desc(), "doc_id").limit(files).select("doc_id", "score", "severity", "frameworks")
    lists = [
        first(top_categories(found, k).select("category", "files"), "top_violated_categories", [-F.col("files"), F.col("category")]),
        first(top_controls(found, k).select("control", "files"), "remediation_priorities", [-F.col("files"), F.col("control")]),
        first(top, "top_risky_files", [-F.col("score"), F.col("doc_id")]),
    ]
    out = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), lists, counts)  # rows of one
    return out.select(
        F.lit(True).alias("enabled"), _strings(ids).alias("selected_frameworks"), F.col("total").alias("total_compliance_findings"), "critical", "high", "medium", "low",
        "top_violated_categories", "top_risky_files", "remediation_priorities",
    )


SUMMARY = (
    "enabled boolean, selected_frameworks array<string>, total_compliance_findings long, critical long, high long, medium long, low long, "
    "top_violated_categories array<struct<category:string,files:long>>, top_risky_files array<struct<doc_id:long,score:int,severity:string,frameworks:string>>, "
    "remediation_priorities array<struct<control:string,files:long>>"
)


def top_categories(evaluated: DataFrame, k: int = 8) -> DataFrame:
    files = evaluated.select("doc_id", "categories").dropDuplicates(["doc_id"])
    return files.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("files")).orderBy(F.col("files").desc(), "category").limit(k)


def top_controls(evaluated: DataFrame, k: int = 8) -> DataFrame:
    files = evaluated.select("doc_id", "control").distinct()
    return files.groupBy("control").agg(F.count(F.lit(1)).alias("files")).orderBy(F.col("files").desc(), "control").limit(k)
