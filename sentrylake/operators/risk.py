"""Access assessment, risk score, overrides and remediation of a file record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, props

LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
FORCED_SCORE = {"CRITICAL": 95, "HIGH": 80, "MEDIUM": 55, "LOW": 20}
FLOOR = {"CRITICAL": 90, "HIGH": 70}
REGULATED = ("credit_card", "iban", "swift_bic", "passport_number", "national_id")


def _chosen(key: Column, values: dict, otherwise) -> Column:
    out = reduce(lambda c, kv: c.when(key == kv[0], F.lit(kv[1])), values.items(), F.when(F.lit(False), F.lit(otherwise)))
    return out.otherwise(F.lit(otherwise))


def access() -> Column:
    """score, wide, writable, privileged, issues of the columns principals, permissions, has_acl."""
    none = F.array().cast("array<string>")
    who = F.transform(F.coalesce("principals", none), F.lower)
    rights = F.transform(F.coalesce("permissions", none), lambda p: F.replace(F.lower(p), F.lit("_"), F.lit(" ")))
    known = F.coalesce("has_acl", F.lit(False))
    wide = known & F.exists(who, lambda p: props.contains_any(p, fixed.BROAD_PRINCIPALS))
    privileged = known & F.exists(who, lambda p: props.contains_any(p, fixed.PRIVILEGED_PRINCIPALS))
    writable = known & F.exists(rights, lambda p: props.contains_any(p, fixed.WRITE_RIGHTS))
    score = F.least(F.lit(40), wide.cast("int") * 20 + writable.cast("int") * 15 + (privileged & ~wide).cast("int") * 5)
    issues = F.array_compact(
        F.array(
            F.when(wide, "broad access"), F.when(wide & writable, "broad write access"), F.when(~known, "no access list")
        )
    )
    return F.struct(score.alias("score"), wide.alias("wide"), writable.alias("writable"), privileged.alias("privileged"), issues.alias("issues"))


def folded(findings: Column | str) -> Column:
    """Points of findings in their order: each adds its weight, a severe one then lifts the sum to its floor."""

    def step(total: Column, f: Column) -> Column:
        level = F.upper(F.coalesce(f["risk"], F.lit("LOW")))
        added = total + _chosen(level, fixed.FINDING_WEIGHTS, fixed.FINDING_WEIGHTS["LOW"])
        return F.greatest(added, _chosen(level, FLOOR, 0))

    return F.aggregate(findings, F.lit(0), step)


def level_of(score: Column) -> Column:
    return F.when(score >= 90, "CRITICAL").when(score >= 70, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")


def extension_points(ext: Column) -> Column:
    return _chosen(ext, fixed.EXTENSION_RISK, 0)


def first_override(overrides: list[tuple[str, str, str]]) -> Column:
    """level, reason of the first (pattern, level, reason) found in path, name or finding types; null if none."""
    signals = F.lower(F.array_join(F.transform("findings", lambda f: f["type"]), " "))
    blobs = (F.lower(F.coalesce("path", F.lit(""))), F.lower(F.coalesce("name", F.lit(""))), signals)
    out = F.when(F.lit(False), F.struct(F.lit("").alias("level"), F.lit("").alias("reason")))
    for pattern, level, reason in overrides:
        pattern, level = pattern.strip().lower(), level.strip().upper()
        if pattern and level in FORCED_SCORE:
            hit = blobs[0].contains(pattern) | blobs[1].contains(pattern) | blobs[2].contains(pattern)
            out = out.when(hit, F.struct(F.lit(level).alias("level"), F.lit(reason or f"{pattern} is marked as {level}").alias("reason")))
    return out


def assess(classified: DataFrame, overrides: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Add access, score and level to classified records, in the fixed order of the rules."""
    rows = props.once(classified, access=access())
    path = F.lower(F.coalesce("path", F.lit("")))
    points = folded("findings")
    points = points + F.when(props.contains_any(path, fixed.PATH_KEYWORDS), 15).otherwise(0)
    points = points + extension_points(F.col("extension"))
    points = points + F.when((F.col("size") > 0) & (F.col("size") < 256) & (F.size("findings") > 0), 10).otherwise(0)
    points = points + F.col("access.score")
    points = F.greatest(points, F.when(props.protected_for_risk(), 70).otherwise(0))
    points = points + F.when(F.col("source") == "smb", 5).otherwise(0)
    rows = props.once(rows, score=F.least(points, F.lit(100)).cast("int"))
    if not overrides:
        return rows.withColumn("level", level_of(F.col("score")))
    rows = rows.withColumn("override", first_override(list(overrides)))
    forced = F.col("override.level")
    return rows.withColumns(
        {
            "level": F.coalesce(forced, level_of(F.col("score"))),
            "score": F.when(forced.isNotNull(), _chosen(forced, FORCED_SCORE, 20)).otherwise(F.col("score")).cast("int"),
        }
    )


def effective(assessed: DataFrame, manual: DataFrame) -> DataFrame:
    """Replace level and score by manual overrides (file_key, forced_level), one a key."""
    joined = assessed.withColumn("file_key", props.file_key()).join(manual, "file_key", "left")
    forced = F.col("forced_level")
    return joined.withColumns(
        {
            "score": F.when(forced.isNotNull(), _chosen(forced, FORCED_SCORE, 0)).otherwise(F.col("score")).cast("int"),
            "level": F.coalesce(forced, F.col("level")),
        }
    ).drop("file_key", "forced_level")


PLAN = {
    "CRITICAL": ("Open - urgent", "Security owner", "24 hours"),
    "HIGH": ("Open", "Data owner", "3 business days"),
    "MEDIUM": ("Needs review", "Business owner", "14 days"),
    "LOW": ("Monitor", "IT operations", "30 days"),
}
# Categories of findings that count as regulated, or call for a review of their own.
REGULATED_CATEGORIES = (
    "pii", "personal_data", "government_ids", "phi", "health", "medical", "financial", "financial_records", "pci_payment", "special_category", "biometric_data", "genetic_data",
)
REVIEWED_CATEGORIES = ("legal", "contracts", "hr", "hr_documents", "confidential_business", "custom")
#: Actions by what calls for them.
ACTIONS = {
    "secret": ("quarantine", "rotate secret", "review access logs"),
    "regulated": ("label regulated", "restrict sharing", "block identifiers"),
    "category": ("label category", "route owner review", "validate retention"),
    "access": ("remove broad groups", "confirm least privilege"),
    "protected": ("confirm owner", "obtain readable copy", "document exception"),
}


def ticket(seed: Column, prefix: str = "TICKET") -> Column:
    number = F.conv(F.substring(F.sha1(seed.cast("binary")), 1, 8), 16, 10).cast("long") % 100000
    return F.format_string(prefix + "-%05d", number)


def remediation() -> Column:
    """status, owner, sla, ticket, actions of an assessed record."""
    types = F.transform("findings", lambda f: F.lower(f["type"]))
    names = F.filter(F.transform("findings", lambda f: F.regexp_replace(F.lower(f["category"]), "[- ]", "_")), lambda c: c.isNotNull())
    secret = F.exists(types, lambda t: props.contains_any(t, ("key", "token", "secret", "password"))) | F.exists(names, lambda c: props.contains_any(c, ("secret", "credential")))
    among = lambda values, kinds: F.coalesce(F.arrays_overlap(values, F.array(*map(F.lit, kinds))), F.lit(False))
    regulated = among(types, REGULATED) | among(names, REGULATED_CATEGORIES)
    none = F.array().cast("array<string>")
    acts = lambda on, names: F.when(on, F.array(*map(F.lit, names))).otherwise(none)
    actions = F.array_distinct(
        F.concat(
            acts(secret, ACTIONS["secret"]),
            acts(regulated, ACTIONS["regulated"]),
            acts(among(names, REVIEWED_CATEGORIES), ACTIONS["category"]),
            acts(F.size("access.issues") > 0, ACTIONS["access"]),
            acts(props.protected_for_remediation(), ACTIONS["protected"]),
        )
    )
    fallback = F.when(F.col("level").isin("HIGH", "CRITICAL"), F.array(F.lit("request attestation"))).otherwise(F.array(F.lit("monitor")))
    by_level = lambda k: _chosen(F.col("level"), {n: v[k] for n, v in PLAN.items()}, PLAN["LOW"][k])
    seed = F.coalesce(props.blank("path"), props.blank("name"), F.col("score").cast("string"))
    return F.struct(
        by_level(0).alias("status"), by_level(1).alias("owner"), by_level(2).alias("sla"), ticket(seed).alias("ticket"),
        F.when(F.size(actions) > 0, actions).otherwise(fallback).alias("actions"),
    )


def reasons(overridden: bool = False) -> Column:
    """Why a record has its score: a line per rule that gave points, in the order of the rules; before them the
    reason of an override (column override)."""
    path = F.lower(F.coalesce("path", F.lit("")))
    told = F.transform("findings", lambda f: F.concat(F.replace(f["type"], F.lit("_"), F.lit(" ")), F.lit(" ("), f["count"].cast("string"), F.lit(")")))
    more = F.array(
        F.when(props.contains_any(path, fixed.PATH_KEYWORDS), "sensitive word in the path"),
        F.when(extension_points(F.col("extension")) > 0, F.concat(F.lit("extension "), "extension")),
        F.when((F.col("size") > 0) & (F.col("size") < 256) & (F.size("findings") > 0), "small file with findings"),
    )
    issues = F.when(F.col("access.score") > 0, F.col("access.issues")).otherwise(F.array().cast("array<string>"))
    last = F.array(F.when(props.protected_for_risk(), "protected or unreadable"), F.when(F.col("source") == "smb", "on a network share"))
    first = F.array(F.col("override.reason")) if overridden else F.array().cast("array<string>")
    every = F.array_distinct(F.array_compact(F.concat(first, told, more, issues, last)))
    return F.when(F.size(every) > 0, every).otherwise(F.array(F.lit("no signal")))


#: What to do about a finding, by words of its type, the first that match; then by its category.
ADVICE = (
    ("private_key|saml", ("take the key out of use and replace it", "keep keys in a vault")),
    ("aws|azure|gcp|google|kubeconfig|terraform|docker", ("rotate the cloud credential and read its audit log", "keep cloud credentials in the platform's secret store")),
    ("jwt|bearer|oauth|okta|auth0|mfa", ("revoke the token and look for its use elsewhere", "keep identity secrets with identity administrators")),
    ("token|secret|password|api_key|_key|dsn|auth_url", ("rotate the secret if it is in use and take it out of the file", "block secrets of this form in shared files")),
    ("connection|database|jdbc", ("change the database password and read the access log", "move connection strings to a protected configuration")),
    ("credit_card|payment|iban|swift|routing|bank", ("label as payment data and restrict to finance", "check that it may be stored here and how long")),
    ("passport|national_id|ssn|fin|government", ("label as identity data and restrict access", "check the legal basis and retention")),
    ("phi|health|medical|special_category|biometric|genetic", ("label as special data and stop sharing", "have the privacy owner check place and retention")),
    ("payroll|salary|employee|hr_", ("restrict to personnel and payroll", "watch exports of personnel data")),
    ("legal|contract|board|strategy", ("restrict to the owners of the matter", "alert when it leaves")),
    ("security_ops|incident|audit|vulnerability", ("restrict to security operations", "keep evidence in approved places")),
    ("repo|source_code|build_log", ("look for secrets in the code", "restrict to engineering")),
    ("email|phone|name|address|customer", ("treat as personal data", "watch transfers in bulk")),
)
GENERAL = ("tune a detection rule for this kind and ask the owner",)


def recommendations() -> Column:
    """What to do about an assessed record, in the order of its findings, then of the rules; each once."""

    def of(f: Column) -> Column:
        text = F.concat_ws(" ", F.lower(f["type"]), F.lower(f["category"]))
        known = reduce(lambda c, kv: c.when(text.rlike(kv[0]), F.array(*map(F.lit, kv[1]))), ADVICE, F.when(F.lit(False), F.array().cast("array<string>")))
        severe = F.when(F.upper(f["risk"]).isin("CRITICAL", "HIGH"), "block movement until the owner confirms").otherwise("watch where it moves")
        own = F.when(f["category"].isNotNull(), F.array(severe)).otherwise(F.array().cast("array<string>"))
        return F.concat(F.coalesce(known, F.concat(F.array(*map(F.lit, GENERAL)), F.array(severe))), own)

    path = F.lower(F.coalesce("path", F.lit("")))
    more = F.array(
        F.when(props.contains_any(path, fixed.PATH_KEYWORDS), "add the path to the data-loss policy"), F.when(F.col("access.score") > 0, "review groups and share permissions"),
        F.when(props.protected_for_risk(), "ask the owner for a readable copy"), F.when(F.col("source") == "smb", "review the share"),
    )
    every = F.array_distinct(F.array_compact(F.concat(F.flatten(F.transform("findings", of)), more)))
    return F.when(F.size(every) > 0, every).otherwise(F.array(F.lit("keep watching and confirm the owner")))


def rule_catalogue(spark) -> DataFrame:
    """rule, points, what: the rules of the score in the order in which they apply."""
    levels = [(f"finding {k.lower()}", v, "each finding of this level" + (f", then at least {FLOOR[k]}" if k in FLOOR else "")) for k, v in fixed.FINDING_WEIGHTS.items()]
    rest = [
        ("path word", 15, "a sensitive word in the path"), ("extension", max(fixed.EXTENSION_RISK.values()), "by the extension, at most"), ("small file", 10, "under 256 bytes, with findings"),
        ("broad access", 20, "everyone or a group as wide"), ("write access", 15, "rights to change it"), ("privileged access", 5, "administrators, if nobody else"), ("access, together", 40, "at most"),
        ("protected", 70, "at least, if it can not be read"), ("network share", 5, "on a share"), ("cap", 100, "at most"), *((f"override {k.lower()}", v, "stands for the score") for k, v in FORCED_SCORE.items()),
        *((f"level {k.lower()}", v, "from this score on") for k, v in (("CRITICAL", 90), ("HIGH", 70), ("MEDIUM", 40), ("LOW", 0))),
    ]
    return spark.createDataFrame([(k + 1, *r) for k, r in enumerate([*levels, *rest])], "ord int, rule string, points int, what string")
