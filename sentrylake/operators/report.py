"""What reports show of assessed records, and where results are written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import props
from .risk import reasons, remediation

# Labels of a finding's type and category, all that match; categories of a reason, the first that matches.
DATA_TYPES = (
    (r"full_name|email|phone|address|birth|employee_id|customer|pii", "Personal data"),
    (r"passport|national_id|ssn|fin|government", "Government ID"),
    (r"health|medical|phi|diagnosis|insurance", "Health / PHI"),
    (r"biometric|photo|face|signature|fingerprint", "Biometric data"),
    (r"genetic|race|religious|political|sexual|union|special_category", "Special-category data"),
    (r"payment|card|iban|swift|bank|tax|salary|invoice|financial", "Financial records"),
    (r"hr|employee|benefits|background|timesheet|termination", "HR / employee data"),
    (r"password|secret|token|key|credential|oauth|jwt|connection", "Credentials / secrets"),
    (r"legal|contract|nda|litigation", "Legal documents"),
    (r"source|repo|code|algorithm", "Source code"),
    (r"security|incident|audit|vulnerability|firewall", "Security operations"),
)
REASONS = (
    (r"hr|employee|payroll|salary|full name|personal|email|phone", "Personal / HR data"),
    (r"passport|national|ssn|fin|government", "Government ID"),
    (r"health|medical|patient|phi", "Health / PHI"),
    (r"password|secret|token|key|credential", "Credentials / secrets"),
    (r"permission|broad|writable|everyone|access", "Access exposure"),
    (r"location|path|extension|archive|export", "File context"),
)


def data_types(kind: Column) -> Column:
    text = F.lower(kind)
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), label) for pattern, label in DATA_TYPES]))


def reason_category(reason: Column) -> Column:
    text = F.lower(reason)
    return reduce(lambda c, x: c.when(text.rlike(x[0]), x[1]), REASONS, F.when(F.lit(False), "")).otherwise("Risk context")


def register(assessed: DataFrame) -> DataFrame:
    """A row per record as the risk register has it; lists are joined by `; `."""
    plan = remediation()
    types = F.transform(F.slice("findings", 1, 8), lambda f: f["type"])
    return assessed.select(
        "doc_id", "name", "path", "level", "score", F.coalesce(F.nullif(F.array_join(types, "; "), F.lit("")), F.lit("none")).alias("findings"), F.array_join(reasons(), "; ").alias("reasons"),
        F.coalesce(props.blank("owner"), plan["owner"]).alias("owner"), plan["sla"].alias("sla"), plan["ticket"].alias("ticket"), F.array_join(plan["actions"], "; ").alias("actions"),
    )


def reason_counts(assessed: DataFrame) -> DataFrame:
    """category, files: how many records have a reason of each category."""
    each = assessed.select("doc_id", F.explode(reasons()).alias("reason")).select("doc_id", reason_category(F.col("reason")).alias("category")).distinct()
    return each.groupBy("category").agg(F.count(F.lit(1)).alias("files"))


def keep_share(share: Column | str, admin: bool = False) -> Column:
    """Whether a network share is scanned: no system shares, drive shares only on request."""
    s = F.col(share) if isinstance(share, str) else share
    drive = s.rlike(r"^[A-Za-z]\$$") if admin else F.lit(False)
    return ~s.isin("print$", "IPC$", "ADMIN$") & (~s.endswith("$") | drive)


def of_profile(path: Column | str, profile: str) -> Column:
    """Whether a path lies in the profile of a user, under its usual variants of name."""
    p = F.lower(F.translate(F.col(path) if isinstance(path, str) else path, "/", "\\"))
    name, wanted = F.regexp_extract(p, r"\\users\\([^\\]*)", 1), profile.strip().lower()
    if not wanted:
        return F.lit(True)
    return (name == wanted) | name.startswith(f"{wanted}.") | name.startswith(f"{wanted}_") | name.endswith(f".{wanted}")


def write_register(assessed: DataFrame, folder: str, kind: str = "json") -> None:
    """The register as JSON or CSV files."""
    rows = register(assessed)
    rows.write.mode("overwrite").option("header", True).format(kind).save(folder)


def append_log(rows: DataFrame, folder: str) -> None:
    """Append rows to a log, a folder per tenant."""
    rows.write.mode("append").partitionBy("tenant_id").parquet(folder)
