"""Keyword libraries as files: CSV with a header, JSON, and lists of terms; read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keywords as k

GROUP = "framework string, language string, category string, type string, label string, risk string, source string, terms array<string>, updated_at string"
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def read_json(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of JSON files (an array or one object each); a file that is missing or broken has none."""
    if not spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(folder)):
        return spark.createDataFrame([], GROUP)
    return normalised(spark.read.schema(GROUP).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder))


def read_csv(spark: SparkSession, path: str, framework: str = "gdpr", language: str = "custom") -> DataFrame:
    """Groups from rows of a CSV file: type or finding_type, keyword or term; language, category and risk where given."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    rows = rows.toDF(*[c.replace("\ufeff", "").strip().lower() for c in rows.columns])
    have = set(rows.columns)
    either = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in have], F.lit(None).cast("string"))
    term = F.trim(F.regexp_replace(F.coalesce(either("keyword", "term"), F.lit("")), r"\s+", " "))
    lined = rows.select(
        k.token(F.coalesce(either("type", "finding_type"), F.lit(""))).alias("type"), term.alias("term"), F.lit(framework).alias("framework"),
        F.coalesce(F.nullif(k.language(F.coalesce(either("language"), F.lit(language))), F.lit("")), F.lit("custom")).alias("language"),
        k.token(F.coalesce(either("category"), F.lit("custom"))).alias("category"), level(F.coalesce(either("risk"), F.lit("MEDIUM"))).alias("risk"),
        F.monotonically_increasing_id().alias("ord"),
    ).where("type <> '' and term <> ''")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "term"))), lambda x: x["term"])
    return lined.groupBy("framework", "language", "category", "type").agg(listed.alias("terms"), F.min_by("risk", "ord").alias("risk"), F.min("ord").alias("ord"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """term: the terms of a text file, separated by line ends, commas, tabs, semicolons or bars; lines with a # in front are left out."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#"))
    return lines.select(F.explode(k.split_terms(F.col("value"))).alias("term"))


def level(risk) -> F.Column:
    raw = F.upper(F.trim(risk))
    return F.when(raw.isin(*LEVELS), raw).otherwise("MEDIUM")


def normalised(groups: DataFrame) -> DataFrame:
    """Groups with clean keys and terms; missing keys get their defaults, groups without a type or terms go."""
    clean = groups.select(
        F.coalesce(F.nullif(k.token("framework"), F.lit("")), F.lit("gdpr")).alias("framework"), F.coalesce(F.nullif(k.language("language"), F.lit("")), F.lit("custom")).alias("language"),
        F.coalesce(F.nullif(k.token("category"), F.lit("")), F.lit("custom")).alias("category"), k.token("type").alias("type"), F.trim(F.coalesce("label", F.lit(""))).alias("label"),
        level(F.coalesce("risk", F.lit("MEDIUM"))).alias("risk"), F.coalesce("source", F.lit("custom")).alias("source"), k.distinct_terms(F.coalesce("terms", F.array().cast("array<string>"))).alias("terms"),
        F.coalesce("updated_at", F.lit("")).alias("updated_at"), F.monotonically_increasing_id().alias("ord"),
    )
    return clean.where((F.col("type") != "") & (F.size("terms") > 0))


def write(library: DataFrame, folder: str, kind: str = "json") -> None:
    """The library as JSON (a group a line), CSV (a term a row, with a header) or text (a heading and its terms)."""
    if kind == "csv":
        label, source = (F.col(c) if c in library.columns else F.lit("") for c in ("label", "source"))
        rows = library.select("framework", "language", "category", "type", label.alias("label"), source.alias("source"), F.explode("terms").alias("keyword"))
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)
    elif kind == "txt":
        heading = F.concat(F.lit("# "), F.concat_ws(" / ", "framework", "language", "type", "category"))
        library.select(F.concat_ws("\n", heading, F.array_join("terms", "\n"), F.lit("")).alias("value")).write.mode("overwrite").text(folder)
    elif kind == "json":
        library.write.mode("overwrite").json(folder)
    else:
        raise ValueError(f"unknown kind of export: {kind}")


def store(library: DataFrame, folder: str) -> None:
    """Replace the groups of the tenants in ``library`` (tenant_id and a group's columns), those of others stay."""
    library.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id").json(folder)
