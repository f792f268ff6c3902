"""Keyword library: groups of terms per framework, language, category and finding type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("framework", "language", "category", "type")
#: Import modes and the column whose values they replace; the whole library for the last.
MODES = {"merge": None, "replace_type": "type", "replace_category": "category", "replace_language": "language", "replace_framework": "framework"}


def token(c: Column | str) -> Column:
    """Lower-case identifier of letters, digits and underscores, 80 characters at most."""
    raw = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.substring(F.regexp_replace(F.regexp_replace(raw, "[^a-z0-9_]", "_"), "^_+|_+$", ""), 1, 80)


def language(c: Column | str) -> Column:
    raw = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.substring(F.regexp_replace(raw, "[^a-z0-9_-]", ""), 1, 32)


def clean_term(c: Column) -> Column:
    """A term without list marks, quotes and doubled spaces."""
    bare = F.regexp_replace(c, r"^[\s\-*•]+|[\s,;|]+$", "")
    bare = F.regexp_replace(F.trim(bare), "^[\"']+|[\"']+$", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def distinct_terms(terms: Column) -> Column:
    """Clean terms of 1 to 160 characters in their order, each once whatever its case."""
    clean = F.filter(F.transform(terms, clean_term), lambda t: (F.length(t) >= 1) & (F.length(t) <= 160))
    lower = F.transform(clean, F.lower)
    return F.filter(clean, lambda t, i: F.array_position(lower, F.lower(t)) == i + 1)


def split_terms(text: Column) -> Column:
    """Terms of a delimited text."""
    return distinct_terms(F.split(text, r"[\r\n,;\t|]+"))


def terms(groups: DataFrame) -> DataFrame:
    """A row per term of ``groups`` (KEY, terms, ord): with its place, each term once in a group, whatever its case."""
    rows = groups.select(*KEY, "ord", F.posexplode("terms").alias("pos", "term")).where("term <> ''")
    place = F.struct("ord", "pos")
    return rows.groupBy(*KEY, F.lower("term").alias("folded")).agg(F.min_by("term", place).alias("term"), F.min(place).alias("place"))


def merge(groups: DataFrame) -> DataFrame:
    """One group per key, with the terms of all, in the order in which they first come."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "term")))
    merged = terms(groups).groupBy(*KEY).agg(F.transform(ordered, lambda x: x["term"]).alias("terms")).withColumn("count", F.size("terms"))
    if "updated_at" not in groups.columns:
        return merged
    newest = groups.where("updated_at <> ''").groupBy(*KEY).agg(F.max_by("updated_at", "ord").alias("updated_at"))
    return merged.join(newest, list(KEY), "left").fillna("", ["updated_at"])


def new_terms(current: DataFrame, incoming: DataFrame, mode: str = "merge") -> DataFrame:
    """Terms of ``incoming`` that are not there yet under the import mode."""
    if mode not in MODES:
        raise ValueError(f"unknown import mode: {mode}")
    kept = replaced(current, incoming, mode)
    have = terms(kept).select("framework", "language", "type", "folded")
    return terms(incoming).join(have, ["framework", "language", "type", "folded"], "left_anti")


def replaced(current: DataFrame, incoming: DataFrame, mode: str) -> DataFrame:
    """What an import in this mode leaves of ``current``."""
    column = MODES[mode]
    if column is None:
        return current
    return current.join(incoming.select(column).distinct(), column, "left_anti").select(current.columns)


def apply_import(current: DataFrame, incoming: DataFrame, mode: str = "merge") -> DataFrame:
    """The library after an import."""
    return merge(replaced(current, incoming, mode).unionByName(incoming))


def preview(current: DataFrame, incoming: DataFrame, mode: str = "merge") -> DataFrame:
    """One row: how many terms would be new, and how many there are already."""
    given = incoming.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("given"))
    new = new_terms(current, incoming, mode).select("framework", "language", "type", "folded").distinct().agg(F.count(F.lit(1)).alias("new"))
    return given.crossJoin(new).select("new", (F.col("given") - F.col("new")).alias("duplicates"))


def chosen(library: DataFrame, language: str = "", category: str = "", source: str = "all") -> DataFrame:
    """The groups of a language, category and source, where these are given."""
    for column, value in (("language", language), ("category", category), ("source", source if source in ("built-in", "custom") else "")):
        if value:
            library = library.where(F.col(column) == value)
    return library


def listed(library: DataFrame) -> DataFrame:
    """The groups in the order of a listing."""
    return library.orderBy(*KEY)


def types(library: DataFrame) -> DataFrame:
    """type, category of the first group of each type."""
    return library.groupBy("type").agg(F.min_by("category", F.struct(*KEY)).alias("category"))


def built_in(spark, rules) -> DataFrame:
    """The rules' own context words as groups of a library."""
    rows = [("gdpr", "built-in", r.category, r.type, r.label, r.risk, "built-in", list(r.words), k) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, "framework string, language string, category string, type string, label string, risk string, source string, terms array<string>, ord int")


def unknown_types(incoming: DataFrame, rules) -> DataFrame:
    """One row: how many groups of an import are of no known type and do not say what they are."""
    known = [r.type for r in rules]
    told = [F.coalesce(F.trim(F.col(c)), F.lit("")) != "" for c in ("category", "label", "risk") if c in incoming.columns]
    described = told[0] & told[1] & told[2] if len(told) == 3 else F.lit(False)
    return incoming.agg(F.coalesce(F.sum((~F.col("type").isin(*known) & ~described).cast("long")), F.lit(0)).alias("unknown_types"))


def totals(library: DataFrame) -> DataFrame:
    return library.agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms"),
        F.count_distinct("language").alias("languages"), F.count_distinct("category").alias("categories"),
    )


def exported(library: DataFrame) -> DataFrame:
    """A row per term, as the CSV export has them."""
    return library.select(*KEY, F.explode("terms").alias("keyword"))
