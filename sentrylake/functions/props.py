"""Properties of a file record as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed

#: Statuses that mean protected by themselves.
PROTECTED_STATES = ("protected", "password_protected", "encrypted", "locked", "bad_archive", "protected_or_uninspectable_archive")
#: Extensions that count as protected in the interactive views.
PROTECTED_IN_VIEWS = fixed.PROTECTED_EXTENSIONS


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with costly columns that are worked out once a row.

    A plain projection is merged into whatever reads it, filters that move down among
    them, and its expressions are then evaluated again at each use; a generator is not.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """Null where the string is empty."""
    return F.nullif(_col(c), F.lit(""))


def parts(path: Column | str) -> Column:
    """The parts of a path, by either slash, without empty ones."""
    return F.filter(F.split(_col(path), r"[/\\]"), lambda p: p != "")


def base_name(path: Column | str) -> Column:
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1)), F.lit(""))


def extension(path: Column | str) -> Column:
    """Lower-case last suffix; the whole name of a dot file; `.dockerfile` for that name."""
    name = F.lower(base_name(path))
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.when(suffix != "", suffix).when(name.startswith("."), name).when(name == "dockerfile", ".dockerfile").otherwise("")


def has_content(ext: Column | str) -> Column:
    return _col(ext).isin(*fixed.TEXT_EXTENSIONS, *fixed.DOCUMENT_EXTENSIONS)


def scan_mode(ext: Column | str) -> Column:
    e = _col(ext)
    return (
        F.when(e.isin(*fixed.TEXT_EXTENSIONS), "plain_text")
        .when(e.isin(*fixed.DOCUMENT_EXTENSIONS), "document_text")
        .when(e.isin(*fixed.PROTECTED_EXTENSIONS), "protected_metadata")
        .when(e.isin(*fixed.ARCHIVE_EXTENSIONS), "archive_metadata")
        .when(e.isin(*fixed.METADATA_EXTENSIONS), "metadata_only")
        .otherwise("unknown")
    )


def content_status(ext: Column | str, content: Column | str) -> Column:
    e = _col(ext)
    return (
        F.when(e.isin(*fixed.PROTECTED_EXTENSIONS), "protected")
        .when(e.isin(*(x for x in fixed.ARCHIVE_EXTENSIONS if x != ".zip")), "protected_or_uninspectable_archive")
        .when(has_content(e), F.when(_col(content) != "", "scanned").otherwise("empty_or_unreadable"))
        .otherwise("metadata_only")
    )


def hidden_path(path: Column | str) -> Column:
    return F.exists(parts(path), lambda p: p.startswith("."))


def system_path(path: Column | str) -> Column:
    return F.arrays_overlap(F.transform(parts(path), F.lower), F.array(*map(F.lit, fixed.SYSTEM_PARTS)))


def contains_any(text: Column, needles) -> Column:
    return reduce(or_, (text.contains(x) for x in needles))


def skipped_path(path: Column | str) -> Column:
    """Whether a path runs through a folder that scans leave out."""
    normal = F.concat(F.regexp_replace(F.lower(F.translate(_col(path), "/", "\\")), r"\\$", ""), F.lit("\\"))
    return contains_any(normal, fixed.SKIP_FRAGMENTS)


def attribute_label(hidden: Column | str, system: Column | str, attributes: Column | str | None = None) -> Column:
    """A, R, H, S of a file (archive, read-only, hidden, system), the first two from its attribute bits, if it has any."""
    bit = lambda b: F.coalesce(_col(attributes).bitwiseAND(b) != 0, F.lit(False)) if attributes is not None else F.lit(False)
    label = F.concat_ws(", ", F.when(bit(0x20), "A"), F.when(bit(0x1), "R"), F.when(_col(hidden) | bit(0x2), "H"), F.when(_col(system) | bit(0x4), "S"))
    return F.when(label == "", "Normal").otherwise(label)


def _marked(text: Column) -> Column:
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), fixed.PROTECTED_MARKERS)


def protected_for_summary() -> Column:
    return F.col("protected") | _marked(F.concat_ws(" ", "content_status", "scan_error", "protection_type"))


def protected_for_risk() -> Column:
    """By the first of status, error and type that is not empty."""
    return F.col("protected") | _marked(F.coalesce(blank("content_status"), blank("scan_error"), blank("protection_type")))


def protected_for_remediation() -> Column:
    return F.col("protected") | _marked(F.coalesce(blank("content_status"), blank("scan_error")))


def protected_in_views() -> Column:
    return protected_for_risk() | F.col("extension").isin(*PROTECTED_IN_VIEWS)


def department() -> Column:
    """The first part of the path that names a department, else share, grandparent folder or source."""
    own = parts("path")
    named = F.filter(own, lambda p: contains_any(F.lower(p), [d.lower() for d in fixed.DEPARTMENTS]))
    return F.coalesce(
        F.replace(F.try_element_at(named, F.lit(1)), F.lit("_"), F.lit(" ")), blank("share"), F.try_element_at(own, F.lit(-3)), blank("source"), F.lit("-")
    )


def folder() -> Column:
    """The last two folders above the file, below its share."""
    own = parts("path")
    above = F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0)))
    last = F.array_join(F.slice(above, F.greatest(F.size(above) - 1, F.lit(1)), 2), "/")
    return F.when(blank("share").isNotNull() & (F.size(own) > 0), F.concat("share", F.lit("/"), F.coalesce(blank(last), F.lit("root")))).otherwise(
        F.coalesce(blank(last), blank("share"), blank("source"), F.lit("local"))
    )


def heat_group() -> Column:
    return F.coalesce(blank("share"), F.try_element_at(parts("path"), F.lit(-2)), blank("source"), F.lit("local"))


def inventory_source() -> Column:
    return F.coalesce(blank(F.trim(F.coalesce(blank("source"), blank("share"), F.lit("workspace")))), F.lit("workspace"))


def compare_key() -> Column:
    """The key that tells files of two scans apart; case does not count."""
    return F.lower(F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce("share", F.lit("")), F.coalesce(blank("path"), blank("name"), F.lit(""))))


def file_key() -> Column:
    """The key of manual overrides; case counts."""
    return F.concat_ws("|", F.coalesce(blank("source"), F.lit("unknown")), F.coalesce("share", F.lit("")), F.coalesce(blank("path"), blank("name"), F.lit("")))


def preview(content: Column | str, lines: int = 8, chars: int = 1800) -> Column:
    """available, lines, truncated: the first lines of a text, within a number of characters."""
    c = F.coalesce(_col(content), F.lit(""))
    every = F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n")
    text = F.array_join(F.slice(every, 1, lines), "\n")
    cut = (F.size(every) > lines) | (F.length(text) > chars)
    none = F.array().cast("array<string>")
    return F.when(
        c != "", F.struct(F.lit(True).alias("available"), F.split(F.substring(text, 1, chars), "\n").alias("lines"), cut.alias("truncated"))
    ).otherwise(F.struct(F.lit(False).alias("available"), none.alias("lines"), F.lit(False).alias("truncated")))


def redacted(value: Column, squeeze: bool = False) -> Column:
    v = F.trim(F.regexp_replace(value, r"\s+", " ")) if squeeze else value
    return F.when(F.length(v) <= 6, "***").otherwise(F.concat(F.substring(v, 1, 3), F.lit("***"), F.right(v, F.lit(2))))


def risk_label(level: Column | str, score: Column | str) -> Column:
    names = {"CRITICAL": "Immediate remediation", "HIGH": "Restrict and review", "MEDIUM": "Owner review"}
    told = reduce(lambda c, kv: c.when(_col(level) == kv[0], kv[1]), names.items(), F.when(F.lit(False), ""))
    return told.when(_col(score) > 0, "Monitor").otherwise("No action")


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("long")
