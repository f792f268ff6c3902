"""Predicates over file records and timed rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import props


def extension_list(extensions) -> list[str]:
    """Trimmed, lower-case, with a leading dot, each once."""
    clean = (x.strip().lower() for x in extensions or [])
    return list(dict.fromkeys(x if x.startswith(".") else f".{x}" for x in clean if x))


def scan_filter(
    extensions=(), include_hidden: bool = True, include_system: bool = False, only_hidden: bool = False, only_system: bool = False
) -> Column:
    """Which records a scan takes; no extensions means any."""
    wanted = extension_list(extensions)
    out = F.col("extension").isin(*wanted) if wanted else F.lit(True)
    for flag, only, include in (("is_hidden", only_hidden, include_hidden), ("is_system", only_system, include_system)):
        if only:
            out = out & F.col(flag)
        elif not include:
            out = out & ~F.col(flag)
    return out


def depth_at_most(depth: int, path: Column | str = "path") -> Column:
    """Whether a file lies at most so many folders below the root."""
    return F.size(props.parts(path)) - 1 <= depth


def search_text() -> Column:
    """What the free-text search of the inventory looks through."""
    return F.lower(
        F.concat_ws(
            " ", props.blank("name"), props.blank("path"), props.blank("source"), props.blank("share"), props.blank("extension"), props.blank("owner"),
            props.blank("sha256"), props.blank("content_status"), props.blank("scan_mode"), props.blank("scan_error"), props.blank("protection_type"),
            "level", F.col("score").cast("string"), F.array_join("principals", " "), F.array_join("permissions", " "),
            F.array_join(F.transform("findings", lambda f: F.concat_ws(" ", f["type"], f["label"], f["category"], f["risk"], F.array_join(f["samples"], " "))), " "),
        )
    )


def facet_values() -> Column:
    """Finding types of a record and the pseudo-type of protected files."""
    types = F.filter(F.transform("findings", lambda f: F.trim(f["type"])), lambda t: t != "")
    none = F.array().cast("array<string>")
    return F.concat(types, F.when(props.protected_in_views(), F.array(F.lit("Protected / locked"))).otherwise(none))


def inventory(assessed: DataFrame, bucket: str = "ALL", source: str = "ALL", finding: str = "ALL", query: str = "") -> DataFrame:
    """The visible rows for a risk bucket, a source, a finding type and a free text."""
    out = assessed
    if bucket == "PROTECTED":
        out = out.where(props.protected_in_views())
    elif bucket != "ALL":
        out = out.where(F.col("level") == bucket)
    if source != "ALL":
        out = out.where(props.inventory_source() == source)
    if finding != "ALL":
        out = out.where(F.array_contains(facet_values(), finding))
    if query.strip():
        out = out.where(search_text().contains(query.strip().lower()))
    return out


def in_range(rows: DataFrame, moment: str, days: int | None = None, start: str | None = None, end: str | None = None, now: datetime | None = None) -> DataFrame:
    """Rows of the last ``days`` (1: the last 24 hours; more: whole days up to today), or of
    the dates from ``start`` to ``end``. Rows without a time drop out of any range."""
    if days is not None:
        now = now or datetime.now()
        midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
        cutoff = now - timedelta(days=1) if days == 1 else midnight - timedelta(days=days - 1)
        return rows.where(F.col(moment) >= F.lit(cutoff.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp"))
    if start is None and end is None:
        return rows
    rows = rows.where(F.col(moment).isNotNull())
    if start is not None:
        rows = rows.where(F.col(moment) >= F.lit(f"{start} 00:00:00").cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col(moment) <= F.lit(f"{end} 23:59:59").cast("timestamp"))
    return rows
