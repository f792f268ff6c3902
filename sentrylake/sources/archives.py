"""Files from folders, and the entries of ZIP archives among them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import props

ENTRY_BYTES, TOTAL_BYTES, ENTRIES, RATIO = 25 << 20, 200 << 20, 2000, 100
PREVIEW_BYTES = 256 << 10
ENTRY = "path string, size long, content binary, protection string"


def scan_folder(spark: SparkSession, folder: str, depth: int | None = None) -> DataFrame:
    """path (below the folder), size, modified_at, content, sha256 of every file below ``folder``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    below = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/+(?=/)|^[a-z0-9]+:", "")
    root = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    rows = found.select(
        F.regexp_replace(below, "^" + root.replace(".", r"\."), "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "content",
        F.sha2("content", 256).alias("sha256"),
    )
    return rows if depth is None else rows.where(F.size(props.parts("path")) - 1 <= depth)


def text_of(content: str = "content") -> Column:
    """The first bytes of a file as text; broken characters are replaced."""
    return F.make_valid_utf8(F.substring(F.col(content), 1, PREVIEW_BYTES).cast("string"))


def _entries(name: str, raw: bytes, nested: bool) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            total = 0
            for info in archive.infolist()[:ENTRIES]:
                if info.is_dir():
                    continue
                path = f"{name}::{info.filename}"
                if info.flag_bits & 1:
                    yield path, info.file_size, None, "password_protected"
                    continue
                total += info.file_size
                if info.file_size > ENTRY_BYTES or total > TOTAL_BYTES or info.file_size > RATIO * max(1, info.compress_size):
                    yield path, info.file_size, None, "archive_limit"
                    continue
                body = archive.read(info)
                yield path, info.file_size, body, None
                if nested and info.filename.lower().endswith(".zip"):
                    yield from _entries(path, body, False)
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError, EOFError):
        yield name, len(raw), None, "bad_archive"


def entries(files: DataFrame) -> DataFrame:
    """path, size, content, protection: a row per entry of the ZIP files of ``files`` (path, content).

    Entries are named ``archive::entry``, one level of archives within archives included. Encrypted entries and
    those beyond the limits have no content but say why; an unreadable archive gives one such row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                rows = list(_entries(name, bytes(raw), True))
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "size", "content", "protection"])

    zips = files.where((props.extension("path") == ".zip") & F.col("content").isNotNull()).select("path", "content")
    return zips.mapInPandas(run, ENTRY)


def with_entries(files: DataFrame) -> DataFrame:
    """The files and the entries of their archives, in one table."""
    own = files.select("path", "size", "content", F.lit(None).cast("string").alias("protection"))
    return own.unionByName(entries(files))
