"""A folder read level by level: what a scan leaves out is not opened, and is counted by reason.

Each level's folders are listed in tasks, and judged by column expressions on their paths. Hidden,
system, skipped and too deep folders end there, with everything below them; files are judged by name, extension
and time. Contents are read afterwards, of the files that are left, a piece at a time.

Symbolic links are not followed. A folder that cannot be listed is left out as ``unreadable``. Spark's own
file index would not do: it hides names that begin with a dot or an underscore, and lists whatever lies below.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import props
from .listings import _files
from .stored import new_folder, remove

CHUNK, PREVIEW_BYTES = 1 << 20, 256 << 10
CHILD = "path string, is_folder boolean, size long, modified_at timestamp, failed string"
FILE = "path string, size long, modified_at timestamp, is_folder boolean, reason string"


def dealt(files: DataFrame) -> DataFrame:
    """The rows dealt out by ``path``, into a given number of parts: a row takes a few bytes but stands for a file or folder of any
    size, and where the number is left to Spark it puts small rows together, so that one task reads all files."""
    spark = files.sparkSession
    return files.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")


def _children(root: str):
    """Lists the folders of a batch; paths are relative to ``root`` and begin with a slash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = _files(root)
        local = isinstance(system, fs.LocalFileSystem)
        for batch in batches:
            for below in batch["path"]:
                try:
                    found = system.get_file_info(fs.FileSelector(base + below))
                except OSError:
                    yield pd.DataFrame([(below, True, None, None, "unreadable")], columns=["path", "is_folder", "size", "modified_at", "failed"])
                    continue
                rows = []
                for f in found:
                    link = local and os.path.islink(f.path)
                    folder = f.type == fs.FileType.Directory
                    moment = f.mtime.astimezone(timezone.utc) if f.mtime else None
                    rows.append((f"{below.rstrip('/')}/{f.base_name}", folder, None if folder else f.size, moment, "link" if link else None))
                if rows:
                    out = pd.DataFrame(rows, columns=["path", "is_folder", "size", "modified_at", "failed"])
                    out["size"], out["modified_at"] = out["size"].astype("Int64"), pd.to_datetime(out["modified_at"], utc=True)
                    yield out

    return run


def _reason(depth: int | None, extensions: list[str], hidden: bool, system: bool, skipped: bool, since: datetime | None) -> Column:
    """Why a child is left out; null if it is not. Of several reasons the first."""
    base = props.base_name("path")
    out = F.when(F.col("failed").isNotNull(), F.col("failed"))
    if not hidden:
        out = out.when(base.startswith("."), "hidden")
    if not system:
        out = out.when(F.col("is_folder") & props.system_path("path"), "system")
    if not skipped:
        out = out.when(F.col("is_folder") & props.skipped_path("path"), "skipped")
    if depth is not None:
        out = out.when(F.col("is_folder") & (F.size(props.parts("path")) > depth), "too deep")
    if extensions:
        out = out.when(~F.col("is_folder") & ~props.extension("path").isin(*extensions), "extension")
    if since is not None:
        out = out.when(~F.col("is_folder") & (F.col("modified_at") < F.lit(since)), "older")
    return out


def walk(
    spark: SparkSession, folder: str, depth: int | None = 4, extensions=(), include_hidden: bool = True, include_system: bool = False,
    include_skipped: bool = False, modified_after: datetime | None = None,
) -> DataFrame:
    """path, size, modified_at, is_folder, reason: the files below ``folder``, and with a reason what was left out.

    Folders that were opened are not listed. ``depth`` counts the folders above a file; a file ``folder`` is that one file.
    """
    from pyarrow import fs

    from ..operators.filters import extension_list

    system, base = _files(folder)
    about = system.get_file_info(base)
    if about.type == fs.FileType.NotFound:
        raise FileNotFoundError(folder)
    if about.type == fs.FileType.File:
        return spark.createDataFrame([("/" + about.base_name, about.size, about.mtime, False, None)], FILE)
    reason = _reason(depth, extension_list(extensions), include_hidden, include_system, include_skipped, modified_after)
    levels, out = spark.createDataFrame([("/",)], "path string"), None
    while True:
        path = new_folder(spark, "level")
        children = dealt(levels).mapInPandas(_children(folder), CHILD).select("*", reason.alias("reason"))
        children.write.parquet(path)
        found = spark.read.parquet(path)
        open_folder = F.col("is_folder") & F.col("reason").isNull()
        kept = found.where(~open_folder).select(*[c.split()[0] for c in FILE.split(", ")])
        out = kept if out is None else out.unionByName(kept)
        levels = found.where(open_folder).select("path")
        if levels.isEmpty():
            return out


def left_out(walked: DataFrame) -> DataFrame:
    """reason, folders, files that a walk left out. Folders are counted without what lies in them: it was not looked at."""
    return walked.where("reason IS NOT NULL").groupBy("reason").agg(F.count_if("is_folder").alias("folders"), F.count_if(~F.col("is_folder")).alias("files"))


def contents(walked: DataFrame, folder: str) -> DataFrame:
    """path, size, sha256, preview (the first bytes as text) of the files of a walk, read in pieces of 1 MiB.

    A file that cannot be read has neither checksum nor text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _files(folder)
        for batch in batches:
            rows = []
            for below, size in zip(batch["path"], batch["size"], strict=True):
                told, head = hashlib.sha256(), b""
                try:
                    with system.open_input_stream(base + below, compression=None) as stream:
                        while piece := stream.read(CHUNK):
                            told.update(piece)
                            if len(head) < PREVIEW_BYTES:
                                head += bytes(piece[: PREVIEW_BYTES - len(head)])
                    rows.append((below, size, told.hexdigest(), head.decode("utf-8", "replace")))
                except OSError:
                    rows.append((below, size, None, None))
            yield pd.DataFrame(rows, columns=["path", "size", "sha256", "preview"])

    files = walked.where("reason IS NULL AND NOT is_folder").select("path", "size")
    return dealt(files).mapInPandas(run, "path string, size long, sha256 string, preview string")


def put(files: DataFrame, folder: str) -> None:
    """Write ``content`` of each row as the file ``path`` below ``folder``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _files(folder)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                above = (base + path).rpartition("/")[0]
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                with system.open_output_stream(base + path, compression=None) as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(batch)]})

    files.select("path", F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content")).mapInPandas(run, "n int").agg(F.sum("n")).collect()


def forget(spark: SparkSession, folder: str) -> None:
    """Delete a folder made by :func:`put`."""
    remove(spark, folder)
