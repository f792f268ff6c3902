"""Listings of shares and machines as a table: a Python data source with one partition for each of them.

A listing is what a share or an agent answers to "what files do you hold": pages of a JSON object
``{"records": [...], "diagnostics": {...}}``. Here the answers are exported files, a folder ``kind=.../target=...`` for
each share or machine with a page a line; a client that asks over the network would only replace
:meth:`Answers.read`. Filters on ``kind`` and ``target`` are pushed into the source, so partitions
that no row can come from are never made.

A target that cannot be read gives one page without records whose diagnostics say why, and does not fail
the job; a page that is not JSON counts as a bad page of its target.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

FORMAT = "remote_listing"
#: Records of a page, at most.
PAGE = 1000
RECORD = "doc_id:bigint,source:string,share:string,path:string,name:string,size:bigint,is_hidden:boolean,is_system:boolean,owner:string,sha256:string,principals:array<string>,permissions:array<string>"
REPORT = f"struct<records:array<struct<{RECORD}>>,diagnostics:struct<listed:bigint,denied:bigint,error:string>>"


def _files(folder: str):
    """The file system and path of a folder that any machine can reach."""
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


@dataclass
class Target(InputPartition):
    kind: str
    target: str
    path: str


class Answers(DataSourceReader):
    """Pages of the targets that pushed filters leave."""

    def __init__(self, folder: str):
        self.folder = folder
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute in (("kind",), ("target",)):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, named: dict[str, str]) -> bool:
        def holds(f: Filter) -> bool:
            value = named[f.attribute[0]]
            if isinstance(f, EqualTo):
                return value == f.value
            return value in f.value if isinstance(f, In) else value.startswith(f.value)

        return all(map(holds, self.tests))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _files(self.folder)

        def folders(path: str, column: str) -> Iterator[tuple[str, str]]:
            for found in system.get_file_info(fs.FileSelector(path)):
                if found.type == fs.FileType.Directory and found.base_name.startswith(f"{column}="):
                    yield unquote(found.base_name.split("=", 1)[1]), found.path

        out = [Target(kind, target, path) for kind, above in folders(root, "kind") for target, path in folders(above, "target")]
        return [t for t in sorted(out, key=lambda t: (t.kind, t.target)) if self._wanted({"kind": t.kind, "target": t.target})]

    def read(self, partition: Target) -> Iterator[tuple]:
        from pyarrow import fs

        if partition is None:  # without any target Spark asks for one empty partition
            return
        page = 0
        try:
            system, _ = _files(self.folder)
            for found in sorted(system.get_file_info(fs.FileSelector(partition.path)), key=lambda f: f.path):
                if found.type == fs.FileType.File and not found.base_name.startswith(("_", ".")):
                    with system.open_input_stream(found.path) as stream:
                        rest = b""
                        while block := stream.read(1 << 20):
                            *lines, rest = (rest + bytes(block)).split(b"\n")
                            for line in lines:
                                yield partition.kind, partition.target, page, line.decode("utf-8", "replace")
                                page += 1
                        if rest:
                            yield partition.kind, partition.target, page, rest.decode("utf-8", "replace")
                            page += 1
        except OSError as error:
            yield partition.kind, partition.target, page, json.dumps({"records": [], "diagnostics": {"error": str(error)[:500]}})


class Listings(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "kind string, target string, page int, payload string"

    def reader(self, schema) -> DataSourceReader:
        return Answers(self.options["path"])


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """kind, target, page, payload of the answers below ``folder``. Registers the source, and lets Spark push
    filters into Python sources (``spark.sql.python.filterPushdown.enabled``) in this session from then on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Listings)
    return spark.read.format(FORMAT).option("path", folder).load()


def records(pages: DataFrame) -> DataFrame:
    """kind, target and the fields of each record of the pages."""
    report = pages.select("kind", "target", F.from_json("payload", REPORT).alias("r"))
    return report.select("kind", "target", F.explode("r.records").alias("f")).select("kind", "target", "f.*")


def diagnostics(pages: DataFrame) -> DataFrame:
    """kind, target, pages, records, denied, errors, bad_pages of each target."""
    report = pages.select("kind", "target", F.from_json("payload", REPORT).alias("r"))
    records = F.col("r.records")
    return report.groupBy("kind", "target").agg(
        F.count(F.lit(1)).alias("pages"),
        F.coalesce(F.sum(F.size(records)), F.lit(0)).cast("long").alias("records"),
        F.coalesce(F.sum("r.diagnostics.denied"), F.lit(0)).alias("denied"),
        F.count("r.diagnostics.error").alias("errors"),
        F.count_if(records.isNull() & F.col("r.diagnostics").isNull()).alias("bad_pages"),
    )


def ordinary_shares(target: str = "target", admin_drive: str | None = None) -> Column:
    """Whether a share is one that scans open: none of those that machines keep for themselves, and of those
    that end in $ only the drive asked for."""
    name = F.upper(F.col(target))
    drive = F.lit(False) if admin_drive is None else name == f"{admin_drive.upper()}$"
    return ~name.isin("PRINT$", "IPC$", "ADMIN$") & (~name.endswith("$") | drive)


def export(files: DataFrame, folder: str) -> None:
    """Write ``files`` (kind, target, page, and the fields of a record) as answers below ``folder``.

    A page holds what has its number, at most :data:`PAGE` records if the caller numbers them so.
    """
    fields = [f.split(":")[0] for f in RECORD.split(",")]
    denied = F.count_if(F.size("principals") == 0)
    pages = files.groupBy("kind", "target", "page").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("records"), F.count(F.lit(1)).alias("listed"), denied.alias("denied"))
    payload = F.to_json(F.struct("records", F.struct("listed", "denied").alias("diagnostics")))
    pages.select("kind", "target", payload.alias("value")).write.partitionBy("kind", "target").text(folder)


def target_folder(folder: str, kind: str, target: str) -> str:
    """Where the answers of one target lie."""
    return f"{folder}/kind={quote(kind, safe="")}/target={quote(target, safe="")}"
