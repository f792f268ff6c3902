"""Tables and folders that are worked out once and then read by many queries."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder of the session's checkpoints; a temporary one for a local master without any."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/stored/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _at(spark, path)
    return system.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at, system = _at(spark, path)
    system.delete(at, True)


def rename(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> bool:
    """Move a file or folder in one step; False if ``target`` exists and stays."""
    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if overwrite else kind.NONE
    (a, _), (b, system) = _at(spark, source), _at(spark, target)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    if not overwrite and system.exists(b):
        return False
    try:
        files.rename(system.makeQualified(a), system.makeQualified(b), options)
    except Exception:
        if overwrite or not system.exists(b):
            raise
        return False
    return True


def bytes_below(spark: SparkSession, path: str) -> int:
    """The length of a file, or of all files of a folder."""
    at, system = _at(spark, path)
    return system.getContentSummary(at).getLength()


def _state(spark: SparkSession, path: str) -> str:
    """A mark that changes with the files under ``path``."""
    at, system = _at(spark, path)
    about, size = system.getFileStatus(at), system.getContentSummary(at)
    return f"{path} {about.getModificationTime()} {size.getLength()} {size.getFileCount()}"


def kept(name: str, source: str, write: Callable[[str], None], spark: SparkSession, about: object = "") -> str:
    """The folder that ``write`` filled at its first use in this application, for as long as the files under
    ``source`` and what ``about`` says (rules, parameters) stay as they are.

    It is filled under a name of its own and then renamed, so nobody reads half of it, and of two that fill it
    at once one's work stays.
    """
    mark = hashlib.sha1(f"{_state(spark, source)} {about!r}".encode()).hexdigest()
    path = f"{folder(spark)}/{name}-{mark}"
    if not exists(spark, path):
        own = new_folder(spark, f"{name}-unfinished")
        write(own)
        if not rename(spark, own, path):
            remove(spark, own)
    return path


def stored(name: str, source: str, build: Callable[[], DataFrame], spark: SparkSession, about: object = "") -> DataFrame:
    """What ``build`` gives, written once: see :func:`kept`."""
    return spark.read.parquet(kept(name, source, lambda path: build().write.parquet(path), spark, about))
