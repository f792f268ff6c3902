"""Archives as a table function: entries are inflated and hashed a piece at a time, never a file as a whole."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .archives import ENTRIES, ENTRY_BYTES, RATIO, TOTAL_BYTES
from .listings import _files
from .walk import dealt

CHUNK, PREVIEW_BYTES = 1 << 20, 256 << 10
ROW = "entry string, entry_size long, sha256 string, preview string, protection string"


class _Budget:
    """What an archive may still inflate to, nested ones included."""

    def __init__(self, total: int):
        self.left = total


def _read(stream, most: int, keep: bool) -> tuple[int, str, bytes, bytes | None]:
    """Size, checksum, first bytes, and with ``keep`` all bytes of a stream; size ``most`` + 1 if it is longer."""
    told, head, size, whole = hashlib.sha256(), b"", 0, [] if keep else None
    while piece := stream.read(CHUNK):
        size += len(piece)
        if size > most:
            return most + 1, "", b"", None
        told.update(piece)
        if len(head) < PREVIEW_BYTES:
            head += piece[: PREVIEW_BYTES - len(head)]
        if whole is not None:
            whole.append(piece)
    return size, told.hexdigest(), head, b"".join(whole) if whole is not None else None


def _entries(name: str, file, length: int, budget: _Budget, nested: bool) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(file) as archive:
            for info in archive.infolist()[:ENTRIES]:
                if info.is_dir():
                    continue
                path = f"{name}::{info.filename}"
                if info.flag_bits & 1:
                    yield path, info.file_size, None, None, "password_protected"
                    continue
                # what the directory claims is not believed: the stream itself is cut off at the caps
                most = min(ENTRY_BYTES, budget.left, RATIO * max(1, info.compress_size))
                inner = nested and info.filename.lower().endswith(".zip")
                with archive.open(info) as stream:
                    size, told, head, whole = _read(stream, most, inner)
                if size > most:
                    yield path, info.file_size, None, None, "archive_limit"
                    continue
                budget.left -= size
                yield path, size, told, head.decode("utf-8", "replace"), None
                if inner:
                    yield from _entries(path, io.BytesIO(whole), size, budget, False)
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError, EOFError, ValueError):
        yield name, length, None, None, "bad_archive"


@udtf(returnType=ROW)
class Contents:
    """Of a file below a folder: itself, and if it is a ZIP archive its entries, those of archives in it included."""

    def eval(self, folder: str, path: str):
        if folder is None or path is None:
            return
        system, base = _files(folder)
        at = base + "/" + path.lstrip("/")
        try:
            with system.open_input_stream(at, compression=None) as stream:
                size, told, head, _ = _read(stream, 1 << 62, False)
        except OSError:
            yield path, None, None, None, "unreadable"
            return
        yield path, size, told, head.decode("utf-8", "replace"), None
        if path.lower().endswith(".zip"):
            with system.open_input_file(at) as file:
                yield from _entries(path, file, size, _Budget(TOTAL_BYTES), True)


def contents(files: DataFrame, folder: str) -> DataFrame:
    """``files`` (path) joined with what each of them holds: entry, entry_size, sha256, preview, protection.

    Files of any size take one piece of memory; of an entry in an archive within an archive, the inner archive is held, at most
    25 MiB. Caps on number, size, total and ratio hold while reading, whatever the archive's directory says.
    """
    return dealt(files).lateralJoin(Contents(F.lit(folder), F.col("path").outer()))
