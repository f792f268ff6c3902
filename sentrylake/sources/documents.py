"""Text of office documents and PDF files, from their bytes."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, props

#: Characters of text that count; a PDF is read for four times as many bytes.
MOST_CHARACTERS = 120_000
#: Where the parts with text lie in a container, by the kinds of extension.
PARTS = {".doc": "word/", ".dot": "word/", ".xls": "xl/", ".ppt": "ppt/slides/", ".od": "", ".ot": ""}


def extract(extension: str, raw: bytes) -> str:
    """The text of a document; empty where it cannot be read."""
    if extension == ".pdf":
        literals = re.findall(rb"\(([^()]*)\)", raw[: 4 * MOST_CHARACTERS])
        return "\n".join(x.decode("latin-1") for x in literals)[:MOST_CHARACTERS]
    folder = next((v for k, v in PARTS.items() if extension.startswith(k)), None)
    if folder is None:
        return ""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as container:
            trees = (ElementTree.fromstring(container.read(n)) for n in container.namelist() if n.startswith(folder) and n.endswith(".xml"))
            return "\n".join(" ".join(filter(None, t.itertext())) for t in trees)[:MOST_CHARACTERS]
    except (zipfile.BadZipFile, ElementTree.ParseError, NotImplementedError, RuntimeError, OSError):
        return ""


def with_text(files: DataFrame) -> DataFrame:
    """path, text of ``files`` (path, content): plain text natively, documents by :func:`extract`, else empty."""
    named = files.select("path", "content", props.extension("path").alias("extension"))
    plain = named.where(F.col("extension").isin(*fixed.TEXT_EXTENSIONS)).select("path", F.make_valid_utf8(F.substring("content", 1, 256 << 10).cast("string")).alias("text"))
    other = named.where(~F.col("extension").isin(*fixed.TEXT_EXTENSIONS, *fixed.DOCUMENT_EXTENSIONS)).select("path", F.lit("").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one document's bytes at a time
                path, raw, extension = (batch.column(c)[k].as_py() for c in range(3))
                yield pa.RecordBatch.from_pydict({"path": [path], "text": [extract(extension, raw or b"")]})

    rich = named.where(F.col("extension").isin(*fixed.DOCUMENT_EXTENSIONS)).mapInArrow(run, "path string, text string")
    return plain.unionByName(other).unionByName(rich)
