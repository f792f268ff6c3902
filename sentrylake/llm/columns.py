"""Small column and batch helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id falls in fold 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds, F.lit(0))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name that no column of ``df`` has (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


#: Rows, and bytes of texts, handled at a time, so that few texts are Python objects at once.
SLICE, SLICE_BYTES = 1000, 2 << 20


def _row_bytes(column: pa.Array) -> np.ndarray | int:
    """Bytes of each row's text; what other columns take is not counted."""
    if pa.types.is_struct(column.type):
        return sum(_row_bytes(column.field(k)) for k in range(column.type.num_fields))
    if any(is_kind(column.type) for is_kind in (pa.types.is_string, pa.types.is_binary, pa.types.is_large_string, pa.types.is_large_binary)):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return 0


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64) + sum(map(_row_bytes, batch.columns))
        upto = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            most = (upto[at - 1] if at else 0) + SLICE_BYTES
            stop = min(at + SLICE, max(at + 1, int(np.searchsorted(upto, most, "right"))), batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


#: Bytes that Spark hands to a Python worker at a time, about.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(df: DataFrame) -> None:
    """Bound the batches of Python workers by bytes, unless the session does: its default of 64 MB a batch
    is much for a worker that holds several."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "67108864b":
        conf.set(_BATCH, str(BATCH_BYTES))


def map_batches(
    df: DataFrame, schema: str | StructType, each: Callable[[], Callable[[pa.RecordBatch], Iterator[dict] | dict | None]]
) -> DataFrame:
    """``mapInArrow`` with set-up: ``each()`` runs once a task and gives the function
    that turns a batch into a dict of columns (or several of them). What that function has
    as ``finish`` is called after the last batch and may give a last dict of columns."""
    spark_schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow_schema = to_arrow_schema(spark_schema)

    def as_batch(part: dict) -> pa.RecordBatch:
        columns = [part[f.name].cast(f.type) if isinstance(part[f.name], pa.Array) else pa.array(part[f.name], f.type) for f in arrow_schema]
        return pa.RecordBatch.from_arrays(columns, schema=arrow_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = each()
        for batch in _slices(batches):
            out = turn(batch)
            yield from map(as_batch, [out] if isinstance(out, dict) else out or ())
        last = getattr(turn, "finish", lambda: None)()
        if last:
            yield as_batch(last)

    _small_batches(df)
    return df.mapInArrow(run, spark_schema)


def keep_rows(df: DataFrame, each: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """The rows of ``df`` that a function of batches says True for, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = each()
        for batch in _slices(batches):
            yield batch.filter(pa.array(chosen(batch), pa.bool_()))

    _small_batches(df)
    return df.mapInArrow(run, df.schema)


def beside_rows(df: DataFrame, schema: str, each: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """row (a struct of all columns of ``df``) and, beside it, what a function of batches says of each row."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    added = _parse_datatype_string(schema)

    def of_row():
        turn = each()
        return lambda batch: {"row": batch.column("row"), **turn(pa.RecordBatch.from_struct_array(batch.column("row")))}

    return map_batches(packed, StructType([StructField("row", df.schema), *added.fields]), of_row)
