"""Shards of documents along a Hilbert curve over their metadata.

Language, source and size are quantised by their own quantiles, the cells are numbered along a Hilbert
curve, and the sequence in that order is cut into runs of equal numbers of rows. Neighbours
on the curve are neighbours in every dimension, so the smallest and largest values of each shard's file
rule most files out for a filter on any of the dimensions, alone or together.

Everything is built-in functions. The order is made by range partitions: ties of the curve are
split by the text's checksum, the id and at last the row's place in the table, so that a value which a
third of all rows share is dealt over many tasks. A row's place in the sequence is its place in its partition
plus the rows of the partitions before; only that small table of counts, one row a partition, is broadcast.

Defined cases: a null text has no bytes; a null of a dimension lies in its lowest cell; null and repeated
ids, repeated rows and empty texts are rows like all others; with fewer rows than shards some shards stay
empty; an empty table gives no rows. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise, new_path, release

SHARDS = 40
#: Binary digits of each dimension; 2^BITS cells along each.
BITS = 6
DIMENSIONS = ("lang", "source", "size")
#: Bytes that every row takes besides its text.
ROW_BYTES = 16
#: Of the approximate quantiles: their rank is off by at most rows / ACCURACY.
ACCURACY = 10_000
#: Digits of hexadecimal text that make one whole number below 2^56.
_DIGITS = 14
_RECORD = 33  # binary digits of a row's number in what monotonically_increasing_id() gives


def hilbert_table(dimensions: int) -> list[int]:
    """The curve's rule: at ``state * cells + cell`` stands ``next state * cells + digit``.

    A state is the corner where the curve enters a cube and the axis along which it leaves it
    (state = corner * dimensions + axis); ``cell`` has one binary digit for each dimension.
    """
    cells, n = 1 << dimensions, dimensions

    def turned(x: int, by: int) -> int:
        by %= n
        return ((x << by) | (x >> (n - by))) & (cells - 1)

    def zeros(x: int) -> int:
        return (x & -x).bit_length() - 1

    gray = [w ^ (w >> 1) for w in range(cells)]
    enters = [0] + [gray[2 * ((w - 1) // 2)] for w in range(1, cells)]
    axis_of = [0] + [zeros(w if w % 2 == 0 else w + 1) % n for w in range(1, cells)]
    table = [0] * (cells * n * cells)
    for corner in range(cells):
        for axis in range(n):
            for w in range(cells):
                cell = turned(gray[w], axis + 1) ^ corner
                after = (corner ^ turned(enters[w], axis + 1)) * n + (axis + axis_of[w] + 1) % n
                table[(corner * n + axis) * cells + cell] = after * cells + w
    return table


def _once(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``x``, which is worked out once however often ``use`` names it."""
    return F.get(F.transform(F.array(x), lambda value: use(value)), 0)


def hilbert_index(codes: list[Column], bits: int) -> Column:
    """Place on the curve of a cell with these numbers along each dimension, each below 2^bits."""
    n = len(codes)
    cells = 1 << n
    table = F.array(*[F.lit(v) for v in hilbert_table(n)])

    def digit(at: Column, level: Column) -> Column:
        out = F.lit(0)
        for k in range(n):
            out = out + F.call_function("shiftright", at[f"c{k}"], level).bitwiseAND(1) * (1 << k)
        return out

    # step: what the table said last, its digit not yet in the index
    start = F.struct(F.lit(0).alias("step"), F.lit(0).cast("long").alias("index"))

    def walk(at: Column) -> Column:
        return F.aggregate(
            F.array(*[F.lit(k) for k in reversed(range(bits))]),
            start,
            lambda acc, level: F.struct(
                F.get(table, acc["step"].bitwiseAND(-cells) + digit(at, level)).alias("step"),
                (acc["index"] * cells + acc["step"].bitwiseAND(cells - 1)).alias("index"),
            ),
            lambda acc: acc["index"] * cells + acc["step"].bitwiseAND(cells - 1),
        )

    return _once(F.struct(*[code.alias(f"c{k}") for k, code in enumerate(codes)]), walk)


def described(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, keep: list[Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, d0, d1, ... (the dimensions) and what ``keep`` adds. ``size`` names the size."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    size = F.octet_length(text).cast("long") + ROW_BYTES
    own = [(size if name == "size" else F.col(f"`{name}`")).alias(f"d{k}") for k, name in enumerate(dimensions)]
    return docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), *own, *(keep or []))


def quantised(rows: DataFrame, bits: int = BITS) -> list[Column]:
    """For each of the columns d0, d1, ... of ``rows``: the cell of its value, an int below 2^bits.

    A text counts as the number of the seven bytes behind what all values begin with alike, which keeps
    the order of texts. Cells are bounded by quantiles, so a frequent value takes many cells' room.
    """
    kinds = {f.name: f.dataType.typeName() for f in rows.schema if f.name[0] == "d" and f.name[1:].isdigit()}
    hexed = {name: F.hex(F.col(name).cast("binary")) for name, kind in kinds.items() if kind == "string"}
    shared = dict.fromkeys(hexed, 0)
    if hexed:
        ends = rows.agg(*[f(x).alias(f"{name}_{f.__name__}") for name, x in hexed.items() for f in (F.min, F.max)]).first()
        for name in hexed:
            low, high = ends[f"{name}_min"] or "", ends[f"{name}_max"] or ""
            shared[name] = next((k for k, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    as_number = {
        name: F.conv(F.rpad(F.substring(hexed[name], shared[name] + 1, _DIGITS), _DIGITS, "0"), 16, 10).cast("long") if name in hexed else F.col(name).cast("double" if kind in ("float", "double", "decimal") else "long")
        for name, kind in kinds.items()
    }
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    bounds = rows.agg(*[F.percentile_approx(x, shares, ACCURACY).alias(name) for name, x in as_number.items()]).first()

    def cell(x: Column, upper: list | None) -> Column:
        if not upper:
            return F.lit(0)
        ends = F.array(*[F.lit(end) for end in upper])
        return F.when(x.isNull(), 0).otherwise(_once(x, lambda value: F.size(F.filter(ends, lambda end: end <= value))))

    return [cell(x, bounds[name]) for name, x in as_number.items()]


def _ordered(rows: DataFrame, codes: list[Column], bits: int) -> DataFrame:
    """``rows`` with ``curve`` and ``place`` (number of the range partition, and the row's number there), written once:
    a second evaluation might draw other bounds of the ranges."""
    sequence = ["curve", "text_crc32", "doc_id", "place"]
    rows = rows.withColumn("curve", hilbert_index(codes, bits)).withColumn("place", F.monotonically_increasing_id())
    return materialise(rows.repartitionByRange(*sequence).sortWithinPartitions(*sequence).withColumn("place", F.monotonically_increasing_id()), "curve")


def _cut(placed: DataFrame, shards: int) -> DataFrame:
    """``placed`` with ``shard`` and ``slot``: the global rank, cut into runs whose lengths differ by one at most."""
    part = F.shiftright("place", _RECORD)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << _RECORD) - 1)
    ranked = placed.withColumn("part", part).join(F.broadcast(ends), "part").withColumn("rank", rank)
    return ranked.withColumn("shard", F.expr(f"int(rank * {shards} div total)")).withColumn(
        "slot", F.expr(f"rank - (shard * total + {shards - 1}) div {shards}")
    )


def assign(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    The law is ``rows``: shards 0 to ``shards`` - 1 differ by one row at most. Texts are read once, and not moved.
    """
    rows = materialise(described(docs, dimensions), "described")
    placed = _ordered(rows, quantised(rows, bits), bits)
    release(rows)
    return _cut(placed, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write(docs: DataFrame, path: str, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """Write all columns of ``docs`` to ``path`` by shard, in the curve's order; returns :func:`manifest` of it.

    Each shard is a folder ``shard=k`` of one or two files; ``slot`` is added to the row as its last
    field. Columns are kept in a struct ``row``, so that none clashes with these.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = described(docs, dimensions, [row])
    narrow = materialise(described(docs, dimensions), "described")
    codes = quantised(narrow, bits)
    release(narrow)
    placed = _ordered(rows, codes, bits)
    named = {f"d{k}": name for k, name in enumerate(dimensions)}
    _cut(placed, shards).select("row", "slot", "shard", *[F.col(d) for d in named]).write.partitionBy("shard").parquet(path)
    release(placed)
    return manifest(docs.sparkSession.read.parquet(path), list(dimensions))


def manifest(written: DataFrame, dimensions: list[str]) -> DataFrame:
    """shard, rows, and for each dimension the smallest and largest value and the number of nulls."""
    found = [F.count("*").alias("rows")]
    for k, name in enumerate(dimensions):
        found += [F.min(f"d{k}").alias(f"{name}_min"), F.max(f"d{k}").alias(f"{name}_max"), F.count_if(F.col(f"d{k}").isNull()).alias(f"{name}_nulls")]
    return written.groupBy("shard").agg(*found)


def may_hold(dimension: str, low, high) -> Column:
    """Of a row of :func:`manifest`: whether its shard may hold a value from ``low`` to ``high``."""
    return F.coalesce((F.col(f"{dimension}_max") >= low) & (F.col(f"{dimension}_min") <= high), F.lit(False))


def scratch_folder(docs: DataFrame) -> str:
    """A new folder in the shared scratch place, for :func:`write`."""
    return new_path(docs.sparkSession, "shards")


def crc_table() -> list[int]:
    """What each byte does to the reflected checksum of polynomial 0xEDB88320."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    return table


def duckdb_sql(shards: int = SHARDS, bits: int = BITS) -> str:
    """DuckDB SQL for the rows of :func:`assign` over ``documents``, the curve walked digit by digit, the checksum byte by byte."""
    cells, shares = 8, ", ".join(str(k / (1 << bits)) for k in range(1, 1 << bits))
    text = lambda name: f"hex(encode({name}))"
    number = lambda name: f"('0x' || rpad(substr({text(name)}, (SELECT {name}_same FROM ends) + 1, {_DIGITS}), {_DIGITS}, '0'))::BIGINT"
    names = ("lang", "source", "size")
    steps = ""
    for level in reversed(range(bits)):
        before = f"walk{level + 1}"
        cell = " + ".join(f"((c{k} >> {level}) & 1) * {1 << k}" for k in range(len(names)))
        steps += f"walk{level} AS (SELECT * REPLACE (rule[(step & {-cells}) + {cell} + 1] AS step, index * {cells} + (step & {cells - 1}) AS index) FROM {before}), "
    return f"""
        WITH bytes AS (
            SELECT doc_id, lang, source, strlen(coalesce(text, '')) + {ROW_BYTES} AS size,
                   list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS each
            FROM documents
        ), base AS (
            SELECT doc_id, lang, source, size,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, each), lambda c, b: xor(c >> 8, {crc_table()}[xor(c & 255, b) + 1])), 4294967295::BIGINT) AS text_crc32
            FROM bytes
        ), heads AS (SELECT min({text("lang")}) AS l0, max({text("lang")}) AS l1, min({text("source")}) AS s0, max({text("source")}) AS s1 FROM base),
        ends AS (
            SELECT (SELECT coalesce(max(k), 0) FROM range(1, 200) r(k) WHERE k <= least(strlen(l0), strlen(l1)) AND left(l0, k) = left(l1, k)) AS lang_same,
                   (SELECT coalesce(max(k), 0) FROM range(1, 200) r(k) WHERE k <= least(strlen(s0), strlen(s1)) AND left(s0, k) = left(s1, k)) AS source_same
            FROM heads
        ), numbers AS (SELECT doc_id, size, text_crc32, {number("lang")} AS n0, {number("source")} AS n1, size AS n2 FROM base),
        bounds AS (SELECT {", ".join(f"quantile_disc(n{k}, [{shares}]) AS b{k}" for k in range(3))} FROM numbers),
        walk{bits} AS (
            SELECT doc_id, size, text_crc32, {", ".join(f"coalesce(len(list_filter(b{k}, lambda b: b <= n{k})), 0) AS c{k}" for k in range(3))},
                   {hilbert_table(3)} AS rule, 0::BIGINT AS step, 0::BIGINT AS index
            FROM numbers, bounds
        ), {steps}
        ranked AS (
            SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY index * {cells} + (step & {cells - 1}), text_crc32, doc_id NULLS FIRST) - 1 AS rank, count(*) OVER () AS total
            FROM walk0
        ), cut AS (SELECT *, rank * {shards} // total AS shard FROM ranked)
        SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, rank - (shard * total + {shards - 1}) // {shards} AS slot, NULL::INTEGER AS grown_shard FROM cut
    """
