"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors with cosine >= c lie within eps = sqrt(2 - 2c) of each other. They are sorted by
their grid cells (of width eps) on the leading principal axes and cut into blocks. Pairs
of intervals of that sequence are refined level by level, from the whole sequence down to
single blocks; a pair whose boxes (on those axes, and of the lengths of what lies beyond them) are more
than eps apart is skipped with all that it holds. What remains is compared block against block, in square
tiles of block pairs that fetch each of their blocks once: single precision settles what is
clear, double precision what is near the threshold. A block pair returns a count per vector
and a spanning set of links, never all pairs.

How much is skipped depends on the vectors: where they spread over all axes alike, as random
directions do, boxes of few axes say little, and most blocks meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import map_batches
from .components import connected_components
from .scratch import materialise, release

COSINE = 0.9
AXES = 16
BLOCK = 1024
#: Blocks on each side of a tile.
TILE = 8
#: Vectors the principal axes are fitted on, about; axes change what is skipped, not what is found.
AXIS_SAMPLE = 20_000
#: Children of an interval on the way from the whole sequence to single blocks.
FAN = 8
#: Single precision is trusted beyond this distance from the threshold.
BAND = 1e-4


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _usable(vector: Column) -> Column:
    """Not null, of finite components, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.exists(vector, lambda x: x != 0) & ~bad, F.lit(False))


def _matrices(vectors: pa.ListArray) -> np.ndarray:
    """The lists of one length as a matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def principal_axes(vectors: DataFrame, axes: int = AXES) -> dict[int, np.ndarray]:
    """Leading principal axes per length of vector, from a bounded sample drawn by hash."""
    total = vectors.count()
    if total > AXIS_SAMPLE:
        vectors = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < max(1, AXIS_SAMPLE * (1 << 20) // total))
    by_size: dict[int, list[np.ndarray]] = {}
    sums: dict[int, list] = {}
    for row in vectors.select("vector").toLocalIterator():
        by_size.setdefault(len(row["vector"]), []).append(np.array(row["vector"], float))
    for size, rows in by_size.items():
        unit = _unit(np.array(rows))
        sums[size] = np.linalg.eigh(unit.T @ unit / len(unit) - np.outer(unit.mean(0), unit.mean(0)))[1][:, ::-1][:, :axes]
    return sums


def _seen(unit: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Where unit rows lie on the axes, and in a last column the length of the rest of each: the distance of
    two rows is at least that of these."""
    size = unit.shape[1]
    fitted = axes.get(size, np.eye(size, min(AXES, size)))
    out = np.zeros((len(unit), AXES + 1))
    out[:, : fitted.shape[1]] = unit @ fitted
    out[:, AXES] = np.sqrt(np.maximum(1 - (out * out).sum(1), 0))
    return out


def _blocks(vectors: DataFrame, axes: dict[int, np.ndarray], eps: float, block: int) -> DataFrame:
    """part, at, size, lo, hi, ids, weights, vectors: the sequence in grid order, in blocks."""
    sent = vectors.sparkSession.sparkContext.broadcast(axes)

    def place():
        def turn(batch: pa.RecordBatch):
            rows = batch.column("vector")
            sizes = np.diff(rows.offsets.to_numpy())
            cells = np.zeros((len(rows), AXES), np.int64)
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                unit = _unit(_matrices(rows.take(pa.array(mine))))
                cells[mine] = np.floor(_seen(unit, sent.value)[:, :AXES] / eps).astype(np.int64)
            return {
                "vec_id": batch.column("vec_id"),
                "weight": batch.column("weight"),
                "vector": rows,
                "size": sizes,
                "cell": list(cells),
            }

        return turn

    kind = dict(vectors.dtypes)["vector"]
    placed = map_batches(vectors, f"vec_id long, weight long, vector {kind}, size int, cell array<long>", place)
    count = vectors.count()
    order = ["size", "cell", "vec_id"]
    placed = placed.repartitionByRange(max(1, -(-count // (4 * block))), *order).sortWithinPartitions(*order)

    def cut(batches):
        part, at = TaskContext.get().partitionId(), 0
        waiting: list[tuple[int, int, int, list]] = []
        schema = pa.schema([("part", pa.int32()), ("at", pa.int32()), ("size", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("ids", pa.binary()), ("weights", pa.binary()), ("vectors", pa.binary())])

        def emit(rows):
            nonlocal at
            table = pa.Table.from_batches(rows).combine_chunks()
            matrix = _matrices(table.column("vector").combine_chunks())
            size = matrix.shape[1]
            seen = _seen(_unit(matrix), sent.value)
            ids = table.column("vec_id").to_numpy().astype("<i8")
            weights = table.column("weight").to_numpy().astype("<i8")
            out = pa.RecordBatch.from_pylist(
                [dict(part=part, at=at, size=size, lo=seen.min(0).tolist(), hi=seen.max(0).tolist(), ids=ids.tobytes(), weights=weights.tobytes(), vectors=matrix.tobytes())],
                schema=schema,
            )
            at += 1
            return out

        held: list[pa.RecordBatch] = []
        n = 0
        last = None
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            start = 0
            while start < len(sizes):
                if last is not None and sizes[start] != last:
                    yield emit(held)
                    held, n = [], 0
                last = sizes[start]
                stop = min(len(sizes), start + block - n)
                other = np.flatnonzero(sizes[start:stop] != last)
                if len(other):
                    stop = start + int(other[0])
                held.append(batch.slice(start, stop - start))
                n += stop - start
                start = stop
                if n == block:
                    yield emit(held)
                    held, n, last = [], 0, None
        if n:
            yield emit(held)

    return placed.mapInArrow(cut, "part int, at int, size int, lo array<double>, hi array<double>, ids binary, weights binary, vectors binary")


def _block_pairs(boxes: DataFrame, blocks: int, eps: float) -> DataFrame:
    """left, right (left <= right): block pairs that may hold a link, by refining intervals."""
    spark = boxes.sparkSession
    edges = [f"{side}{k}" for side in ("lo", "hi") for k in range(AXES + 1)]
    flat = boxes.select("seq", "size", *[F.col(e[:2])[int(e[2:])].alias(e) for e in edges])
    levels = 0
    while FAN**levels < blocks:
        levels += 1
    pairs = above = spark.createDataFrame([(0, 0)], "left long, right long")
    for level in range(levels - 1, -1, -1):
        interval = F.floor(F.col("seq") / FAN**level)
        nodes = flat.groupBy(interval.alias("node")).agg(
            F.min("size").alias("small"), F.max("size").alias("large"), *[(F.min if e[0] == "l" else F.max)(e).alias(e) for e in edges]
        )
        nodes = nodes.withColumn("above", F.floor(F.col("node") / FAN))
        left, right = (nodes.select(*[F.col(c).alias(f"{side}_{c}") for c in nodes.columns]) for side in ("l", "r"))
        gaps = [F.greatest(F.col(f"l_lo{k}") - F.col(f"r_hi{k}"), F.col(f"r_lo{k}") - F.col(f"l_hi{k}"), F.lit(0.0)) for k in range(AXES + 1)]
        near = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]) <= eps * eps + 1e-6
        pairs = (
            pairs.join(left, F.col("left") == F.col("l_above"))
            .join(right, F.col("right") == F.col("r_above"))
            .where("l_node <= r_node and l_small <= r_large and r_small <= l_large")
            .where(near)
            .select(F.col("l_node").alias("left"), F.col("r_node").alias("right"))
        )
        finer = materialise(pairs, "intervals")
        release(above)
        pairs = above = finer
    return pairs


def _compare(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of unit rows have at least ``cosine``."""
    near = a.astype(np.float32) @ b.astype(np.float32).T
    linked = near >= cosine + BAND
    r, c = np.nonzero((near >= cosine - BAND) & ~linked)
    if len(r):
        linked[r, c] = (a[r] * b[c]).sum(1) >= cosine
    return linked


def _spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A label per row and per column of a bipartite graph: equal where connected."""
    rows, columns = np.arange(linked.shape[0]), np.full(linked.shape[1], linked.shape[0])
    while True:
        new = np.where(linked, rows[:, None], linked.shape[0]).min(0)
        new = np.minimum(columns, new)
        up = np.minimum(rows, np.where(linked, new[None, :], linked.shape[0]).min(1))
        if (up == rows).all() and (new == columns).all():
            return rows, columns
        rows, columns = up, new


def links(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """a, b, n: for each vector ``a`` of a block pair the weight ``n`` of those linked there to it,
    and a vector ``b`` of its component in that pair (the same for all of the component).

    ``vectors`` has vec_id (distinct), weight and vector.
    """
    eps = float(np.sqrt(2 - 2 * cosine))
    kind = np.float64 if "double" in dict(vectors.dtypes)["vector"] else np.float32
    cut = materialise(_blocks(vectors, principal_axes(vectors), eps, block), "blocks")
    most = cut.agg((F.max("at") + 1).alias("at"), (F.max("part") + 1).alias("part")).first()
    numbered = cut.withColumn("seq", F.col("part").cast("long") * most["at"] + F.col("at"))  # in order, with gaps
    pairs = _block_pairs(numbered.select("seq", "size", "lo", "hi"), most["part"] * most["at"], eps)
    tile = [F.floor(F.col(side) / TILE).alias(f"tile_{side}") for side in ("left", "right")]
    tiles = pairs.groupBy(*tile).agg(F.collect_list(F.struct("left", "right")).alias("pairs"))  # at most TILE * TILE
    sides = F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p["left"], p["right"]))))
    fetched = tiles.withColumn("seq", F.explode(sides)).join(numbered.select("seq", "ids", "weights", "vectors"), "seq")

    def compare(table: pa.Table) -> pa.Table:
        blocks = {}
        for k in range(table.num_rows):
            seq, ids, weights, vectors = (table.column(c)[k].as_py() for c in ("seq", "ids", "weights", "vectors"))
            ids = np.frombuffer(ids, "<i8")
            blocks[seq] = ids, np.frombuffer(weights, "<i8"), _unit(np.frombuffer(vectors, kind).reshape(len(ids), -1))
        out = [np.zeros((3, 0), np.int64)]
        for pair in table.column("pairs")[0].as_py():
            out.extend(_pair_links(blocks[pair["left"]], blocks[pair["right"]], pair["left"] == pair["right"], cosine))
        return pa.table(dict(zip("abn", map(pa.array, np.concatenate(out, axis=1)), strict=True)))

    return fetched.groupBy("tile_left", "tile_right").applyInArrow(compare, "a long, b long, n long")


def _pair_links(left: tuple, right: tuple, same: bool, cosine: float) -> list[np.ndarray]:
    """Rows a, b, n of :func:`links` from two blocks of ids, weights and unit vectors."""
    if left[2].shape[1] != right[2].shape[1]:
        return []
    linked = _compare(left[2], right[2], cosine)
    if same:
        np.fill_diagonal(linked, False)
    some_a, some_b = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if not len(some_a):
        return []
    linked = linked[np.ix_(some_a, some_b)]
    label_a, label_b = _spanning(linked)
    head = left[0][some_a]
    out = [np.stack([head, head[label_a], (linked.astype(np.float64) @ right[1][some_b]).astype(np.int64)])]
    # within a block the matrix is symmetric: rows and columns are the same vectors
    n = np.zeros(len(some_b), np.int64) if same else (linked.T.astype(np.float64) @ left[1][some_a]).astype(np.int64)
    out.append(np.stack([right[0][some_b], head[label_b], n]))
    return out


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``embeddings`` (vec_id, embedding).

    Vectors of one length are linked at a cosine of at least ``cosine``. A vector that is null,
    zero, or holds a null or non-finite component links with nothing, nor does one without a
    vec_id (its component is null and it is kept). Equal vectors, repeated rows among
    them, collapse first and count as many as they are. Of several vectors of one vec_id that with the
    smallest hash links for all. Other columns are ignored.
    """
    rows = embeddings.select("vec_id", F.col("embedding").alias("vector"))
    usable = _usable(F.col("vector")) & F.col("vec_id").isNotNull()
    marks = [F.xxhash64("vector"), F.xxhash64(F.lit(17), "vector")]
    rows = rows.select("vec_id", "vector", usable.alias("usable"), *[F.when(usable, m).alias(f"mark_{k}") for k, m in enumerate(marks)])
    copies = materialise(
        rows.where("usable").groupBy("mark_0", "mark_1").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"),
        "copies",
    )
    placed = rows.join(copies, ["mark_0", "mark_1"], "left").select(
        "mark_0", "mark_1", "vec_id", "vector", "usable", F.coalesce("first", "vec_id").alias("first"), F.coalesce("copies", F.lit(1)).alias("weight")
    )
    own = F.min_by(F.struct("weight", "vector"), F.struct("mark_0", "mark_1"))
    classes = materialise(placed.where("usable and vec_id = first").groupBy("vec_id").agg(own.alias("own")).select("vec_id", "own.*"), "classes")
    if not classes.limit(1).count():
        return embeddings.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialise(links(classes, cosine, block), "links")
    release(classes)
    counted = found.groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("linked"))
    edges = found.where("a <> b")
    if edges.limit(1).count():
        labels = connected_components(edges).withColumnRenamed("node", "first")
    else:
        labels = embeddings.sparkSession.createDataFrame([], "first long, component long")
    told = placed.select("vec_id", "usable", "first", "weight").join(counted, "first", "left").join(labels, "first", "left")
    component = F.when(F.col("usable"), F.coalesce("component", "first")).otherwise(F.col("vec_id"))
    return told.select(
        "vec_id",
        F.when(F.col("usable"), F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
