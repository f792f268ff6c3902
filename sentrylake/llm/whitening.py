"""Whitening of embeddings: leading principal components by matrix-free block subspace iteration.

The covariance of the distinct vectors is never formed. Each Spark pass multiplies the centred rows X with a
narrow block Q and returns X'(XQ), summed by row of the result before it reaches the driver (dimension x
block numbers, whatever the rows). On the driver a step orthonormalises (QR) and solves the small
projected problem (Rayleigh-Ritz); its Ritz pairs are accepted when the residuals |Vu - eu| of all
k components are small against the largest eigenvalue. The next block is what the plain iteration
would take, V times the Ritz vectors, freed by QR from what earlier blocks already hold, whose products
are kept: so spectra with no gaps, where plain iteration hardly moves, end after dimension / block passes
at the latest. Past ``KEPT`` columns the subspace shrinks to its leading Ritz vectors. A last pass measures
residuals anew, and the covariance of the whitened values themselves.

Defined cases: rows with a null vector, a null or non-finite entry, no entry, an entry too large for a
whole number (beyond 2^52 / 64), or another length than most vectors have (ties: the longer) are dropped. Repeated rows are fitted once and
all returned, null ids too. A component without variance (an eigenvalue below ``RANK`` of the
largest) has null ``whitened``; with no variance at all ``explained`` is null too, and ``identity_error`` is
null when no component varies. A ``deviation`` beyond a long is null. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import map_batches
from .scratch import materialise, release

COMPONENTS = 16
#: Columns of a block beyond the components asked for.
EXTRA = 8
#: Columns of the subspace kept on the driver, in blocks.
KEPT = 24
#: Residuals count as zero below this part of the largest eigenvalue; the last pass may add rounding.
TOLERANCE, CERTIFIED = 1e-13, 1e-11
#: Below this part of it they may stop falling, by the rounding of very large sums.
STALLED = 1e-12
#: Eigenvalues below this part of the largest are no variance.
RANK = 1e-12
SCALE, SHIFT = 64, 1_000_000
_LIMIT = 2.0**52 / SCALE


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= _LIMIT))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def whole(embeddings: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id, x (whole numbers) of the usable rows of the commonest length, and that length (0 without rows)."""
    vector = F.col(f"`{column}`")
    usable = embeddings.where(_usable(vector))
    lengths = usable.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = lengths["size"] if lengths else 0
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return usable.where(F.size(vector) == size).select("vec_id", x.alias("x")), size


def _rows(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of fitted vectors and the sum of each dimension, exact."""

    def total():
        sums, rows = np.zeros(size, np.int64), 0

        def turn(batch: pa.RecordBatch) -> None:
            nonlocal rows
            # the shift is left out here and added below: sums of a task stay far from 2^63
            sums[:] += (_rows(batch, size) - SHIFT).sum(0)
            rows += batch.num_rows

        turn.finish = lambda: {"at": np.arange(-1, size), "value": np.concatenate([[rows], sums])} if rows else None
        return turn

    found = map_batches(fit, "at int, value long", total).groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    by = {r["at"]: int(r["value"]) for r in found}
    n = by.get(-1, 0)
    return n, [by.get(k, 0) + n * SHIFT for k in range(size)] if n else []


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as a whole part and a rest, so that centring loses no digits."""
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])


def _centred(rows: np.ndarray, centre: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (rows - centre[0]).astype(np.float64) - centre[1]


def _pass(fit: DataFrame, n: int, centre: tuple[np.ndarray, np.ndarray], block: np.ndarray, scale: np.ndarray | None = None) -> tuple[np.ndarray, float, np.ndarray]:
    """V times ``block``, the trace of V, and the covariance of the centred rows' products with ``block`` * ``scale``:
    one pass over the fitted vectors. Sums are kept per task, then added by row of the result."""
    size, width = block.shape
    sent = fit.sparkSession.sparkContext.broadcast((centre, block, scale))
    names = [f"v{k}" for k in range(width)]

    def multiply():
        centre, block, scale = sent.value
        out, inner, trace = np.zeros((size, width)), np.zeros((width, width)), 0.0

        def turn(batch: pa.RecordBatch) -> None:
            nonlocal trace
            x = _centred(_rows(batch, size), centre)
            y = x @ block
            out[:] += x.T @ y
            trace += float((x * x).sum())
            if scale is not None:
                z = y * scale
                inner[:] += z.T @ z

        def finish() -> dict:
            last = np.zeros((1, width))
            last[0, 0] = trace
            every = np.concatenate([out, last, inner])
            return {"at": np.arange(len(every)), **{name: every[:, k] for k, name in enumerate(names)}}

        turn.finish = finish
        return turn

    found = map_batches(fit, "at int, " + ", ".join(f"{c} double" for c in names), multiply).groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).collect()
    sent.unpersist()
    every = np.zeros((size + 1 + width, width))
    for row in found:
        every[row["at"]] = row[1:]
    every /= n
    return every[:size], float(every[size, 0]), every[size + 1 :]


def _freed(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what ``block`` has outside ``basis``; dependent directions are left out."""
    block = block / np.maximum(np.linalg.norm(block, axis=0), np.finfo(float).tiny)
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    kept: list[np.ndarray] = []
    for column in block.T:
        for _ in range(2):
            for k in kept:
                column = column - k * (k @ column)
            column = column - basis @ (basis.T @ column)
        length = np.linalg.norm(column)
        if length > 1e-10:
            column = column / length
            for k in kept:
                column = column - k * (k @ column)
            column = column - basis @ (basis.T @ column)
            kept.append(column / np.linalg.norm(column))
    return np.array(kept).T if kept else np.zeros((len(block), 0))


def leading(fit: DataFrame, size: int, k: int = COMPONENTS, extra: int = EXTRA, kept: int = KEPT) -> tuple[int, list[int], np.ndarray, np.ndarray, float, int]:
    """n, sums, eigenvalues (falling), eigenvectors (columns), trace and the number of passes, for the k leading
    components of the covariance of ``fit`` (x, whole numbers)."""
    n, sums = _sums(fit, size)
    if not n:
        return 0, [], np.zeros(0), np.zeros((size, 0)), 0.0, 0
    k = min(k, size)
    width = min(size, k + extra)
    centre = _centre(n, sums)
    basis, product = np.zeros((size, 0)), np.zeros((size, 0))
    block = np.linalg.qr(np.random.default_rng(0).normal(size=(size, width)))[0]
    trace, passes, before = 0.0, 0, np.inf
    while True:
        times, trace, _ = _pass(fit, n, centre, block)
        passes += 1
        basis, product = np.hstack([basis, block]), np.hstack([product, times])
        projected = basis.T @ product
        values, small = np.linalg.eigh((projected + projected.T) / 2)
        values, small = values[::-1], small[:, ::-1]
        ritz, images = basis @ small[:, :width], product @ small[:, :width]
        residual = np.linalg.norm(images - ritz * values[:width], axis=0)
        scale, worst = max(values[0], 0.0), residual[:k].max()
        settled = worst <= TOLERANCE * scale or before / 2 < worst <= STALLED * scale
        before = worst
        if settled or basis.shape[1] >= size:
            return n, sums, values[:k], ritz[:, :k], trace, passes
        if basis.shape[1] + width > kept * width:
            basis, product = ritz, images
        block = _freed(images - ritz * values[:width], basis)
        if not block.shape[1]:  # the subspace holds its own image: its Ritz pairs are exact
            return n, sums, values[:k], ritz[:, :k], trace, passes


def whiten(embeddings: DataFrame, column: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """vec_id, component (1 to ``k``), n, deviation, whitened, explained, identity_error of every usable row.

    See the module for the numbers fitted and for odd rows. Raises if the last pass does not certify the components.
    """
    rows, size = whole(embeddings, column)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not size:
        return embeddings.sparkSession.createDataFrame([], schema)
    fit = materialise(rows.select("x").distinct(), "fitted")
    n, sums, values, vectors, trace, _ = leading(fit, size, k)
    varies = values > max(values[0], 0.0) * RANK
    scale = np.where(varies, 1 / np.sqrt(np.where(varies, values, 1.0)), 0.0)
    centre = _centre(n, sums)
    images, trace, inner = _pass(fit, n, centre, vectors, scale)
    release(fit)
    worst = np.linalg.norm(images - vectors * values, axis=0).max()
    if worst > CERTIFIED * max(values[0], 0.0):
        raise ArithmeticError(f"a residual of {worst:g} is left of eigenvalues up to {values[0]:g}")
    some = np.flatnonzero(varies)
    error = float(np.abs(inner[np.ix_(some, some)] - np.eye(len(some))).max()) if len(some) else None
    explained = [float(v) / trace if trace > 0 else None for v in np.maximum(values, 0)]
    axes = vectors * scale
    total = np.array(sums, object)
    sent = rows.sparkSession.sparkContext.broadcast((centre, axes))

    def deviations(x: np.ndarray) -> np.ndarray | list[int | None]:
        # |n x - S| <= n * spread: whole numbers of 64 bits where the sum of squares surely fits
        spread = max(abs(int(m)) for d in (x.max(0) - centre[0], x.min(0) - centre[0] - 1) for m in d)
        if size * (n * (spread + 1)) ** 2 < 2**62:
            away = n * (x - centre[0]) - np.array([s % n for s in sums], np.int64)
            return np.repeat((away * away).sum(1), len(values))
        found = [sum(v * v for v in n * r.astype(object) - total) for r in x]
        return [v if v < 2**63 else None for v in found for _ in values]

    def project():
        centre, axes = sent.value
        count = axes.shape[1]

        def turn(batch: pa.RecordBatch) -> dict:
            x = _rows(batch, size)
            seen = _centred(x, centre) @ axes
            many = len(x)
            return {
                "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(many), count))),
                "component": np.tile(np.arange(1, count + 1), many),
                "n": np.full(many * count, n),
                "deviation": pa.array(deviations(x), pa.int64()),
                "whitened": pa.array(seen.ravel(), mask=np.tile(~varies, many)),
                "explained": explained * many,
                "identity_error": [error] * (many * count),
            }

        return turn

    kind = dict(rows.dtypes)["vec_id"]
    return map_batches(rows, schema.replace("vec_id long", f"vec_id {kind}"), project)
