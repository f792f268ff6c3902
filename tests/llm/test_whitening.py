import numpy as np
import pytest

from sentrylake.llm.whitening import leading, whiten, whole


def by_hand(vectors, k):
    x = np.floor(np.asarray(vectors, float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = lambda r: (r - s // n) - (s % n) / n
    values, axes = np.linalg.eigh(centred(fit).T @ centred(fit) / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum(int(v) ** 2 for v in n * r.astype(object) - s.astype(object)) for r in x]
    return n, deviation, centred(x) @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check(found, vectors, k=16):
    k = min(k, len(vectors[0]))
    n, deviation, whitened, explained = by_hand(vectors, k)
    found = found.sort_values(["vec_id", "component"])
    assert found.component.tolist() == list(range(1, k + 1)) * len(vectors) and (found.n == n).all()
    assert found.deviation.tolist() == [d for d in deviation for _ in range(k)]
    got = found.whitened.to_numpy().reshape(-1, k)
    assert np.abs(got * np.sign((got * whitened).sum(0)) - whitened).max() < 1e-8
    assert np.abs(found.explained.to_numpy().reshape(-1, k) / explained - 1).max() < 1e-9
    assert found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-10


@pytest.mark.parametrize(("rows", "size"), [(300, 64), (500, 120), (40, 3), (60, 1)])
def test_equals_a_dense_solver(spark, rows, size):
    draw = np.random.default_rng(rows)
    vectors = draw.normal(size=(rows, size)) @ np.diag(np.linspace(3, 1, size))
    vectors[7] = vectors[3]
    table = spark.createDataFrame([(k, v.tolist(), 1, 2) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, n int, x int")
    check(whiten(table.repartition(3)).toPandas(), vectors)


def test_odd_rows(spark):
    draw = np.random.default_rng(2)
    good = draw.normal(size=(80, 20)).astype(np.float32)
    inf, nan = float("inf"), float("nan")
    odd = [None, [], [1.0] * 19, [*[1.0] * 19, None], [*[1.0] * 19, nan], [*[1.0] * 19, inf], [*[1.0] * 19, -1e30]]
    rows = [(k, v.tolist()) for k, v in enumerate(good)] + [(200 + k, v) for k, v in enumerate(odd)]
    check(whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas(), good)
    hot = spark.createDataFrame([*rows, *[(None, good[0].tolist())] * 300], "vec_id long, embedding array<float>")
    found = whiten(hot).toPandas()
    check(found.dropna(subset=["vec_id"]), good)
    assert found.vec_id.isna().sum() == 300 * 16


def test_tables_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0 and whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    same = whiten(spark.createDataFrame([(k, [0.5, 0.25]) for k in range(4)], schema)).toPandas()
    assert len(same) == 8 and (same.n == 1).all() and (same.deviation == 0).all() and same[["whitened", "explained", "identity_error"]].isna().all(None)
    line = whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(5)], schema)).toPandas().sort_values(["component", "vec_id"])
    assert line.whitened[line.component > 1].isna().all() and abs(line.explained.iloc[0] - 1) < 1e-12 and line.identity_error.iloc[0] < 1e-12
    assert np.allclose(np.abs(line.whitened[line.component == 1]), np.abs((np.arange(5) - 2) / np.sqrt(2)))


def test_deviation_beyond_64_bits_is_null_and_large_ones_are_exact(spark):
    rows = [(k, [float(2**k), 100.0 * (k % 3)]) for k in range(20)]
    check(whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas(), [v for _, v in rows])
    far = whiten(spark.createDataFrame([(k, [k * 1e12, 1.0]) for k in range(3)], "vec_id long, embedding array<double>")).toPandas()
    assert far.deviation.isna().any() and len(far) == 6


def test_flat_spectrum_ends_after_few_passes_and_a_small_subspace_ends_too(spark):
    draw = np.random.default_rng(3)
    rows = [(k, v.tolist()) for k, v in enumerate(draw.normal(size=(400, 90)))]
    fit, size = whole(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    fit = fit.select("x").distinct().cache()
    most = leading(fit, size)
    assert most[-1] <= 4  # 90 dimensions by blocks of 24
    few = leading(fit, size, k=3, extra=2, kept=4)
    assert np.allclose(few[2], most[2][:3], rtol=1e-9) and few[-1] > 4


def test_equal_eigenvalues(spark):
    rows = [(k * 2 + s, [(1.0 if j == k else 0.0) * (2 * s - 1) for j in range(6)]) for k in range(6) for s in range(2)]
    found = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert np.allclose(found.explained, 1 / 6) and found.identity_error.iloc[0] < 1e-12
