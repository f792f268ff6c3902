import numpy as np
from pyspark.sql import functions as F

from sentrylake.llm.embedding_dedup import near_duplicates


def test_equals_brute_force(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 16))
    vectors = np.concatenate([c + draw.normal(size=(20, 16)) * s for c, s in zip(centres, np.linspace(0.05, 0.6, 12))]).astype(np.float32)
    vectors[5] = vectors[4]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] + [0.0] * 14), (904, [1.0, 2.0]), (905, [])]
    found = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=32).toPandas().set_index("vec_id")
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    assert found.n_links[: len(vectors)].tolist() == linked.sum(1).tolist()
    label = np.arange(len(vectors))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1))
        if (new == label).all():
            break
        label = new
    assert found.component_id[: len(vectors)].tolist() == label.tolist()
    assert (found.loc[900:905].n_links == 0).all() and found.loc[900:905].kept.all()


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_odd_rows(spark):
    """Repeated rows, null ids, clashing columns, two vectors of one id, several lengths beyond a block."""
    draw = np.random.default_rng(6)
    long = draw.normal(size=(90, 8))
    short = np.repeat(draw.normal(size=(45, 3)), 2, axis=0)
    rows = [(k, v.tolist(), "x", 1) for k, v in enumerate(long)] + [(100 + k, v.tolist(), None, 2) for k, v in enumerate(short)]
    rows += [(None, long[0].tolist(), "x", 1), (3, long[3].tolist(), "x", 1), (500, long[5].tolist(), "x", 1), (500, long[7].tolist(), "x", 1)]
    found = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, seq string, tile_left int"), block=16).toPandas()
    assert len(found) == len(rows) and found[found.vec_id.isna()].kept.all()
    own = found.dropna(subset=["vec_id"]).drop_duplicates("vec_id").set_index("vec_id")
    assert own.n_links[3] == 1 and all(own.component_id[100 + k] == own.component_id[100 + k - k % 2] for k in range(90))
    unit = short / np.linalg.norm(short, axis=1, keepdims=True)
    assert own.n_links[range(100, 190)].tolist() == ((unit @ unit.T >= 0.9).sum(1) - 1).tolist()


def test_clustered_vectors_skip_most_block_pairs(spark):
    """Vectors about few directions: the grid leaves out most pairs of blocks, and no link."""
    from sentrylake.llm import embedding_dedup as module

    draw = np.random.default_rng(2)
    centres = draw.normal(size=(40, 64))
    rows = np.concatenate([c + 0.05 * draw.normal(size=(32, 64)) for c in centres])
    vectors = spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(draw.permutation(rows))], "vec_id long, weight long, vector array<double>")
    eps = float(np.sqrt(0.2))
    cut = module.materialise(module._blocks(vectors, module.principal_axes(vectors), eps, 16), "blocks")
    most = cut.agg(F.max("at") + 1, F.max("part") + 1).first()
    boxes = cut.withColumn("seq", F.col("part").cast("long") * most[0] + F.col("at")).select("seq", "size", "lo", "hi")
    n = boxes.count()
    kept = module._block_pairs(boxes, most[0] * most[1], eps).count()
    print("block pairs kept", kept, "of", n * (n + 1) // 2)
    assert kept < 0.4 * n * (n + 1) / 2
