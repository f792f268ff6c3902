import random

import corpus_pipeline
from sentrylake.llm import minhash

from .conftest import prose
from .test_minhash import brute


def test_stages_keep_columns_and_take_effect(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, folder)
        assert out.columns == docs.columns and out.count() <= left.count()
        left = out
    packed = corpus_pipeline.run(spark, folder)
    assert packed.select("doc_id").distinct().count() == left.count() < docs.count()


def test_odd_rows(spark, odd_documents, no_documents, tmp_path):
    """Nulls, long texts, repeated rows, clashing columns and empty tables go through every stage."""
    folder = f"file://{tmp_path}"
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    odd = odd_documents.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, 1, 0), (9, 0, 1), (None, 1, 0), (10, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "lorem ipsum"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (odd, odd_documents, no_documents, odd.where("text is null")):
        left = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, left, folder)
            assert out.columns == docs.columns
            left = out
        assert corpus_pipeline.STAGES[-1][1](spark, left, folder).select("doc_id").distinct().count() <= docs.count()
    assert spark.createDataFrame([], columns).columns == odd.columns


def test_labels_of_one_class_keep_all(spark, odd_documents, tmp_path):
    spark.createDataFrame([(1, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    kept = dict(corpus_pipeline.STAGES)["quality"](spark, odd_documents, f"file://{tmp_path}")
    assert kept.count() == odd_documents.count()


def test_near_duplicates_of_the_pipeline_leave_few_entries_to_later_rounds(spark, monkeypatch):
    """Noisy copies of one long text, most of them too noisy to be similar to any other."""
    draw = random.Random(12)
    base = prose(32, 460).split()
    rows = [(0, " ".join(base), "a")]
    for k in range(1, 120):
        own = list(base)
        for at in draw.sample(range(460), 21):
            own[at] = f"edit{draw.randrange(10**6)}"
        rows.append((k, " ".join(own), "a"))
    later = []
    candidates = minhash._candidates

    def counted(placed, sets, percent):
        later.append(placed.count())
        return candidates(placed, sets, percent)

    monkeypatch.setattr(minhash, "_candidates", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    wanted = brute([r[:2] for r in rows])
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in wanted.items() if i == c)
    assert sum(later) <= len(rows)
