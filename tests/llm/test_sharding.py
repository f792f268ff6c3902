import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylake.llm.sharding import assign, described, hilbert_index, hilbert_table, may_hold, quantised, write


def check(found, texts, shards):
    """The contract: sizes, checksums, counts at most one apart, slots gapless from 0."""
    sizes = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts)
    assert sorted(zip(found["size"], found.text_crc32)) == sizes
    counts = np.bincount(found.shard, minlength=shards)
    assert len(counts) == shards and counts.max() - counts.min() <= 1
    for _, group in found.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))
    assert (found.law == "rows").all() and found.grown_shard.isna().all()


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_steps_of_one(spark, dimensions, bits):
    cells = list(product(range(1 << bits), repeat=dimensions))
    names = [f"x{k}" for k in range(dimensions)]
    rows = spark.createDataFrame(cells, ", ".join(f"{n} int" for n in names))
    walked = rows.withColumn("at", hilbert_index([F.col(n) for n in names], bits)).toPandas().sort_values("at")
    assert walked["at"].tolist() == list(range(len(cells)))
    assert (np.abs(np.diff(walked[names].to_numpy(), axis=0)).sum(1) == 1).all()
    assert len(hilbert_table(dimensions)) == dimensions * 4**dimensions


def test_odd_rows(spark, odd_documents):
    texts = [r["text"] for r in odd_documents.collect()]
    for shards in (1, 4, 40):
        check(assign(odd_documents, shards).toPandas(), texts, shards)


def test_empty_table_and_clashing_columns(spark, no_documents):
    assert assign(no_documents).count() == 0
    clash = spark.createDataFrame([(1, "a", "en", "s", 3, 4, 5)] * 5, "doc_id long, text string, lang string, source string, shard int, curve int, place int")
    check(assign(clash, 2).toPandas(), ["a"] * 5, 2)
    nothing = spark.createDataFrame([(None, None, None, None)] * 7, "doc_id long, text string, lang string, source string")
    check(assign(nothing, 3).toPandas(), [None] * 7, 3)


def test_a_value_of_most_rows_is_dealt_over_tasks(spark):
    """One source, language and text hold nine tenths of the rows; no range partition holds them all."""
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise("copy").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source")
    )
    from sentrylake.llm.sharding import _ordered

    base = described(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = _ordered(base, quantised(base), 6).groupBy(F.shiftright("place", 33)).count().toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and parts["count"].max() < 2000
    check(assign(rows).toPandas(), [r["text"] for r in rows.collect()], 40)


def test_very_long_text(spark):
    check(assign(spark.createDataFrame([(1, "x" * 3_000_000, "en", "a"), (2, "é", "en", "a")], "doc_id long, text string, lang string, source string"), 2).toPandas(), ["x" * 3_000_000, "é"], 2)


def test_files_are_pruned_in_every_dimension(spark, tmp_path):
    """Written shards: all columns come back in order, and filters on any dimension leave few files to read."""
    draw = np.random.default_rng(5)
    rows = [(k, "w" * int(draw.integers(1, 3000)), f"l{draw.integers(30):02d}", f"site{draw.integers(60):02d}.org", 1) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, slot int")
    kept = write(docs, f"{tmp_path}/shards", shards=64).cache()
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(tuple(r["row"]) for r in back.select("row").collect()) == rows and kept.agg(F.sum("rows")).first()[0] == 6000
    assert kept.count() == 64 and set(back.schema["row"].dataType.names) == set(docs.columns)
    for name, low, high in (("lang", "l03", "l03"), ("source", "site07.org", "site09.org"), ("size", 100, 200)):
        assert kept.where(may_hold(name, low, high)).count() <= 24, name
    both = kept.where(may_hold("lang", "l03", "l03") & may_hold("source", "site07.org", "site09.org") & may_hold("size", 100, 400))
    assert both.count() <= 4
    wanted = back.where("row.lang = 'l03' AND row.source BETWEEN 'site07.org' AND 'site09.org' AND d2 BETWEEN 100 AND 400").select("shard").distinct()
    assert wanted.join(both, "shard", "left_anti").count() == 0


def test_sql_twin(spark):
    import duckdb

    from sentrylake.llm.sharding import duckdb_sql

    folder = "/root/testdata/sf0.001"
    duckdb_rows = duckdb.sql(f"WITH documents AS (FROM '{folder}/documents.parquet') SELECT doc_id, size, text_crc32, shard, slot FROM ({duckdb_sql()}) ORDER BY ALL").fetchall()
    assert sorted(tuple(r) for r in assign(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "size", "text_crc32", "shard", "slot").collect()) == duckdb_rows
