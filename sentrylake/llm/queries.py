"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source", "padded_length"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_held_out

    return score_held_out(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a path from source, language and id; every second text that speaks
    of a licence stands for the licence file of its directory."""
    from .licences import scan

    docs = _table(spark, sf_dir, "documents")
    folder = F.expr(
        "CASE doc_id % 3 WHEN 0 THEN concat_ws('/', source, lang, 'part' || doc_id % 8) WHEN 1 THEN concat_ws('/', source, lang) ELSE source END"
    )
    name = F.expr("CASE WHEN contains(lower(text), 'licen') AND doc_id % 2 = 0 THEN 'LICENSE' ELSE 'doc_' || doc_id || '.txt' END")
    return scan(docs.select("doc_id", F.concat_ws("/", folder, name).alias("path"), "text"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_held_out

    return score_held_out(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import report

    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_held_out

    return identify_held_out(_table(spark, sf_dir, "documents"))


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score

    return score(_table(spark, sf_dir, "documents"))


def op10_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


def op13_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign

    return assign(_table(spark, sf_dir, "documents"))


def _licence_sql() -> str:
    from .licences import COSINE, LICENCE_FILE, MARKERS, NOT_TOKEN, template_vectors

    weight, rows, unknown = template_vectors()
    mentions = lambda x: "(" + " OR ".join(f"contains(lower({x}), '{m}')" for m in MARKERS) + ")"
    values = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)
    return rf"""
        WITH weights(token, idf) AS (VALUES {values(sorted(weight.items()))}),
        vectors(template, licence, token, share) AS (VALUES {values(rows)}),
        named AS (
            SELECT doc_id, text,
                   CASE doc_id % 3 WHEN 0 THEN concat_ws('/', source, lang, 'part' || (doc_id % 8)) WHEN 1 THEN concat_ws('/', source, lang) ELSE source END AS directory,
                   CASE WHEN contains(lower(text), 'licen') AND doc_id % 2 = 0 THEN 'LICENSE' ELSE 'doc_' || doc_id || '.txt' END AS name
            FROM documents
        ), files AS (SELECT *, concat_ws('/', directory, name) AS path FROM named),
        sentences AS (
            SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n', chr(10), 'g'), chr(10))) AS segment
            FROM files WHERE {mentions("text")}
        ), segments AS (
            SELECT doc_id, segment FROM sentences WHERE {mentions("segment")}
            UNION SELECT doc_id, text FROM files WHERE regexp_matches(name, '{LICENCE_FILE}')
        ), tokens AS (
            SELECT doc_id, segment,
                   unnest(string_split(regexp_replace(regexp_replace(lower(segment), '[.-]+([^a-z0-9]|$)', ' \1', 'g'), '[^a-z0-9.+-]+', ' ', 'g'), ' ')) AS token
            FROM segments
        ), terms AS (
            SELECT doc_id, segment, token, count(*) * coalesce(any_value(idf), {unknown!r}::DOUBLE) AS value
            FROM tokens LEFT JOIN weights USING (token) WHERE token <> '' GROUP BY doc_id, segment, token
        ), norms AS (SELECT doc_id, segment, sqrt(sum(value * value)) AS norm FROM terms GROUP BY doc_id, segment),
        dots AS (
            SELECT doc_id, segment, template, licence, sum(value * share) AS dot FROM terms JOIN vectors USING (token)
            GROUP BY doc_id, segment, template, licence
        ), scored AS (SELECT doc_id, licence, round(dot / norm, 6) AS cosine FROM dots JOIN norms USING (doc_id, segment)),
        declared AS (
            SELECT doc_id, licence, cosine FROM scored WHERE cosine >= {COSINE}
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, licence) = 1
        ), own AS (
            SELECT directory AS from_directory, licence FROM files JOIN declared USING (doc_id) WHERE name = 'LICENSE'
            QUALIFY row_number() OVER (PARTITION BY directory ORDER BY cosine DESC, licence, doc_id) = 1
        ), force AS (
            SELECT d.directory, own.licence AS inherited, own.from_directory
            FROM (SELECT DISTINCT directory FROM files) d JOIN own ON d.directory = own.from_directory OR starts_with(d.directory, own.from_directory || '/')
            QUALIFY row_number() OVER (PARTITION BY d.directory ORDER BY length(own.from_directory) DESC) = 1
        )
        SELECT doc_id, path, coalesce(licence, inherited) AS licence, cosine, CASE WHEN licence IS NULL THEN from_directory END AS from_directory
        FROM files LEFT JOIN declared USING (doc_id) LEFT JOIN force USING (directory)
    """


def _divergence_sql() -> str:
    from .divergence import duckdb_sql

    return duckdb_sql()


def _sharding_sql() -> str:
    from .sharding import duckdb_sql

    return duckdb_sql()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixture_packing,
        op2_toxicity,
        op3_licences,
        op4_quality,
        op5_near_duplicates,
        op6_warc,
        op7_decontamination,
        op8_language,
        op9_pseudo_likelihood,
        op10_embedding_near_duplicates,
        op11_embedding_whitening,
        op12_source_divergence,
        op13_hilbert_sharding,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_licences": _licence_sql(),
    "op12_source_divergence": _divergence_sql(),
    "op13_hilbert_sharding": _sharding_sql(),
    "op6_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), newest AS (
            SELECT payload_digest, payload_bytes, max(page_id) AS newest FROM p
            WHERE payload_bytes >= 1000 GROUP BY payload_digest, payload_bytes HAVING count(*) > 1
        )
        SELECT page_id, p.payload_bytes, p.payload_digest,
               CASE WHEN newest IS NOT NULL AND newest IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN newest IS NOT NULL AND newest IS DISTINCT FROM page_id THEN newest END AS refers_to
        FROM p LEFT JOIN newest n ON n.payload_digest = p.payload_digest AND n.payload_bytes = p.payload_bytes
    """,
}
