"""The queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html, jaccard, langid, pieces, pq, quality, tokencount, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op1(_read(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op2(spark, _read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op3(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op4(spark, _read(spark, sf_dir, "pages"))


def op5_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op5(_read(spark, sf_dir, "documents"))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.op6(spark, _read(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.op7(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op8(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.op9(_read(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_jaccard_join, op3_quality, op4_warc, op5_piece_encoding, op6_vector_dedup, op7_token_counts, op8_toxicity, op9_main_text, op10_decontamination)
}

#: The payload contract is plain SQL; the other operators are tested against
#: brute force, the tokenizer library, round trips and held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
             f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
               CASE WHEN f.first_id IS NOT NULL AND f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first_id IS NOT NULL AND f.first_id <> p.page_id THEN f.first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
}
