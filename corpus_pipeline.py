"""From raw documents to training data, in five stages.

Each stage works on all rows that the one before kept, and is written as
Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import decontam, jaccard, langid, pieces, quality
from gridloom.llm.scratch import Scratch

_LANG, _SCORE = "_gridloom_lang", "_gridloom_score"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in none of the learned languages."""
    told = langid.identify(docs, langid.learn(docs), lang_out=_LANG, score_out=_SCORE, reject=True)
    return told.where(F.col(_LANG) != "und").select(docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is below the classifier's threshold."""
    model = quality.learn(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_column(docs, model, out=_SCORE).where(F.col(_SCORE) >= quality.THRESHOLD).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return jaccard.one_of_each(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.without_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and the piece ids of each document."""
    coded = pieces.encode_column(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", F.size("pieces").cast("long").alias("n_pieces"), "pieces")


STAGES = [
    ("language_id", language_id),
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("piece_encoding", piece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs


#: The stages learn models and follow links: no SQL; tested against brute force.
ORACLE_SQL = None
