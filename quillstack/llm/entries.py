"""One query for each operator, with the parameters it would run with in production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import covertree, jaccard, media, mixing, oracles, packing, pages, quality, spans, tokenfiles, toxicity
from .common import table


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_by_document(table(spark, sf_dir, "documents"))


def op1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op2_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokenfiles.read_tokens(files)


def op3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed", "words_removed")


def op5_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store(table(spark, sf_dir, "documents")))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), k=3, percent=90)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_pages, op2_tokenfiles, op3_spans, op4_mixing, op5_covertree, op6_packing, op7_toxicity, op8_webp, op9_jaccard, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": oracles.OP4, "op5_covertree": oracles.OP5, "op9_jaccard": oracles.OP9}
