"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, centroids, language, lm, merkle, mixing, neardup, ngramjoin, passages, pii, quality, tokens
from .common import read_table


def _documents(*columns: str, of: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: of(read_table(spark, sf_dir, "documents", *columns))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.pages_language(read_table(spark, sf_dir, "pages", "page_id", "url", "html"), read_table(spark, sf_dir, "documents", "text", "lang"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": _documents("doc_id", "text", of=bpe.digests),
    "op2_language_id": _documents("doc_id", "text", "lang", "source", of=language.documents_language),
    "op3_lm_scoring": _documents("doc_id", "text", of=lm.scored),
    "op4_source_mixing": _documents("doc_id", "text", "source", of=mixing.taken),
    "op7_pii": _documents("doc_id", "text", of=pii.digests),
    "op8_nearest_neighbours": lambda spark, sf_dir: ann.neighbours(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")),
    "op9_quality_rules": _documents("doc_id", "text", of=quality.quality),
    "op10_near_duplicates": _documents("doc_id", "text", of=neardup.near_duplicates),
    "op11_centroid_clusters": lambda spark, sf_dir: centroids.clusters(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")),
    "op12_ngram_join": _documents("doc_id", "text", of=ngramjoin.ngram_components),
    "op13_merkle_manifest": _documents("doc_id", "source", "lang", "n_chars", "text", of=merkle.digests),
    "op5_passage_dedup": _documents("doc_id", "text", of=passages.digests),
    "op6_token_counts": _documents("doc_id", "text", of=tokens.token_counts),
    "language_id_pages": _pages,
    "pipeline": _pipeline,
}

ORACLE_SQL: dict[str, str] = {"op4_source_mixing": mixing.SQL, "op11_centroid_clusters": centroids.SQL, "op12_ngram_join": ngramjoin.SQL, "op13_merkle_manifest": merkle.SQL}
