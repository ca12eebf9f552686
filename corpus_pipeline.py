"""A training corpus from documents: language, near duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the docs of the next one. All but the last return the columns of
documents; the last adds the packed token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm import bpe, language, mixing, neardup, pii
from quaestor.llm.common import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no known language."""
    return language.accepted(docs.select(*COLUMNS))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group (five words, 0.8 and more)."""
    return neardup.deduplicate(docs.select(*COLUMNS), width=5)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in place of each span."""
    return _sized(pii.redact(docs.select(*COLUMNS)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come near their targets."""
    return mixing.mix(docs.select(*COLUMNS))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens and the packed ids, of texts that the ids give back byte by byte."""
    coded = bpe.encode(docs.select(*COLUMNS), decoded="decoded")
    same = F.col("decoded").eqNullSafe(F.col("text").cast("binary"))
    return coded.filter(same).select(*COLUMNS, (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"), "tokens")


STAGES = [
    ("language ID", by_language),
    ("MinHash near-dedup", without_near_duplicates),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE", tokenized),
]

#: Fitted classifiers, minwise trees and token ids are not to be had in SQL.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; tables in between go to the shared folder, and
    each is deleted once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            _delete(spark, f"{place}/{k - 1}")
    return docs
