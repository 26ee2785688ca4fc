"""A training-data pipeline over ``documents``: each stage takes all that the one before has kept.

Every stage reads doc_id, text, lang, source and n_chars, whatever other columns there are, and takes an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import lines, mixing, near, packing, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their language and source go.

    Null text: empty, so it goes. Null language or source: a group of its own. Null ids, repeated rows and long texts: like others.
    """
    return quality.quality_filter(docs).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay only in the document of the largest id.

    Null text: becomes empty. Null id: a document that never keeps a shared line. Repeated rows: a document each. No row goes.
    """
    return _documents(lines.line_dedup(docs))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles stays: the one of the smallest id.

    Null ids come after all others. Of repeated rows one stays, of texts that share an id one. Texts without words are
    linked with nothing and stay.
    """
    return near.near_filter(docs, words=5, percent=80).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's share of the mix gives it.

    Null source: a source of its own. Null text or no words: nothing to take. Repeated rows: documents like others.
    """
    return _documents(mixing.mix(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in windows of 2048.

    Null or empty text: the end id alone. Null ids and repeated rows: packed like others.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("filter_quality", filter_quality),
    ("dedup_lines", dedup_lines),
    ("dedup_near", dedup_near),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]

#: SQL can't express the robust estimates of the first stage, nor MinHash and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
