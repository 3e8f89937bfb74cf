"""Corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing.

Each stage takes the Parquet rows that the one before it kept, and all but the last return the columns of documents, with
any further columns carried along untouched, whatever their names. An empty table goes through all stages as one. The
folders of the stages stay below the checkpoint folder, so that a run can be looked at; the caller clears them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from speechjobs.llm import exact_dedup, language_id, mixing, near_dedup, packing
from speechjobs.llm.common import documents, ensure_checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language cannot be told go: a null or empty text, one without a letter, or one as likely in all languages.

    Null lang is not learned from and does not matter otherwise; repeated rows are judged alike; long texts are read whole.
    """
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays.

    Null text is empty text; null ids come last; of rows equal in id and text one stays, by its other columns; long texts
    are compared whole.
    """
    return exact_dedup.keep_owners(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, five-word shingles at 0.8, the smallest id stays.

    Texts without words stay; rows that share an id share its fate; null ids come last; long texts are read whole.
    """
    return near_dedup.keep_representatives(docs, width=5, numerator=80, denominator=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to the target weights; none comes twice in one packed corpus.

    Null or empty texts have no tokens and go; null lang or source is a leaf of its own; rows of one id and size tie, and
    the last document of a leaf stays whole, however long.
    """
    return mixing.keep_mixed(docs, share=0.8, max_epochs=1)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token windows.

    Null text is the end id alone; null ids pass through; repeated rows are packed one by one; a long text fills as many
    windows as it needs.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

ORACLE_SQL = None  # tokenisation and the language model have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
