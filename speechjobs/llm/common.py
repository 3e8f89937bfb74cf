"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import ensure_checkpoint_dir

__all__ = ["SPACE", "WORD", "documents", "ensure_checkpoint_dir", "id_remainder", "row_of", "shuffle_parts", "slim_worker", "text_of", "worker_cache"]

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, text and what is named, null text as empty; clashing extra columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def named(docs: DataFrame, name: str) -> Column:
    """A column by its whole name, dots and backticks in it included."""
    return docs[f"`{name.replace('`', '``')}`"]


def row_of(docs: DataFrame, without: str | None = None) -> Column:
    """All columns of a row in one struct, whatever their names."""
    return F.struct(*(named(docs, c).alias(c) for c in docs.columns if c != without))


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo `mod`; null ids count as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)), F.lit(0))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slim_worker() -> dict:
    """The worker's dictionary without what earlier stages left in it; freed memory goes back to the system."""
    import ctypes
    import gc

    cache = worker_cache()
    cache.clear()
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it has
        pass
    return cache


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, which Spark uses for many tasks."""
    import sys

    return sys.__dict__.setdefault("_speechjobs_cache", {})
