"""Streams. The garble rules need one row only, so the batch function also serves a stream of scored segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.clean import classify


def classify_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, repair: bool = False) -> StreamingQuery:
    """Classifies Parquet files of scored segments as they arrive; a restart goes on where the last run ended."""
    rows: DataFrame = spark.readStream.schema(schema).parquet(source)
    return classify(rows, repair).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)
