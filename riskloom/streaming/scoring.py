"""Scoring a stream: the point scores and fitted pipelines are stateless, so a stream takes them as is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score_stream(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], output: str, checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Append scored rows as parquet; the checkpoint folder makes the output exactly-once."""
    writer = score(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append").option("path", output)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
