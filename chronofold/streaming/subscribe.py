"""Subscriptions as Structured Streaming, and views kept live by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def subscribe(spark: SparkSession, path: str, schema: StructType, from_offset: int = 0, files_per_trigger: int = 64) -> DataFrame:
    """Events of a log folder from an offset on; the files a trigger takes play the part of credits."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).filter(f"offset >= {int(from_offset)}")


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run every batch that is there now through each, then stop; the checkpoint remembers how far it came."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
