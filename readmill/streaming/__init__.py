"""Operators that look at one read at a time run unchanged on streams of reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def run_on_stream(spark: SparkSession, source: str, schema: StructType | str, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Apply a step to Parquet files as they come into a folder and append what it gives to another, exactly once; stops when all are done."""
    stream = spark.readStream.schema(schema).parquet(source)
    return step(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
