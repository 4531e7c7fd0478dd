"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.schema import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write df to the shared folder (a folder for each value of `by`) and read it back: lineage ends there, and a lost
    executor loses nothing.  All that an application writes is in one folder, which can be cleared when it has ended."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/readmill-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def id_remainder(col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null ids give null."""
    return F.pmod(F.crc32(col.cast("string")), F.lit(mod))


def by_bytes(texts: Iterable[str], most: int) -> Iterator[list[str]]:
    """Group texts into batches of about `most` characters; one longer text is a batch of its own."""
    batch: list[str] = []
    size = 0
    for t in texts:
        if batch and size + len(t) > most:
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += len(t)
    if batch:
        yield batch


_HOLDER = None


def claim(memo) -> None:
    """Let one memo at a time fill a worker's memory: whichever was used before forgets what it holds."""
    global _HOLDER
    if _HOLDER is not memo:
        if _HOLDER is not None:
            _HOLDER.forget()
        _HOLDER = memo
