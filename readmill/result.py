"""Outcomes of an operator: rows that passed, rows that failed, and what it says about each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def passed(out: DataFrame) -> DataFrame:
    return out.where("valid").drop("valid")


def failed(out: DataFrame, reads: DataFrame) -> DataFrame:
    """The reads as they came of which the operator says that they aren't valid."""
    return reads.join(out.where(~F.coalesce("valid", F.lit(False))).select("ord"), "ord", "left_semi")


def missing(out: DataFrame, reads: DataFrame) -> DataFrame:
    """The reads as they came that an operator's rows don't have any more."""
    return reads.join(out.select("ord"), "ord", "left_anti")


def log(out: DataFrame, *columns: str) -> DataFrame:
    """A row a read: its id, whether it passed, and the given columns."""
    return out.select(F.col("read_id").alias("ID"), F.col("valid").alias("PASS"), *(F.col(c).alias(c.upper()) for c in columns))
