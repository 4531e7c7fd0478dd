"""One value of a field for each group of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmill.functions import annotation as A
from readmill.operators.consensus import majority, with_set


def consensus(reads: DataFrame, group: str = "BARCODE", field: str = "SAMPLE") -> DataFrame:
    """Every read's field set to its group's majority value, the first of ties.

    Values are counted before the shuffle and joined back, so a large group is not gathered.
    """
    sets = with_set(reads, group)
    top = majority(sets, field).select("set_id", F.col("top").alias("_top"))
    name = field.upper()
    ann = F.transform("ann", lambda p: F.struct(p["k"].alias("k"), F.when(p["k"] == name, F.col("_top")).otherwise(p["v"]).alias("v")))
    return sets.join(top, "set_id").withColumn("ann", ann).drop("_top", "set_id")


def deletion(reads: DataFrame, group: str = "BARCODE", field: str = "SAMPLE") -> DataFrame:
    """Reads of groups that have one value of the field alone."""
    sets = with_set(reads, group)
    value = A.get(F.col("ann"), field)
    pure = sets.groupBy("set_id").agg(F.min(value).alias("a"), F.max(value).alias("b")).where(F.col("a") == F.col("b")).select("set_id")
    return sets.join(pure, "set_id", "left_semi").drop("set_id")
