"""Filters and trims of reads; each adds `valid` and, where it changes reads, new seq and qual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readmill.functions import sequence as S
from readmill.schema import MISSING, chars


def _inner(inner: bool) -> Column:
    return S.strip(F.col("seq")) if inner else F.col("seq")


def length(reads: DataFrame, least: int = 250, inner: bool = False) -> DataFrame:
    """valid: at least so many letters (inner: without missing ones at the ends)."""
    return reads.withColumn("valid", F.length(_inner(inner)) >= least)


def missing(reads: DataFrame, most: int = 10, inner: bool = False) -> DataFrame:
    """valid: at most so many missing letters."""
    return reads.withColumn("valid", S.count_letters(_inner(inner)) <= most)


def repeats(reads: DataFrame, most: int = 15, include_missing: bool = False, inner: bool = False) -> DataFrame:
    """valid: no run of a letter is longer; missing letters are taken out first unless they count. No letters: no run."""
    seq = _inner(inner)
    return reads.withColumn("valid", S.longest_run(seq if include_missing else F.translate(seq, MISSING, "")) <= most)


def _inner_quality() -> Column:
    start = F.length("seq") - F.length(F.ltrim(F.col("seq"), F.lit(MISSING)))
    return F.substring(F.col("qual"), start + 1, F.length(S.strip(F.col("seq"))))


def quality(reads: DataFrame, least: int = 20, inner: bool = False) -> DataFrame:
    """valid: the floor of the mean quality is at least so much."""
    return reads.withColumn("valid", S.mean_quality(_inner_quality() if inner else F.col("qual")) >= least)


def trim_quality(reads: DataFrame, least: int = 20, window: int = 10, reverse: bool = False) -> DataFrame:
    """seq and qual cut at the first window, of those laid end to end, whose mean quality is too low; valid: anything is left.

    A last short window is judged by its own length.  reverse: from the other end.
    """
    qual = F.reverse("qual") if reverse else F.col("qual")
    starts = F.when(F.length("qual") > 0, F.sequence(F.lit(0), F.length("qual") - 1, F.lit(window))).otherwise(F.array().cast("array<int>"))

    def low(start: Column) -> Column:
        part = F.substring(qual, start + 1, F.lit(window))
        return S.total_quality(part) < F.lit(least) * F.length(part)

    keep = F.coalesce(F.get(F.filter(starts, low), F.lit(0)), F.length("qual"))
    out = reads.select(*reads.columns, F.explode(F.array(keep)).alias("_keep"))  # sought once, however often it is used
    at = (F.length("qual") - F.col("_keep") + 1) if reverse else F.lit(1)
    return out.withColumns({"seq": F.substring(F.col("seq"), at, F.col("_keep")), "qual": F.substring(F.col("qual"), at, F.col("_keep")), "valid": F.col("_keep") > 0}).drop("_keep")


def mask_quality(reads: DataFrame, least: int = 20) -> DataFrame:
    """seq with N where the quality is too low; the qualities stay, and every read is valid."""
    masked = F.zip_with(chars(F.col("seq")), chars(F.col("qual")), lambda c, q: F.when(F.ascii(q) - 33 < least, F.lit("N")).otherwise(c))
    return reads.withColumns({"seq": F.array_join(masked, ""), "valid": F.lit(True)})
