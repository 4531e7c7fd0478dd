"""Corpus pipeline: toxicity filter, language filter, near-duplicate removal, packing; each stage's rows go to Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.llm import language, packing, simhash, toxicity
from readmill.llm.common import id_remainder, stored, table

#: Least share that the best language's likelihood has among all languages' for a document to stay.
LEAST_SCORE = 0.5


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels of these documents, scores below its threshold."""
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"), id_remainder(F.col("doc_id"), 3) == 1)
    return docs.where(toxicity.score(F.col("text"), model) < toxicity.THRESHOLD)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter and is in one of the languages learned from these documents.

    A document of which no language has LEAST_SCORE of the likelihood goes, as it could be in several.  Where no language
    can be learned, because no row has one, every document with a letter stays.
    """
    import public_tokenizers

    model = language.fit_on(docs, id_remainder(F.col("doc_id"), 4) == 2, public_tokenizers.path("piece_bpe_32k.model"))
    if not model.languages:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    found = language.predict(F.col("text"), model)
    return docs.where((found["lang_pred"] != "und") & (found["score"] >= LEAST_SCORE))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays: the one with the smallest doc_id, null ids last.

    Rows are numbered first, so that repeated rows and rows without an id are copies like any other.
    """
    row = "row_number"
    while row.lower() in map(str.lower, docs.columns):
        row += "_"
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = simhash.near_duplicates(rows, id_col=row).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", row)
    first = groups.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select(F.col(f"first.{row}").alias(row)), row, "left_semi").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, packed into sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("language_id", in_a_language),
    ("simhash_near_dedup", near_duplicates),
    ("packing", pack),
]

#: Trained models, links and tokenizers can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
