"""Token counts (operator 6): batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.llm.common import table
from readmill.llm.tokens import encoder


def token_count(text: Column, tokenizer: str) -> Column:
    """Number of tokens of a text column by the tokenizer file at a path (.json: tokenizers, .model: sentencepiece).

    No begin, end or added special tokens; special strings inside texts as the library's default has them; nothing is
    truncated or padded.  Null texts count as empty.  Long texts are cut at safe boundaries (see `tokens`), so memory
    follows a segment of a text and not the text's length; only lengths leave the worker.
    """

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(tokenizer, "length")
        for texts in batches:
            yield pa.array(enc.lengths(pc.fill_null(texts.cast(pa.string()), "").to_pylist()), pa.int64())

    return count(text)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null ids stay null, repeated rows give repeated rows, an empty table an empty one; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), token_count(text, tokenizer).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
