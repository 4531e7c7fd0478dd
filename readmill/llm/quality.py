"""Quality classifier (operator 4): importance resampling by hashed n-gram models of target and raw text, with Gumbel top-k."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.llm.common import id_remainder, stored, table
from readmill.llm.words import groups, segment_sums

#: Buckets of hashed words and word pairs, added count of each bucket, and share of the rows that is drawn.
BUCKETS, SMOOTHING, SHARE = 20_011, 1.0, 0.5
#: Labelled rows of the target that its model is fitted on: those with the smallest hashes of their ids.
FIT_ROWS = 8000
#: Rows left when the search for the k-th key ends with a sort.
LAST_ROWS = 100_000


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of all texts, one text after another, and how many each text has."""
    split = [t.encode().lower().split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    words = np.empty(int(n.sum()), np.uint64)
    at = 0
    for part in split:
        words[at : at + len(part)] = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(4)), np.uint64, len(part))
        at += len(part)
    last = np.zeros(len(words), bool)
    last[(np.cumsum(n) - 1)[n > 0]] = True
    pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] if len(words) else words
    doc = np.repeat(np.arange(len(texts)), n)
    bucket = np.concatenate([words, pairs[~last[:-1]]]) % np.uint64(BUCKETS) if len(words) else words
    owner = np.concatenate([doc, doc[:-1][~last[:-1]]]) if len(words) else doc
    order = np.argsort(owner, kind="stable")
    return bucket[order].astype(np.int64), np.bincount(owner, minlength=len(texts))


def gram_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket of the texts that are of the target, and of all texts, of a table (text, target), in one pass.

    A task sends a row a bucket at most, and so does the sum to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            of_target, at = batch.column(1).to_numpy(zero_copy_only=False), 0
            for group in groups(batch.column(0).to_pylist()):
                bucket, sizes = grams(group)
                mine = np.repeat(of_target[at : at + len(group)], sizes)
                total += [np.bincount(x, minlength=BUCKETS) for x in (bucket[mine], bucket)]
                at += len(group)
        used = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], ["bucket", "target", "raw"])

    found = rows.select("text", "target").mapInArrow(count, "bucket bigint, target bigint, raw bigint")
    got = found.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()
    out = np.zeros((2, BUCKETS))
    out[0, got["bucket"].to_numpy()], out[1, got["bucket"].to_numpy()] = got["target"].to_numpy(), got["raw"].to_numpy()
    return out[0], out[1]


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw by bucket, both smoothed; zero without target text."""
    if not target.sum():
        return np.zeros(BUCKETS)
    p, q = ((x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS) for x in (target, raw))
    return np.log(p) - np.log(q)


def log_weight(text: Column, ratios: np.ndarray) -> Column:
    """Sum of a text's log ratios over its words and word pairs, and their number."""
    sent = SparkSession.getActiveSession().sparkContext.broadcast(ratios)

    @F.arrow_udf("w double, n bigint")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            w, n = [np.zeros(0)], [np.zeros(0, np.int64)]
            for group in groups(pc.fill_null(texts, "").to_pylist()):
                bucket, sizes = grams(group)
                w.append(segment_sums(sent.value[bucket], sizes))
                n.append(sizes)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(w)), pa.array(np.concatenate(n))], ["w", "n"])

    return weigh(text.cast("string"))


def kth_largest(keys: DataFrame, key: str, k: int) -> float:
    """The k-th largest key: the interval that holds it is cut into 1,000 until few rows are left in it, and these are sorted.

    Only counts of intervals come to the driver, until LAST_ROWS or fewer keys (or equal ones) are left.
    """
    low, high, n = keys.agg(F.min(key), F.max(key), F.count(key)).first()
    while n > LAST_ROWS and low < high:
        step = (high - low) / 1000
        slot = F.least(F.floor((F.col(key) - low) / step), F.lit(999))
        counts = dict(keys.where(F.col(key).between(low, high)).groupBy(slot.alias("slot")).count().collect())
        at = 999
        while k > counts.get(at, 0):
            k -= counts.get(at, 0)
            at -= 1
        inside = keys.where(F.col(key).between(low, high) & (slot == at))
        new = inside.agg(F.min(key), F.max(key), F.count(key)).first()
        if new == (low, high, n):
            break
        low, high, n = new
    rest = keys.where(F.col(key).between(low, high)).select(key).orderBy(F.desc(key)).limit(k)
    return rest.agg(F.min(key)).first()[0]


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = 11, label_col: str = "quality", mod: int = 5, out: int = 3) -> DataFrame:
    """doc_id, held_out, log_weight, n_grams, score, gumbel_key, selected for every row.

    log_weight is log p_target(text) - log p_raw(text); the raw model counts every text, the target model the texts of at
    most FIT_ROWS rows labelled 1 whose id isn't held out (crc32 modulo `mod` is `out`).  score (0 to 1) is the logistic of
    the mean log ratio times 10.  gumbel_key adds a Gumbel number made of id, text and seed; the share of rows with the
    largest keys (ties: all of the last key) is selected, which draws without replacement in proportion to the weights.
    Null texts count as empty, null ids as unlabelled; repeated rows count each and have equal keys; an empty table gives no row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rest = F.coalesce(id_remainder(F.col("doc_id"), mod) == out, F.lit(False))
    good = labels.where((F.col(label_col) == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().where(~rest)
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    marked = rows.join(F.broadcast(good.withColumn("target", F.lit(True))), "doc_id", "left")
    ratios = log_ratios(*gram_counts(marked.select("text", F.coalesce("target", F.lit(False)).alias("target"))))
    uniform = (F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = rows.select("doc_id", rest.alias("held_out"), log_weight(F.col("text"), ratios).alias("s"), (-F.log(-F.log(uniform))).alias("gumbel"))
    scored = scored.select("doc_id", "held_out", F.col("s.w").alias("log_weight"), F.col("s.n").alias("n_grams"), "gumbel")
    scored = stored(scored.withColumn("gumbel_key", F.col("log_weight") + F.col("gumbel")).drop("gumbel"))
    n = scored.count()
    limit = kth_largest(scored, "gumbel_key", max(1, math.ceil(share * n))) if n else 0.0
    score = 1 / (1 + F.exp(-10 * F.col("log_weight") / F.greatest("n_grams", F.lit(1))))
    return scored.select("doc_id", "held_out", "log_weight", "n_grams", score.alias("score"), "gumbel_key", (F.col("gumbel_key") >= limit).alias("selected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
