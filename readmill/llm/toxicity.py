"""Toxicity (operator 7): subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.llm.common import id_remainder, stored, table
from readmill.llm.words import WordTable, groups, ngram_buckets, segment_sums

#: Hash buckets (2**BITS) of subwords, sizes of character n-grams, width of an embedding.
BITS, SIZES, WIDTH = 17, (3, 4, 5), 8
#: Labelled rows that the model is fitted on: at most so many of each label, those with the smallest hashes of their ids;
#: and of these as many as have so many distinct subwords in all, which bounds what the driver gets (8 bytes each).
FIT_ROWS, FIT_SUBWORDS = 2500, 8_000_000
THRESHOLD = 0.7
#: Neutral subwords that every text is taken to have besides its own, so that a few odd words alone decide little.
PRIOR = 200
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def words_of(text: str) -> list[str]:
    """A text's distinct words, so that what it repeats counts once."""
    return list(dict.fromkeys(text.lower().split()))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of each subword; punctuation around a word is not part of it."""
    return ngram_buckets([EDGE.sub("", w) for w in words], SIZES, BITS)


@dataclass
class Model:
    """mean: weight of a subword's embedding along the softmax's difference, by bucket; scale and bias of the score."""

    weight: np.ndarray
    bias: float

    @cached_property
    def words(self) -> WordTable:
        """Sum of weights and number of subwords of each word."""

        def fill(words: list[str]) -> np.ndarray:
            w, b = word_features(words)
            return np.stack([np.bincount(w, self.weight[b], len(words)), np.bincount(w, minlength=len(words))], axis=1)

        return WordTable(fill)

    def scores(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(sums[:, 0] / (sums[:, 1] + PRIOR) + self.bias, -50, 50)))


def bag(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each text's subwords with their shares of all of them and PRIOR."""
    for t in texts:
        _, b = word_features(words_of(t))
        buckets, share = np.unique(b, return_counts=True)
        yield buckets.astype(np.int32), (share / (share.sum() + PRIOR)).astype(np.float32)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7, **options) -> Model:
    """A model of four fifths of the rows, whose scores are then scaled and shifted to suit the last fifth."""
    order = np.random.default_rng(seed).permutation(len(bags))
    cut = len(order) - len(order) // 5
    model = train([bags[i] for i in order[:cut]], labels[order[:cut]], seed=seed, **options)
    kept = order[cut:]
    logits = np.array([model.weight[bags[i][0]] @ bags[i][1] for i in kept]) + model.bias
    n_pos, n_neg = int(labels[kept].sum()), int((1 - labels[kept]).sum())
    if not n_pos or not n_neg or not model.weight.any():
        return model
    aim = np.where(labels[kept] == 1, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    x, w = np.stack([logits, np.ones(len(logits))], axis=1), np.array([1.0, 0.0])
    for _ in range(100):  # Newton steps, held near scale 1 and shift 0 by a small weight
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - aim) + 0.1 * (w - [1, 0])
        w = w - 0.5 * np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), slope)
    if w[0] <= 0:
        return model
    return Model((model.weight * w[0]).astype(np.float32), float(model.bias * w[0] + w[1]))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 4.0, seed: int = 7) -> Model:
    """Embeddings and softmax by AdaGrad on the cross entropy, classes weighted alike; one class alone gives a flat model."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    out = rng.normal(0, 1, WIDTH).astype(np.float32)  # the softmax of two classes: only the difference of their rows counts
    bias = 0.0
    n_pos = int(labels.sum())
    if not 0 < n_pos < len(labels):
        return Model(np.zeros(1 << BITS, np.float32), -4.0)
    cost = np.where(labels == 1, len(labels) / (2 * n_pos), len(labels) / (2 * (len(labels) - n_pos)))
    g_emb, g_out, g_bias = np.full(emb.shape, 1e-8, np.float32), np.full(WIDTH, 1e-8, np.float32), 1e-8
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            sizes = np.array([len(bags[i][0]) for i in part])
            idx, val = np.concatenate([bags[i][0] for i in part]), np.concatenate([bags[i][1] for i in part])
            mean = segment_sums(emb[idx] * val[:, None], sizes)
            p = 1 / (1 + np.exp(-np.clip(mean @ out + bias, -30, 30)))
            err = (p - labels[part]) * cost[part] / len(part)
            d_out, d_bias = (err @ mean).astype(np.float32), float(err.sum())
            # an embedding's slope is a number, the sum of its documents' errors times shares, along `out`
            used, where = np.unique(idx, return_inverse=True)
            slope = np.bincount(where, np.repeat(err, sizes) * val).astype(np.float32)
            d_emb = slope[:, None] * out
            g_emb[used] += d_emb**2
            emb[used] -= step * d_emb / np.sqrt(g_emb[used])
            g_out += d_out**2
            out -= 0.1 * step * d_out / np.sqrt(g_out)
            g_bias += d_bias**2
            bias -= 0.1 * step * d_bias / np.sqrt(g_bias)
    return Model((emb @ out).astype(np.float32), float(bias))


BAGS = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("buckets", pa.list_(pa.int32())), ("shares", pa.list_(pa.float32()))])


def fit_on(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, fit_subwords: int = FIT_SUBWORDS) -> Model:
    """Model of labelled rows whose id isn't held out, at most fit_rows of each label (the smallest hashes of ids).

    The bound on labelled rows bounds what is broadcast (ids and labels).  Their hashed bags are written to the shared
    folder; the driver takes them label by turns in order of the hashes, as long as they have fit_subwords entries in all
    (a bag that would go beyond that is left out).  An id with labels of both kinds counts as labelled 1, and of
    several texts of one id the least is taken.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out)
    first = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for k in (0, 1)]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(first[0].unionByName(first[1])), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, toxic = batch.column("doc_id"), batch.column("text").to_pylist(), batch.column("toxic")
            for at in range(0, len(texts), 64):
                b = list(bag(texts[at : at + 64]))
                yield pa.RecordBatch.from_arrays([ids[at : at + 64], toxic[at : at + 64], pa.array([x for x, _ in b], pa.list_(pa.int32())), pa.array([x for _, x in b], pa.list_(pa.float32()))], schema=BAGS)

    made = stored(rows.select("doc_id", "text", "toxic").mapInArrow(bags, "doc_id bigint, toxic int, buckets array<int>, shares array<float>"))
    sizes = made.select("doc_id", "toxic", F.size("buckets").alias("n"), F.xxhash64("doc_id").alias("h")).collect()  # 2 fit_rows rows at most
    turn: dict[int, int] = {0: 0, 1: 0}
    queue = []
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        queue.append((turn[r["toxic"]], r["toxic"], r["doc_id"], r["n"]))
        turn[r["toxic"]] += 1
    taken, left = [], fit_subwords
    for _, _, doc_id, n in sorted(queue):
        if n <= left:
            taken.append((doc_id,))
            left -= n
    chosen = docs.sparkSession.createDataFrame(taken, "doc_id bigint")
    got = made.join(F.broadcast(chosen), "doc_id", "left_semi").toArrow()
    pairs = [(b.values.to_numpy(), s.values.to_numpy()) for b, s in zip(got["buckets"], got["shares"], strict=True)]  # views, no copies
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    return fit([pairs[i] for i in order], got["toxic"].to_numpy()[order])


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 for a text column; null and empty texts get the score of no words."""
    spark = SparkSession.getActiveSession()
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = sent.value.words
        for texts in batches:
            got = [sent.value.scores(words.sums([words_of(t) for t in g])) for g in groups(pc.fill_null(texts, "").to_pylist())]
            yield pa.array(np.concatenate(got) if got else [], pa.float64())

    return toxic(text.cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 3, out: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; ids whose crc32 modulo `mod` is `out` are held out of the fit.

    Null texts count as empty, null ids are not held out and have no label, repeated rows are scored each, repeated labels
    of an id count as the largest.  Without both
    labels among the fitted rows every score is low.  An empty table gives no row.
    """
    rest = id_remainder(F.col("doc_id"), mod) == out
    model = fit_on(docs, labels, rest)
    scored = docs.select("doc_id", F.coalesce(rest, F.lit(False)).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
