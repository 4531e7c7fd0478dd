"""LM scoring (operator 8): a gated recurrent model with class-factored outputs over exact corpus counts.

Words are in one of three kinds.  The most frequent ones share softmax classes of CLASS_WORDS words.  Other frequent ones
("head", bounded in number) lie in classes by frequency, and all the rest ("rare") in classes by their form; within these
classes a word's probability follows from its count alone.  The recurrent state decides among classes, and among words of
softmax classes, so the model is a distribution over all words and one place for unknown ones.  Counts cover all training
texts; those of head words are sent to the workers, while rare words of texts meet their counts in a join.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.llm import gru
from readmill.llm.common import id_remainder, stored, table
from readmill.llm.gru import CLASS_WORDS, Tokens

#: Most head words, softmax classes, head classes without softmax, and input rows for words by their ends.
HEAD, SOFT_CLASSES, PLAIN_CLASSES, END_ROWS = 250_000, 16, 15, 512
#: Rounds of training, texts of a trainer in a round, and tokens that it lays out side by side.
ROUNDS, TRAINER_ROWS, TRAINER_TOKENS = 8, 1000, 2_000_000
#: Characters of texts scored side by side, and words counted in a task before their counts are sent on.
GROUP_CHARS, COUNTED = 6_000_000, 300_000
ALPHA = 0.1
END = b""


def words_of(text: str) -> list[bytes]:
    """Words between ASCII spaces, A-Z in lower case, as UTF-8."""
    return text.encode().lower().split()


def rare_class(word: bytes) -> int:
    """Which of four classes a rare word is in: not ASCII alone (2), ends with . or , (1)."""
    return 2 * (not word.isascii()) + (word[-1:] in b".,")


def rare_class_column(word: Column) -> Column:
    """The same for a column of strings."""
    return F.when(F.length(word) < F.octet_length(word), 2).otherwise(0) + F.when(F.right(word, F.lit(1)).isin(".", ","), 1).otherwise(0)


def word_counts(texts: DataFrame) -> DataFrame:
    """word, c over all texts of a table of one column; a task sends on partial counts when it has many words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                if len(seen) > COUNTED:
                    yield emit()
        yield emit()

    return texts.mapInArrow(count, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Head words with their counts in descending order (END among them), corpus totals, and mass and kinds of rare classes."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    kinds: int
    rare_tokens: np.ndarray
    rare_kinds: np.ndarray
    index: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        n, soft = len(self.words), SOFT_CLASSES * CLASS_WORDS
        self.index = {w: i for i, w in enumerate(self.words)}
        self.base_of = np.log10((self.counts + ALPHA) / self.total)
        self.rare_total = self.rare_tokens + ALPHA * (self.rare_kinds + 1)
        # softmax classes take words by rank; the others hold about equal shares of what is left
        left = np.cumsum(self.counts[soft:])
        plain = np.minimum((left - self.counts[soft:]) * PLAIN_CLASSES // max(1, left[-1] if len(left) else 1), PLAIN_CLASSES - 1).astype(np.int64)
        self.cls = np.concatenate([np.arange(min(n, soft)) // CLASS_WORDS, SOFT_CLASSES + plain]).astype(np.int16)
        self.place = np.where(np.arange(n) < soft, np.arange(n) % CLASS_WORDS, -1).astype(np.int16)
        mass = np.bincount(self.cls, self.counts + ALPHA, SOFT_CLASSES + PLAIN_CLASSES)
        self.inner = np.where(self.place < 0, np.log((self.counts + ALPHA) / mass[self.cls]), 0.0)
        self.class_logs = np.log(np.concatenate([mass, self.rare_total]) + 1e-9) - math.log(self.total)
        self.word_logs = np.full(soft, -1e9)
        self.word_logs[: min(n, soft)] = np.log(self.counts[:soft] + ALPHA)
        self.word_logs = self.word_logs.reshape(SOFT_CLASSES, CLASS_WORDS)
        self.word_logs -= np.log(np.maximum(np.exp(self.word_logs).sum(axis=1, keepdims=True), 1e-300))
        self.row = np.where(self.place >= 0, np.arange(n), soft + np.fromiter((self._ends(w) for w in self.words), np.int64, n)).astype(np.int32)

    @property
    def total(self) -> float:
        return self.tokens + ALPHA * (self.kinds + 1)

    @staticmethod
    def _ends(word: bytes) -> int:
        return zlib.crc32(word.rstrip(b".,")[-3:]) % END_ROWS

    def read(self, text: str) -> tuple[Tokens, list[bytes], np.ndarray]:
        """A text's tokens, its rare words, and the head numbers of the others."""
        words = words_of(text)
        words.append(END)
        head = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        out = Tokens(self.row[head], self.cls[head], self.place[head])
        at = np.flatnonzero(head < 0)
        rare = [words[i] for i in at.tolist()]
        if rare:
            out.row[at] = [SOFT_CLASSES * CLASS_WORDS + self._ends(w) for w in rare]
            out.cls[at] = [SOFT_CLASSES + PLAIN_CLASSES + rare_class(w) for w in rare]
            out.place[at] = -1
            head = head[head >= 0]
        return out, rare, head


def vocabulary(counts: DataFrame, n_ends: int) -> tuple[Vocabulary, int]:
    """The head (as many of the most frequent words as HEAD allows) and totals; and the least count of a head word.

    Eighths of powers of two of counts are tallied to find the least count, so the driver never gets more than HEAD words.
    """
    level = F.floor(F.log2("c") * 8).cast("int")
    tally = counts.groupBy(level.alias("level")).agg(F.count("*").alias("kinds"), F.sum("c").alias("tokens"), F.min("c").alias("least")).collect()
    size, least = 0, 1 << 62
    for r in sorted(tally, key=lambda r: -r["level"]):
        if size + r["kinds"] > HEAD:
            break
        size, least = size + r["kinds"], r["least"]
    got = counts.where(F.col("c") >= least).toArrow()
    words = [w.encode() for w in got["word"].to_pylist()]
    pairs = sorted([*zip((-c for c in got["c"].to_pylist()), words, strict=True), (-n_ends, END)])
    rare = counts.where(F.col("c") < least).groupBy(rare_class_column(F.col("word")).alias("k")).agg(F.count("*").alias("kinds"), F.sum("c").alias("tokens")).collect()
    rare_tokens, rare_kinds = np.zeros(4), np.zeros(4)
    for r in rare:
        rare_tokens[r["k"]], rare_kinds[r["k"]] = r["tokens"], r["kinds"]
    return Vocabulary([w for _, w in pairs], -np.array([c for c, _ in pairs], np.int64), sum(r["tokens"] for r in tally) + n_ends, sum(r["kinds"] for r in tally) + (n_ends > 0), rare_tokens, rare_kinds), least


def train(learned: DataFrame, sent, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters after ROUNDS rounds over all texts, each of which is in one round: in a round, every trainer passes over
    its share of that round's texts and the results are averaged by text.  There are as many trainers as there are texts
    for, so the work of one stays the same."""
    v: Vocabulary = sent.value
    p = gru.start(SOFT_CLASSES * CLASS_WORDS + END_ROWS, v.class_logs, v.word_logs, seed)
    names, shapes = list(p), [x.shape for x in p.values()]
    trainers = max(1, math.ceil(learned.count() / TRAINER_ROWS / ROUNDS))
    spark = learned.sparkSession
    dealt = stored(learned.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(ROUNDS)).cast("int").alias("round")), "round")
    for k in range(ROUNDS):
        now = spark.sparkContext.broadcast(p)

        def pass_over(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            p, texts, n, tokens, own = now.value, [], 0, 0, None

            def emit() -> pa.RecordBatch:
                flat = np.concatenate([x.ravel() for x in gru.train(p, texts).values()]).astype(np.float64)
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * n), pa.array(np.full(len(flat), n, np.int64))], ["k", "x", "n"])

            for b in batches:
                for trainer, t in zip(b.column("trainer").to_pylist(), b.column("text").to_pylist(), strict=True):
                    if n and trainer != own:
                        yield emit()
                        p, texts, n, tokens = now.value, [], 0, 0
                    own = trainer
                    texts.append(sent.value.read(t)[0])
                    n, tokens = n + 1, tokens + len(texts[-1].row)
                    if tokens >= TRAINER_TOKENS:
                        p, texts, tokens = gru.train(p, texts), [], 0
            if n:
                yield emit()

        part = dealt.where(F.col("round") == k).withColumn("trainer", F.pmod(F.xxhash64("doc_id", "text", F.lit(2)), F.lit(trainers)))
        part = part.repartition(trainers, "trainer").sortWithinPartitions("trainer", "doc_id", "text").select("trainer", "text")
        got = part.mapInArrow(pass_over, "k bigint, x double, n bigint").groupBy("k").agg((F.sum("x") / F.sum("n")).alias("x")).toArrow()
        if len(got):
            flat = np.empty(len(got), np.float32)
            flat[got["k"].to_numpy()] = got["x"].to_numpy()
            cuts = np.cumsum([math.prod(s) for s in shapes])[:-1]
            p = {n: x.reshape(s) for n, x, s in zip(names, np.split(flat, cuts), shapes, strict=True)}
    return p


PARTS = "row_id bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<string>"
ARROW = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.binary()))])


def scores(docs: DataFrame, mod: int = 10, out: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Texts are learned from unless their id's crc32 modulo `mod` is `out`; null texts count as empty (their end is a token),
    rows with a null id are learned from; repeated rows are counted and scored each; an empty table gives no row.
    Counts and the network's training cover all texts that are learned from.  base_score and score are log10 probabilities of the whole text.
    """
    spark = docs.sparkSession
    held = F.coalesce(id_remainder(F.col("doc_id"), mod) == out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    learned = rows.where(~F.col("held_out"))
    counts = stored(word_counts(learned.select("text")))
    v, least = vocabulary(counts, learned.count())
    sent = spark.sparkContext.broadcast(v)
    network = spark.sparkContext.broadcast(train(learned, sent))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, row_id = sent.value, TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        texts: list[Tokens] = []
        size = 0

        def emit() -> pa.RecordBatch:
            nonlocal size
            logs = gru.log_probabilities(network.value, texts) / math.log(10)
            columns = [list(c) for c in zip(*held, strict=True)]
            columns[6] = [a + b for a, b in zip(columns[6], logs.tolist(), strict=True)]
            texts.clear()
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns[:7], ARROW.types, strict=False)), pa.array(columns[7], pa.list_(pa.binary())).cast(pa.list_(pa.string()))], ["row_id", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])

        for batch in batches:
            for doc, held_out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens, rare, head = v.read(text)
                held.append((row_id, doc, held_out, len(tokens.row), int((v.counts[head] > 0).sum()), float(v.base_of[head].sum()), float(v.inner[head].sum()) / math.log(10), rare))
                texts.append(tokens)
                row_id += 1
                size += len(text)
                if size > GROUP_CHARS:
                    yield emit()
        if held:
            yield emit()

    parts = stored(rows.mapInArrow(score, PARTS))
    known = counts.where(F.col("c") < least)
    rare = parts.select("row_id", F.explode("rare").alias("word")).join(known, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    of_class = F.element_at(F.array(*map(F.lit, v.rare_total.tolist())), rare_class_column(F.col("word")) + 1)
    rare = rare.groupBy("row_id").agg(
        F.count_if(F.col("c") > 0).alias("rare_known"),
        F.sum(F.log10((F.col("c") + ALPHA) / F.lit(v.total))).alias("rare_base"),
        F.sum(F.log10((F.col("c") + ALPHA) / of_class)).alias("rare_score"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return parts.drop("rare").join(rare, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "rare_known").alias("n_known"), F.lit(v.tokens).cast("bigint").alias("train_tokens"),
        plus("base", "rare_base").alias("base_score"), plus("score", "rare_score").alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
