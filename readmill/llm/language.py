"""Language ID (operator 3): unigrams over a fixed public vocabulary, summed over all segmentations of each word."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.llm.common import id_remainder, table
from readmill.llm.words import WordTable, groups

#: Characters of a word that are segmented together (longer words are cut), and probability of a character without a piece.
SPAN, UNKNOWN = 32, 1e-7
#: Labelled rows of each language, about, that the piece probabilities are estimated from: those with the smallest hashes of their ids.
FIT_ROWS = 2500
MIX, SLOTS = np.uint64(0x9E3779B97F4A7C15), 18


class Pieces:
    """The vocabulary as a table of hashes: pieces, and beginnings of pieces so that a search can end early."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        texts = list(dict.fromkeys(model.id_to_piece(i).lower() for i in ids))
        self.prior = np.array([1 / (k + 50) for k in range(len(texts))])  # pieces come in order of their frequency
        self.prior /= self.prior.sum()
        number = {t: k for k, t in enumerate(texts)}
        entries = dict.fromkeys((t[:n] for t in texts for n in range(1, len(t))), -2) | number
        self.most = max(map(len, texts))
        hashes = np.array([self._hash(t) for t in entries], np.uint64)
        values = np.fromiter(entries.values(), np.int64, len(entries))
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        while len(hashes):  # what meets a taken slot goes to another table, dealt by other bits
            slot = self._slot(hashes, len(self.tables))
            _, first = np.unique(slot, return_index=True)
            keys, vals = np.zeros(1 << SLOTS, np.uint64), np.full(1 << SLOTS, -1, np.int32)
            keys[slot[first]], vals[slot[first]] = hashes[first], values[first]
            self.tables.append((keys, vals))
            rest = np.ones(len(hashes), bool)
            rest[first] = False
            hashes, values = hashes[rest], values[rest]

    @staticmethod
    def _slot(h: np.ndarray, k: int) -> np.ndarray:
        return (h * (MIX + np.uint64(2 * k)) >> np.uint64(64 - SLOTS)).astype(np.int64)

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h ^ ord(c)) * 0x100000001B3 & (1 << 64) - 1
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece number, -2 (only the beginning of a piece) or -1."""
        out = np.full(len(h), -1, np.int64)
        for k, (keys, vals) in enumerate(self.tables):
            slot = self._slot(h, k)
            hit = keys[slot] == h
            out[hit] = vals[slot[hit]]
        return out

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, piece) of every occurrence of a piece, by end, and the words' lengths; piece -1: unknown character."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lens)
        place = np.arange(len(chars)) - np.repeat(np.cumsum(lens) - lens, lens)
        at, h, out = np.arange(len(chars)), np.zeros(len(chars), np.uint64), []
        for n in range(1, self.most + 1):
            ok = place[at] + n <= lens[word[at]]
            at, h = at[ok], h[ok]
            h = (h ^ chars[at + n - 1]) * np.uint64(0x100000001B3)
            got = self.find(h)
            if n == 1:
                got[got < -1] = -1
            take = got >= 0 if n > 1 else np.ones(len(at), bool)
            out.append((word[at][take], place[at][take], place[at][take] + n, got[take]))
            if n > 1:
                alive = got != -1
                at, h = at[alive], h[alive]
        w, s, e, p = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(e, kind="stable")
        return w[order], s[order], e[order], p[order], lens


@cache
def pieces(path: str) -> Pieces:
    """This worker's vocabulary; it lives as long as the worker."""
    return Pieces(path)


def forward(edges: tuple, prob: np.ndarray) -> np.ndarray:
    """alpha[word, place, language]: sum over segmentations of the first `place` characters of the products of prob[piece, language]."""
    w, s, e, p, lens = edges
    alpha = np.zeros((len(lens), (int(lens.max()) if len(lens) else 0) + 1, prob.shape[1]))
    alpha[:, 0] = 1
    cuts = np.searchsorted(e, np.arange(alpha.shape[1] + 1))
    for end in range(1, alpha.shape[1]):
        part = slice(cuts[end], cuts[end + 1])
        ways = alpha[w[part], s[part]] * prob[p[part]]
        for k in range(prob.shape[1]):
            alpha[:, end, k] = np.bincount(w[part], ways[:, k], len(lens))
    return alpha


def backward(edges: tuple, prob: np.ndarray) -> np.ndarray:
    """beta[word, place]: the same for what follows a place, for one distribution."""
    w, s, e, p, lens = edges
    beta = np.zeros((len(lens), (int(lens.max()) if len(lens) else 0) + 1))
    beta[np.arange(len(lens)), lens] = 1
    order = np.argsort(-s, kind="stable")
    w, s, e, p = w[order], s[order], e[order], p[order]
    cuts = np.searchsorted(-s, np.arange(-beta.shape[1], 2))
    for start in range(beta.shape[1] - 1, -1, -1):
        part = slice(cuts[beta.shape[1] - start], cuts[beta.shape[1] - start + 1])
        beta[:, start] += np.bincount(w[part], beta[w[part], e[part]] * prob[p[part]], len(lens))
    return beta


def words_of(text: str) -> list[str]:
    """Lower-case words, each with the mark of a beginning; cut at SPAN characters."""
    out = ["▁" + w for w in text.lower().split()]
    return [w[i : i + SPAN] for w in out for i in range(0, len(w), SPAN)] if any(len(w) > SPAN for w in out) else out


def expected_counts(vocabulary: Pieces, counts: dict[str, int]) -> np.ndarray:
    """Expected number of times each piece is used in words, over all segmentations under the vocabulary's prior."""
    prob = np.append(vocabulary.prior, UNKNOWN)
    edges = w, s, e, p, lens = vocabulary.edges(list(counts))
    alpha, beta = forward(edges, prob[:, None])[:, :, 0], backward(edges, prob)
    share = alpha[w, s] * prob[p] * beta[w, e] / beta[w, 0]
    return np.bincount(p[p >= 0], (share * np.fromiter(counts.values(), np.float64, len(counts))[w])[p >= 0], len(vocabulary.prior))


@dataclass
class Model:
    """Piece probabilities, a column a language; the last row is an unknown character's."""

    path: str
    languages: list[str]
    prob: np.ndarray

    @cached_property
    def words(self) -> WordTable:
        """log probability of each word in each language."""
        vocabulary = pieces(self.path)

        def fill(words: list[str]) -> np.ndarray:
            out = np.zeros((len(words), len(self.languages)), np.float32)
            for at in range(0, len(words), 20_000):
                edges = vocabulary.edges(words[at : at + 20_000])
                out[at : at + 20_000] = np.log(np.maximum(forward(edges, self.prob)[np.arange(len(edges[4])), edges[4]], 1e-300))
            return out

        return WordTable(fill)


PREDICTED = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def fit_on(docs: DataFrame, held_out: Column, path: str, fit_rows: int = FIT_ROWS) -> Model:
    """Piece probabilities of each language among rows with text and lang that aren't held out.

    Of a language's rows those are taken whose id has a hash below a share of all hashes, so that about fit_rows are taken
    of each language, or all if it has fewer, without a sort.  The driver gets numbers of rows by language, and counts by
    piece and language, bounded by the vocabulary.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out)
    rows = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    many = {r["lang"]: fit_rows / r["count"] for r in rows.groupBy("lang").count().collect() if r["count"] > fit_rows}
    if many:
        share = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in many.items() for x in kv)), F.col("lang")), F.lit(1.0))
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) < share * (1 << 52))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, words = pieces(path), {}

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, counts in words.items():
                found = expected_counts(vocabulary, counts)
                used = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used), pa.array(found[used])], ["lang", "piece", "n"])
            words.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, words.values())) > 50_000:
                    yield from emit()
        yield from emit()

    found = rows.select("text", "lang").mapInArrow(count, "lang string, piece bigint, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(found["lang"].to_pylist()))
    size = len(pieces(path).prior)
    n = np.zeros((size, len(languages)))
    n[found["piece"].to_numpy(), np.searchsorted(languages, found["lang"].to_pylist()) if languages else []] = found["n"].to_numpy()
    shared = n.sum(axis=1) + pieces(path).prior
    prob = (n + 20 * (shared / shared.sum())[:, None] + 1e-3 * pieces(path).prior[:, None]) / (n.sum(axis=0) + 20 + 1e-3)
    return Model(path, languages, np.vstack([prob, np.full(len(languages), UNKNOWN)]))


def predict(text: Column, model: Model) -> Column:
    """Struct of lang_pred and score (share of the best language's likelihood); `und` and 0 without a letter."""
    sent = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        words = model.words
        for texts in batches:
            langs, scores = [], []
            for group in groups(pc.fill_null(texts, "").to_pylist()):
                logs = words.sums([words_of(t) for t in group])
                for t, row in zip(group, logs, strict=True):
                    if not model.languages or not any(map(str.isalpha, t)):
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    best = int(row.argmax())
                    langs.append(model.languages[best])
                    scores.append(float(1 / np.exp(np.maximum(row - row[best], -700)).sum()))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(PREDICTED))

    return language(text.cast("string"))


def languages(docs: DataFrame, path: str, mod: int = 4, out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; ids whose crc32 modulo `mod` is `out` are held out of the fit.

    Null texts and texts without a letter are `und`; null ids are not held out and are not learned from; ties go to the
    first language in order; repeated rows are scored each; without a labelled row all are `und`; an empty table gives no row.
    """
    rest = id_remainder(F.col("doc_id"), mod) == out
    model = fit_on(docs, rest, path)
    return docs.select("doc_id", F.coalesce(rest, F.lit(False)).alias("held_out"), predict(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return languages(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
