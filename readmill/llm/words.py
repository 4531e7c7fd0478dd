"""A worker's memory of values by word, and hashed character n-grams of many words at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

from readmill.llm.common import claim

#: Words that a worker remembers before its memory starts afresh; characters of texts handled at a time.
MEMO_WORDS, GROUP_CHARS = 400_000, 1 << 21


class WordTable:
    """Values of words as rows of a matrix, computed for many new words at once; bounded, and then started afresh."""

    def __init__(self, fill: Callable[[list[str]], np.ndarray]) -> None:
        self.fill = fill
        self.index: dict[str, int] = {}
        self.values: np.ndarray = fill([])
        self.used = 0

    def forget(self) -> None:
        self.index, self.values, self.used = {}, self.fill([]), 0

    def rows(self, docs: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers in `values` of all words of all docs one after another, and how many words each doc has."""
        claim(self)
        if self.used > MEMO_WORDS:
            self.index, self.used = {}, 0
        get, found, new = self.index.get, [], set()
        for words in docs:
            got = list(map(get, words))
            if None in got:
                new.update(w for w, g in zip(words, got, strict=True) if g is None)
            found.append(got)
        if new:
            words = list(new)
            got = self.fill(words)
            if self.used + len(words) > len(self.values):
                grown = np.empty((max(2 * len(self.values), self.used + len(words)), *got.shape[1:]), got.dtype)
                grown[: self.used] = self.values[: self.used]
                self.values = grown
            self.values[self.used : self.used + len(words)] = got
            self.index.update(zip(words, range(self.used, self.used + len(words)), strict=True))
            self.used += len(words)
            get = self.index.__getitem__
            found = [[get(w) if g is None else g for w, g in zip(words, got, strict=True)] if None in got else got for words, got in zip(docs, found, strict=True)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        out = np.empty(int(sizes.sum()), np.int64)
        at = 0
        for got in found:
            out[at : at + len(got)] = got
            at += len(got)
        return out, sizes

    def sums(self, docs: list[list]) -> np.ndarray:
        """Sum of the values of each doc's words, a row a doc."""
        rows, sizes = self.rows(docs)
        return segment_sums(self.values[rows], sizes)


def segment_sums(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows, of the given sizes (0 too), in double precision."""
    out = np.zeros((len(sizes), *x.shape[1:]), np.float64)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(x, (np.cumsum(sizes) - sizes)[full], axis=0, dtype=np.float64)
    return out


def groups(texts: list[str], most: int = GROUP_CHARS) -> Iterable[list[str]]:
    """texts in groups of about `most` characters."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield texts[at:]


def ngram_buckets(words: list[str], sizes: Iterable[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every character n-gram of <word> of the given sizes and of each whole word, hashed to 2**bits buckets."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lens)
    word = np.repeat(np.arange(len(words)), lens)
    left = np.repeat(ends, lens) - np.arange(len(chars))  # characters from here to the word's end
    mixed = (chars + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    out_w, out_b = [np.arange(len(words))], []
    total = np.add.reduceat(mixed * (np.repeat(lens, lens) - left + 1).astype(np.uint64) ** np.uint64(3), ends - lens)
    out_b.append(total * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits))
    h = np.zeros(len(chars), np.uint64)
    for n in range(1, max(sizes) + 1):
        h = h[: len(chars) - n + 1] * np.uint64(0x100000001B3) + mixed[n - 1 :]
        if n in sizes:
            ok = left[: len(h)] >= n
            out_w.append(word[: len(h)][ok])
            out_b.append((h[ok] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits))
    return np.concatenate(out_w), np.concatenate(out_b).astype(np.int64)
