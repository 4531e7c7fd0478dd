"""Tokenizer encoding inside tasks: whole texts cut at safe boundaries, batches balanced by bytes.

A boundary is safe where the library would end a token whatever surrounds it.  For byte-level BPE (.json) that is
before a space that a non-space follows: the pre-tokenizer gives the space to the word after it; around a line feed
between two non-spaces, which is a token of its own; and between a letter and the signs at a word's end.  A .json file with
another pre-tokenizer or with a normalizer gets whole texts.  For sentencepiece models (.model) it is a space between two non-spaces, provided that no piece has the space mark inside it (checked
when the model is loaded); the mark that the library puts before a text then stands for that space.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np

from readmill.llm.common import by_bytes, claim

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters of a text that are handled at a time, and of unseen chunks that go to the library in one call.
SEGMENT_CHARS, BATCH_CHARS = 1 << 20, 1 << 18
#: Entries of a generation of a worker's memory of encoded chunks, and the longest chunk kept there.
MEMO_ENTRIES, MEMO_CHARS = 300_000, 64
#: Words that are encoded as one text, and what stands before a word there.
JOINED, WORD_STARTS = 2000, (" ", "\n")

#: What may be taken off a word's end.
TAILS = (".", ",")
#: Signs of which up to TAIL_CHARS may be taken off together, if no added token has them; letters that they may follow end here.
SIGNS, TAIL_CHARS, LETTERS_END = string.punctuation, 3, "\u0250"

BYTE_LEVEL = re.compile(r" (?=\S)")
#: Where a cut at every space would differ from a cut at the safe ones.
SPACES = re.compile(r" (?:\s|$)")
NOWHERE = re.compile(r"(?!)")
PIECES = re.compile(r"(?<=\S) (?=\S)")


def segments(text: str, boundary: re.Pattern, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """text without the spaces at its cuts, in parts that end at the first safe boundary after `size` characters."""
    start = 0
    while len(text) - start > size and (m := boundary.search(text, start + size)):
        yield text[start : m.start()]
        start = m.end()
    yield text[start:]


def lines_of(text: str) -> list[str]:
    """text cut at the line feeds that lie between two non-spaces."""
    out = text.split("\n")
    if len(out) > 1 and not all(x and not x[:1].isspace() and not x[-1:].isspace() for x in out):
        lines, out = out, out[:1]
        for x in lines[1:]:
            if x and out[-1] and not x[:1].isspace() and not out[-1][-1:].isspace():
                out.append(x)
            else:
                out[-1] += "\n" + x
    return out


def is_byte_level(tok: Any) -> bool:
    """Whether the library cuts texts where the module says, whatever its added tokens are."""
    from tokenizers import pre_tokenizers

    pre, added = tok.pre_tokenizer, tok.get_added_tokens_decoder().values()
    plain = isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space and tok.normalizer is None
    return plain and not any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() or c in TAILS for c in t.content) for t in added)


def byte_level_words(tok: Any, empty: Any, of_ids: Callable[[list[int]], Any], of_many: Callable[[np.ndarray, np.ndarray], list]) -> tuple[Callable[[list[str]], list], Callable[[list[str]], list]]:
    """Encoders of a batch of chunks and of one of words after a space: words are put one after another and encoded as one text, anything else by itself.

    A word after a space or a line feed, without white space in it, can stand beside others, as its boundaries are safe
    ones; its ids begin at the one that holds that space or line feed, of which no other id of the word has any.
    """
    begins = np.array([(tok.id_to_token(i) or "?")[0] in "ĠĊ" for i in range(tok.get_vocab_size())])

    def encode(texts: list[str]) -> list:
        words = [t for t in texts if t[:1] in WORD_STARTS and t.split() == [t[1:]]]
        out: dict[str, Any] = {"": empty}
        joined = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        for part, x in zip(joined, tok.encode_batch_fast(["".join(p) for p in joined], add_special_tokens=False), strict=True):
            ids = np.array(x.ids, "<u4")
            starts = np.flatnonzero(begins[ids])
            if len(starts) == len(part):
                out.update(zip(part, of_many(ids, starts), strict=True))
        rest = [t for t in texts if t not in out]
        out.update(zip(rest, (of_ids(x.ids) for x in tok.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        return [out[t] for t in texts]

    def encode_words(words: list[str]) -> list:
        """The same for words without what stands before them, each of which has a space before it."""
        out: list = []
        for part in (words[at : at + JOINED] for at in range(0, len(words), JOINED)):
            text = " " + " ".join(part)
            if text.split() == part:
                ids = np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                starts = np.flatnonzero(begins[ids])
                if len(starts) == len(part):
                    out += of_many(ids, starts)
                    continue
            out += encode([" " + w for w in part])
        return out

    return encode, encode_words


def bytes_of_each(ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Ids between starts as bytes."""
    data, cuts = ids.tobytes(), (starts * 4).tolist()
    return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]


def lengths_of_each(ids: np.ndarray, starts: np.ndarray) -> list[int]:
    """Numbers of ids between starts."""
    return np.diff(starts, append=len(ids)).tolist()


class ChunkEncoder:
    """Encodes texts chunk by chunk and remembers chunks, as few of a text's words are new.

    of: what is kept of a chunk: "length" (number of ids) or "ids" (little-endian unsigned 32-bit ids as bytes).
    The memory of encoded chunks is two generations of bounded size: when the new one is full it becomes the old one,
    and what is met again moves from the old one to the new one.
    """

    def __init__(self, path: str, of: str = "length") -> None:
        self.memo: dict[str, Any] = {}
        self.old: dict[str, Any] = {}
        self.tails: dict[str, Any] = {}
        self.signs, self.encode_words = "", None
        self.boundary, self.encode_batch = self._load(path, of)

    def _load(self, path: str, of: str) -> tuple[re.Pattern, Callable[[list[str]], list]]:
        keep = (lambda ids: array("I", ids).tobytes()) if of == "ids" else len
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            if any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.vocab_size())):
                raise ValueError("a piece has the space mark inside it, so texts can't be cut at spaces")
            return PIECES, lambda texts: [keep(x) for x in model.encode(texts, num_threads=1)]
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        if not is_byte_level(tok):
            return NOWHERE, lambda texts: [keep(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]
        added = "".join(t.content for t in tok.get_added_tokens_decoder().values())
        self.signs = "".join(c for c in SIGNS if c not in added)
        encode, self.encode_words = byte_level_words(tok, b"", keep, bytes_of_each) if of == "ids" else byte_level_words(tok, 0, len, lengths_of_each)
        return BYTE_LEVEL, encode

    def _cut(self, text: str, first: bool) -> list[str]:
        """Chunks of a segment; a byte-level chunk's key leaves out the space before it, but for a text's very first one."""
        if self.boundary is not BYTE_LEVEL:
            return self.boundary.split(text)
        out: list[str] = []
        for k, line in enumerate(lines_of(text)):
            chunks = BYTE_LEVEL.split(line) if SPACES.search(line) else line.split(" ")
            if k:
                chunks[0] = "\n" + chunks[0]
            elif first:
                chunks[0] = "\0" + chunks[0]
            out += chunks
        return out

    def _fill(self, chunks: set[str]) -> None:
        """Encode chunks not in memory, in bounded batches; a word with a tail is the word and its tail."""
        chunks = self._new(chunks)
        if self.encode_words is None:
            for batch in by_bytes(chunks, BATCH_CHARS):
                self.memo.update(zip(batch, self.encode_batch(batch), strict=True))
            return
        words, others, signs = set(), [], self.signs
        tailed, stems = [], []
        for c in chunks:
            if c[:1] <= " " or len(c) > MEMO_CHARS:
                others.append(c)
                continue
            stem = c.rstrip(signs)
            if len(stem) < len(c) <= len(stem) + TAIL_CHARS and (x := stem[-1:]).isalpha() and x < LETTERS_END:
                tailed.append(c)
                stems.append(stem)
            else:
                words.add(c)
        words = list(self._new(words.union(stems).difference(self.memo)))
        self.memo.update(zip(words, self.encode_words(words), strict=True))
        for batch in by_bytes(others, BATCH_CHARS):
            texts = [c if c[:1] == "\n" else c[1:] if c[:1] == "\0" else " " + c for c in batch]
            self.memo.update(zip(batch, self.encode_batch(texts), strict=True))
        memo, ends, tails = self.memo, self.tails, [c[len(stem) :] for c, stem in zip(tailed, stems, strict=True)]
        if new := list(set(tails).difference(ends)):
            ends.update(zip(new, self.encode_batch(new), strict=True))
        memo.update((c, memo[stem] + ends[tail]) for c, stem, tail in zip(tailed, stems, tails, strict=True))

    def _new(self, chunks: set[str]) -> set[str]:
        """Chunks that the old generation doesn't have; what it has moves to the new one."""
        if not self.old or not (known := chunks & self.old.keys()):
            return chunks
        self.memo.update((c, self.old[c]) for c in known)
        return chunks - known

    def forget(self) -> None:
        self.memo, self.old = {}, {}

    def parts(self, texts: list[str]) -> Iterator[tuple[int, list]]:
        """(index of the text, encoded parts in order), a text in several turns if it is long."""
        for group in self._groups(texts):
            claim(self)
            if len(self.memo) > MEMO_ENTRIES:
                self.memo, self.old = {}, self.memo
            found = [(i, self._cut(s, first)) for i, first, s in group]
            new = set().union(*(chunks for _, chunks in found)).difference(self.memo)
            self._fill(new)
            for i, chunks in found:
                yield i, list(map(self.memo.__getitem__, chunks))
            for c in new:
                if len(c) > MEMO_CHARS:
                    del self.memo[c]

    def _groups(self, texts: list[str]) -> Iterator[list[tuple[int, bool, str]]]:
        group: list[tuple[int, bool, str]] = []
        size = 0
        for i, text in enumerate(texts):
            for k, s in enumerate(segments(text or "", self.boundary)):
                if group and size + len(s) > SEGMENT_CHARS:
                    yield group
                    group, size = [], 0
                group.append((i, not k, s))
                size += len(s)
        if group:
            yield group

    def lengths(self, texts: list[str]) -> list[int]:
        """Number of ids of each text."""
        out = [0] * len(texts)
        for i, parts in self.parts(texts):
            out[i] += sum(parts)
        return out

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text in order, as bytes."""
        at, held = 0, []
        for i, parts in self.parts(texts):
            while at < i:
                yield b"".join(held)
                at, held = at + 1, []
            held.extend(parts)
        if texts:
            yield b"".join(held)


_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(path: str, of: str) -> ChunkEncoder:
    """This worker's encoder for a file; it lives as long as the worker."""
    if (path, of) not in _ENCODERS:
        _ENCODERS[path, of] = ChunkEncoder(path, of)
    return _ENCODERS[path, of]
