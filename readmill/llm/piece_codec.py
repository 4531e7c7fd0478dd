"""SentencePiece encoding and decoding (operator 1) by suffix-array matching of whole batches.

New chunks of a batch of texts are put one after another, their suffixes sorted as far as the longest piece, and every
piece of the vocabulary is found by two binary searches; each occurrence is an edge (position, length, piece).  Sorted by
position, the edges are all that relaxation needs.  The models given here are BPE models, whose result is not the path of
the greatest score but what repeated best merges give, so relaxing means: of a chunk's neighbouring symbols that an edge
spans together, the edge of the best score (the leftmost of ties) joins its two, until none is left.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.llm.common import by_bytes, claim, table
from readmill.llm.tokens import MEMO_CHARS, MEMO_ENTRIES, segments

SPACE = "▁"
#: Where a text may be cut: at a single space between others, and before a line feed, of which no piece has any.
CUT = re.compile(r"(?<=\S) (?=\S)|(?=\n)")
#: Characters of texts handled together, and of chunks indexed together (longer chunks are indexed in overlapping slices).
GROUP_CHARS, INDEX_CHARS = 1 << 20, 1 << 18
#: Characters of a stretch that relaxes in step with others; a longer one has a queue of its own edges.
IN_STEP = 128


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece.sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, model.SentencePiece
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only models that leave texts as they are, with a space put before, are supported")
        normal = [i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        if any(SPACE in model.pieces[i].piece.lstrip(SPACE) or "\n" in model.pieces[i].piece for i in normal):
            raise ValueError("a piece crosses a place where texts are cut")
        self.byte_ids = [0] * 256
        self.decoded = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.decoded[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type != kinds.CONTROL:
                self.decoded[i] = p.piece.replace(SPACE, " ").encode()
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self._index_pieces([(model.pieces[i].piece, i, model.pieces[i].score) for i in normal])

    # -- the vocabulary as packed keys

    def _index_pieces(self, pieces: list[tuple[str, int, float]]) -> None:
        self.depth = max(len(p) for p, _, _ in pieces)
        letters = sorted({c for p, _, _ in pieces for c in p})
        self.bits = len(letters).bit_length()
        self.per_key = 63 // self.bits
        self.keys = -(-self.depth // self.per_key)
        self.letter = np.zeros(0x110001, np.uint64)  # 0: in no piece, and between chunks
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        # best scores first: a merge's order of preference is a piece's place in this order
        pieces = sorted(pieces, key=lambda p: (-p[2], p[1]))
        self.piece_id = np.array([i for _, i, _ in pieces], np.int64)
        self.piece_len = np.array([len(p) for p, _, _ in pieces], np.int64)
        self.rank = {p: k for k, (p, _, _) in enumerate(pieces)}
        flat = np.zeros((len(pieces), self.keys * self.per_key), np.uint64)
        for k, (p, _, _) in enumerate(pieces):
            flat[k, : len(p)] = self.letter[[ord(c) for c in p]]
        self.low = self._packed(flat)
        flat[np.arange(flat.shape[1]) >= self.piece_len[:, None]] = (1 << self.bits) - 1
        self.high = self._packed(flat)

    def _packed(self, letters: np.ndarray) -> np.ndarray:
        """Keys of rows of letters: per_key letters in each of `keys` numbers, the first ones weighing most."""
        out = np.zeros((self.keys, len(letters)), np.uint64)
        for k in range(self.keys):
            for j in range(self.per_key):
                out[k] = out[k] << np.uint64(self.bits) | letters[:, k * self.per_key + j]
        return out

    # -- edges of a batch

    def suffixes(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the order of their suffixes as far as `depth`, and the suffixes' keys in that order."""
        n, span = len(letters), self.per_key
        padded = np.concatenate([letters, np.zeros(self.keys * span, np.uint64)])
        one = np.zeros(n + self.keys * span - span + 1, np.uint64)
        for j in range(span):
            one = one << np.uint64(self.bits) | padded[j : j + len(one)]
        keys = np.stack([one[k * span : k * span + n] for k in range(self.keys)])
        starts = np.flatnonzero(letters)
        order = starts[np.lexsort(keys[::-1, starts])]
        return order, keys[:, order]

    @staticmethod
    def _bisect(keys: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
        """For each wanted key the first place in sorted keys that isn't smaller (after: that is larger)."""
        lo, hi = np.zeros(wanted.shape[1], np.int64), np.full(wanted.shape[1], keys.shape[1], np.int64)
        while (open_ := lo < hi).any():
            mid = np.where(open_, (lo + hi) // 2, 0)
            at = keys[:, mid]
            less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for k in range(len(keys)):
                less |= same & (at[k] < wanted[k])
                same &= at[k] == wanted[k]
            right = open_ & (less | same if after else less)
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return lo

    def edges(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, number of the piece) of every occurrence of every piece, by position.

        Slices overlap by one letter less than the longest piece has, and each gives the edges that begin in it.
        """
        found = [self._slice_edges(letters[at : at + INDEX_CHARS + self.depth - 1], at) for at in range(0, len(letters), INDEX_CHARS)]
        where, piece = ([x[k] for x in found] for k in (0, 1))
        return np.concatenate([np.empty(0, np.int64), *where]), np.concatenate([np.empty(0, np.int64), *piece])

    def _slice_edges(self, letters: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
        order, keys = self.suffixes(letters)
        if not len(order):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lo, hi = self._bisect(keys, self.low, False), self._bisect(keys, self.high, True)
        n = hi - lo
        piece = np.repeat(np.arange(len(n)), n)
        where = order[np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        where, piece = where[own := where < INDEX_CHARS], piece[own]
        by = np.argsort(where, kind="stable")
        return where[by] + offset, piece[by]

    # -- relaxation

    def _relax(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks (with space marks) by best merges.

        A place that no edge goes over is a boundary whatever is merged, so a chunk is relaxed in the stretches between
        such places: short stretches one merge a stretch and round, all of them at once, and long ones by a queue.
        """
        if not chunks:
            return []
        chars = np.frombuffer("\0".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").copy()
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(lens + 1) - lens - 1
        letters = self.letter[chars]
        letters[starts[1:] - 1] = 0
        where, piece = self.edges(letters)
        none = np.int32(len(self.piece_id))
        spanned = np.full((len(chars) + 1, self.depth + 1), none, np.int32)  # best piece by position and length
        spanned[where, self.piece_len[piece]] = piece
        over = np.bincount(where + 1, minlength=len(chars) + 2) - np.bincount(where + self.piece_len[piece], minlength=len(chars) + 2)
        at = np.delete(np.arange(len(chars)), starts[1:] - 1)
        begins = np.cumsum(over)[at] == 0  # no edge goes over the place before this character
        begins[np.searchsorted(at, starts[lens > 0])] = True
        owner, size = np.cumsum(begins), np.ones(len(at), np.int64)
        done_at, done_size, sizes = [], [], np.bincount(owner)
        if len(long := np.flatnonzero(sizes > IN_STEP)):
            for a, n in zip(at[begins][long - 1].tolist(), sizes[long].tolist(), strict=True):
                got = self._merged(spanned, a, a + n)
                done_at.append(np.array(got[0], np.int64))
                done_size.append(np.array(got[1], np.int64))
            short = sizes[owner] <= IN_STEP
            at, owner, size = at[short], owner[short], size[short]
        while len(at):
            both = size[:-1] + size[1:]
            best = np.full(len(at), none, np.int32)
            ok = (owner[:-1] == owner[1:]) & (both <= self.depth)
            best[:-1][ok] = spanned[at[:-1][ok], both[ok]]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(best, first)
            counts = np.diff(np.r_[first, len(at)])
            going = np.repeat(low < none, counts)
            if not going.all():
                done_at.append(at[~going])
                done_size.append(size[~going])
            hit = going & (best == np.repeat(low, counts))
            places = np.flatnonzero(hit)
            places = places[np.r_[True, owner[places[1:]] != owner[places[:-1]]]] if len(places) else places  # leftmost
            size[places] += size[places + 1]
            going[places + 1] = False
            at, owner, size = at[going], owner[going], size[going]
        at, size = np.concatenate(done_at or [at]), np.concatenate(done_size or [size])
        by = np.argsort(at, kind="stable")
        at, size = at[by], size[by]
        found = spanned[at, size]
        ids = np.append(self.piece_id, -1)[found]
        out, cuts = [], np.searchsorted(at, starts)
        known = (ids >= 0).astype(np.int64)
        clean = np.add.reduceat(known, cuts) == np.diff(np.r_[cuts, len(at)]) if len(cuts) else []
        data = ids.astype("<u4")
        for k, (a, b) in enumerate(zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True)):
            if clean[k]:
                out.append(data[a:b].tobytes())
            else:
                part = array("I")
                for i, p in zip(ids[a:b].tolist(), at[a:b].tolist(), strict=True):
                    part.extend([i] if i >= 0 else [self.byte_ids[x] for x in chr(chars[p]).encode()])
                out.append(part.tobytes())
        return out

    def _merged(self, spanned: np.ndarray, first: int, stop: int) -> tuple[list[int], list[int]]:
        """(positions, sizes) of the symbols of one long stretch, whose edges wait in a queue, best (then leftmost) first."""
        n, none, table = stop - first, len(self.piece_id), spanned[first:stop]
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and end[j] - i <= self.depth and (r := int(table[i, end[j] - i])) < none:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, to = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[i] == to or end[end[i]] != to:
                continue
            alive[end[i]] = False
            end[i] = to
            if to < n:
                prev[to] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        left = [i for i in range(n) if alive[i]]
        return [first + i for i in left], [end[i] - i for i in left]

    # -- texts

    def _fill(self, chunks: set[str]) -> None:
        known = chunks & self.old.keys() if self.old else set()
        self.memo.update((c, self.old[c]) for c in known)
        for batch in by_bytes(chunks - known, INDEX_CHARS):
            marked = [c if c[:1] == "\n" else SPACE + c for c in (c.replace(" ", SPACE) for c in batch)]
            done = self._relax(marked) if len(marked) > 1 or len(marked[0]) <= INDEX_CHARS else [b"".join(x for part in self._parts(marked[0]) for x in self._relax([part]))]
            self.memo.update(zip(batch, done, strict=True))

    def _parts(self, chunk: str) -> Iterator[str]:
        """A long chunk in parts of about INDEX_CHARS characters, cut where no edge goes over, so that each relaxes by itself.

        Memory is that of a part, not of the chunk; only where edges overlap for longer is a part as long as that stretch.
        """
        begin, reach = 0, self.depth - 1
        for at in range(0, len(chunk), INDEX_CHARS):
            low = max(0, at - reach)  # edges that begin before these places may go over them
            window = chunk[low : at + INDEX_CHARS + reach]
            letters = self.letter[np.frombuffer(window.encode("utf-32-le", "surrogatepass"), "<u4")]
            where, piece = self.edges(letters)
            over = np.bincount(where + 1, minlength=len(window) + 2) - np.bincount(where + self.piece_len[piece], minlength=len(window) + 2)
            free = np.flatnonzero(np.cumsum(over)[at - low : at - low + min(INDEX_CHARS, len(chunk) - at)] == 0) + at
            while len(free := free[free >= begin + INDEX_CHARS]):
                yield chunk[begin : int(free[0])]
                begin = int(free[0])
        yield chunk[begin:]

    def forget(self) -> None:
        self.memo, self.old = {}, {}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for group in by_bytes(texts, GROUP_CHARS):
            claim(self)
            if len(self.memo) > MEMO_ENTRIES:
                self.memo, self.old = {}, self.memo
            split = []
            for text in group:
                chunks: list[str] = []
                for k, s in enumerate(segments(text, CUT)):
                    part = CUT.split(s)
                    chunks += part[1:] if k and not part[0] else part
                split.append(chunks if text else [])
            new = {c for chunks in split for c in chunks if c not in self.memo}
            self._fill(new)
            for chunks in split:
                yield b"".join(map(self.memo.__getitem__, chunks))
            for c in new:
                if len(c) > MEMO_CHARS:
                    del self.memo[c]

    def decode(self, ids: bytes) -> str:
        """Text of ids: pieces with spaces for marks, without the one put before the text; bytes that aren't UTF-8 become U+FFFD."""
        out = b"".join(map(self.decoded.__getitem__, memoryview(ids).cast("I")))
        return (out[1:] if out[:1] == b" " else out).decode(errors="replace")


@cache
def codec(path: str) -> Codec:
    """This worker's codec of a file."""
    return Codec(path)


def encode(text: Column, model: str) -> Column:
    """Piece ids of a text column (array of ints); null texts give no ids."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = list(codec(model).encode(pc.fill_null(texts, "").to_pylist()))
            offsets = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))

    return ids(text.cast("string"))


def decode(ids: Column, model: str) -> Column:
    """Text of a column of arrays of piece ids; null gives an empty text."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.array([codec(model).decode(array("I", x or []).tobytes()) for x in lists.to_pylist()], pa.string())

    return texts(ids.cast("array<int>"))


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids_crc32, decoded_sha256, same (decoded text equals the text) for every row.

    Null texts count as empty and have no pieces; `same` is false only where a text has the space mark itself, which
    reads back as a space.  Null ids stay null, repeated rows give repeated rows, an empty table an empty one.
    """
    import hashlib

    @F.arrow_udf("n_chars bigint, n_pieces bigint, ids_crc32 bigint, decoded_sha256 string, same boolean")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            plain = pc.fill_null(texts, "").to_pylist()
            for text, ids in zip(plain, codec(model).encode(plain), strict=True):
                back = codec(model).decode(ids)
                rows.append((len(text), len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == text))
            kinds = {"n_chars": pa.int64(), "n_pieces": pa.int64(), "ids_crc32": pa.int64(), "decoded_sha256": pa.string(), "same": pa.bool_()}
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    return docs.select("doc_id", both(F.col("text").cast("string")).alias("r")).select("doc_id", "r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
