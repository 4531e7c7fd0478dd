"""Packing (operator 2): sum-of-squares online packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.llm.common import stored, table
from readmill.llm.tokens import encoder

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])
#: Fill levels of a window, and tasks whose last open windows are packed together by one task.
LEVELS, TASKS = 32, 16


class SumOfSquares:
    """Online packer of one task.

    A document's full windows are emitted at once.  Its rest, of r tokens, goes to a window at the fill level (or to a new
    one) that makes the sum over levels of squared counts of partly filled windows smallest; ties go to the fullest level.
    A level is a range of `grain` fills: `count` is the level array, `open` holds a level's windows as [fill, pieces].  A
    window may also be filled by a piece that is up to a grain too long: the piece is cut, and what is over is placed
    anew.  So there are never many more open windows than levels, and each window has at most one cut.
    """

    def __init__(self, window: int, first_id: int) -> None:
        self.window, self.next_id, self.grain = window, first_id, max(1, window // LEVELS)
        self.count = [0] * (window // self.grain + 1)
        self.open: list[list[list]] = [[] for _ in self.count]
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, offset))
            offset += n
        self.next_id += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total, step = len(ids) // 4, self.window * 4
        full = len(ids) // step * step
        for at in range(0, full, step):
            self._emit([(doc, at // 4, ids[at : at + step], total)])
        if full < len(ids):
            self.place((doc, full // 4, ids[full:], total))

    def level_for(self, r: int) -> int:
        """The level whose last window a piece of r tokens goes to; -1: a new window."""
        count, grain, window = self.count, self.grain, self.window
        best, rise = -1, 2 * count[r // grain] + 1
        found = None
        for k in range(len(count) - 1, -1, -1):
            if not count[k]:
                continue
            total = self.open[k][-1][0] + r
            if total >= window + grain:
                continue
            to = len(count) if total >= window else total // grain
            change = 0 if to == k else 1 - 2 * count[k] if total >= window else 2 * (count[to] - count[k]) + 2
            if found is None or change < found:
                best, found = k, change
        return best if found is not None and found <= rise else -1

    def place(self, piece: tuple) -> None:
        doc, start, ids, total = piece
        while ids:
            r = len(ids) // 4
            k = self.level_for(r)
            fill, pieces = self.open[k].pop() if k >= 0 else (0, [])
            if k >= 0:
                self.count[k] -= 1
            take = min(r, self.window - fill)
            pieces.append((doc, start, ids[: take * 4], total))
            if fill + take == self.window:
                self._emit(pieces)
            else:
                to = (fill + take) // self.grain
                self.open[to].append([fill + take, pieces])
                self.count[to] += 1
            start, ids = start + take, ids[take * 4 :]

    def left(self) -> list[tuple]:
        """Pieces of the windows that are still open, fullest windows first."""
        return [p for level in reversed(self.open) for _, pieces in level for p in pieces]

    def finish(self) -> int:
        """Cut what is left into full windows, and the last one into windows of powers of two; how many windows that gives."""
        queue, at, before = iter(self.left()), None, self.next_id
        left = sum(len(p[2]) for p in self.left()) // 4
        self.count, self.open = [0] * len(self.count), [[] for _ in self.count]
        while left:
            room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            left -= room
            pieces = []
            while room:
                doc, start, ids, total = at or next(queue)
                take = min(room, len(ids) // 4)
                pieces.append((doc, start, ids[: take * 4], total))
                room -= take
                at = (doc, start + take, ids[take * 4 :], total) if take * 4 < len(ids) else None
            self._emit(pieces)
        return self.next_id - before


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece of a document: which of its ids (start, length, ids_crc32) lie where (sequence_id, offset).

    A document is its text's ids and then end_id; a null or empty text is end_id alone.  Each task packs what it reads and
    writes its pieces to the shared folder; the pieces of its last open windows, which are about as many as there are
    levels, go with their ids to a second stage, where a task packs those of TASKS tasks in the same way and cuts only
    what is still open then.  Every id of every row lies in one piece; repeated rows are packed each; null ids stay null;
    an empty table gives no piece.  A task holds its open windows and one document's ids.
    """
    wide = pa.schema([*ARROW, ("tail", pa.binary()), ("task", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task = encoder(tokenizer, "ids"), TaskContext.get().partitionId()
        packer = SumOfSquares(window, task << 40)
        end = np.array([end_id], "<u4").tobytes()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), wide.types, strict=True)], schema=wide)

        def done() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            return batch_of([(*r, None, task) for r in rows])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, tokens in zip(ids, enc.ids(texts), strict=True):
                packer.add(doc, tokens + end)
                if len(packer.rows) >= 20_000:
                    yield done()
        if packer.rows:
            yield done()
        if left := packer.left():
            yield batch_of([(doc, start, None, None, total, None, None, ids, task) for doc, start, ids, total in left])

    def pack_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, group = None, None

        def finished() -> Iterator[pa.RecordBatch]:
            if packer is not None:
                packer.finish()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*packer.rows, strict=True)], schema=ARROW)

        for batch in batches:
            for g, doc, start, ids, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    yield from finished()
                    group, packer = g, SumOfSquares(window, 1 << 62 | g << 40)
                packer.place((doc, start, ids, total))
        yield from finished()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = stored(rows.mapInArrow(run, f"{SCHEMA}, tail binary, task bigint"))
    tails = first.where("tail is not null").select(F.floor(F.col("task") / TASKS).alias("group"), "doc_id", "start", "tail", "doc_tokens", "task")
    tails = tails.repartition("group").sortWithinPartitions("group", "task", "doc_id", "start").select("group", "doc_id", "start", "tail", "doc_tokens")
    return first.where("tail is null").select(*ARROW.names).unionByName(tails.mapInArrow(pack_tails, SCHEMA))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
