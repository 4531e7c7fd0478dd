"""Letter counts of whole sets of reads in arrays: consensus and comparison kernels of tasks that have sets' reads together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from readmill.schema import MASKS, MISSING

#: Letters that are counted at a time.
LETTERS = 4_000_000

_MISSING = np.zeros(256, bool)
_MISSING[[ord(c) for c in MISSING]] = True
_BITS = np.zeros(256, np.uint8)
for _c, _m in {**MASKS, "-": 16, ".": 16}.items():
    _BITS[[ord(_c), ord(_c.lower())]] = _m


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each text and the end of the last, bytes) of a string column; null texts are empty."""
    texts = pc.fill_null(texts, "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    return ends, data


def letters_of(seqs: pa.Array, quals: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every letter of the reads: its read, its place, its byte and its quality (0 where the read has none)."""
    ends, data = text_bytes(seqs)
    sizes = np.diff(ends)
    read = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(read)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    q_ends, q_data = text_bytes(quals)
    quality = np.zeros(len(read), np.int64)
    some = np.flatnonzero(place < np.diff(q_ends)[read])
    quality[some] = q_data[q_ends[read[some]] + place[some]].astype(np.int64) - 33
    return read, place, data[ends[0] : ends[-1]], quality


def by_sets(kernel: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function over rows that come sorted by set_id: the kernel gets whole sets and the first row of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            if not held or batch["set_id"][0] == held[-1]["set_id"][-1] == batch["set_id"][-1]:
                held.append(batch)  # still one set, or the first
                if len(held) == 1 and batch["set_id"][0] != batch["set_id"][-1]:
                    yield from emit(held, False)
                continue
            held.append(batch)
            yield from emit(held, False)
        if held:
            yield from emit(held, True)

    def emit(held: list[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        """Give the kernel the sets that are whole; the last one stays unless nothing follows."""
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table["set_id"].combine_chunks()
        starts = np.r_[0, np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1]
        end = len(table) if last else int(starts[-1])
        held[:] = [] if last else table.slice(end).to_batches()
        starts = starts[starts < end]
        if not len(starts):
            return
        sizes = np.diff(text_bytes(table["seq"].combine_chunks())[0])
        before = np.r_[0, np.cumsum(sizes)]
        first = 0
        while first < len(starts):  # as many sets as have LETTERS letters together, one at least
            stop = max(first + 1, int(np.searchsorted(before[starts], before[starts[first]] + LETTERS)))
            hi = int(starts[stop]) if stop < len(starts) else end
            yield kernel(table.slice(starts[first], hi - starts[first]).combine_chunks(), starts[first:stop] - starts[first])
            first = stop

    return run


def consensus_kernel(quality: bool, least_quality: int, least_freq: float, dependent: bool) -> Callable[[pa.Table, np.ndarray], pa.RecordBatch]:
    """set_id, seq, qual of whole sets; see readmill.operators.consensus for what wins a place."""

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        read, place, byte, q = letters_of(table["seq"].combine_chunks(), table["qual"].combine_chunks())
        n_sets, set_of = len(starts), np.zeros(len(table), np.int64)
        set_of[starts[1:]] = 1
        set_of = np.cumsum(set_of)
        set_n = np.bincount(set_of, minlength=n_sets)
        width = np.zeros(n_sets, np.int64)
        np.maximum.at(width, set_of[read], place + 1)
        base = np.r_[0, np.cumsum(width)]
        known_bytes, code = np.unique(byte, return_inverse=True)
        cells = base[-1] * len(known_bytes)
        key = (base[set_of[read]] + place) * len(known_bytes) + code
        shape = (int(base[-1]), len(known_bytes))
        n = np.bincount(key, minlength=cells).reshape(shape)
        alone = np.repeat(set_n == 1, width)
        letter = (n > 0) & ~_MISSING[known_bytes]
        of_place, all_n = np.arange(shape[0]), np.where(letter, n, 0).sum(axis=1)
        if quality:
            total = np.bincount(key, q, minlength=cells).reshape(shape)
            factor = total
            if dependent:
                factor = np.zeros(cells)
                np.maximum.at(factor, key, q)
                factor = factor.reshape(shape)
            worth = np.floor(total * factor / np.maximum(total.sum(axis=1), 1)[:, None])
            best = np.where(letter, worth, -1).argmax(axis=1) if cells else of_place
            score = np.minimum(np.where(letter, worth, -1)[of_place, best], 90)
            bad = (all_n == 0) | (score < least_quality) | (~alone & (n[of_place, best] / np.maximum(all_n, 1) < least_freq))
            out_q = np.where(bad, 0, score).astype(np.uint8) + np.uint8(33)
        else:
            best = np.where(letter, n, 0).argmax(axis=1) if cells else of_place
            bad = (all_n == 0) | (n[of_place, best] / np.maximum(all_n, 1) < least_freq)
        out = np.where(bad, np.uint8(ord("N")), known_bytes[best] if cells else np.empty(0, np.uint8)).astype(np.uint8)
        if not quality and cells:
            out = np.where(alone, known_bytes[(n > 0).argmax(axis=1)], out)
        some = np.flatnonzero(width)  # sets of empty reads have no places
        ends = pa.py_buffer(np.r_[0, np.cumsum(width[some])].astype(np.int32).tobytes())
        texts = [pa.StringArray.from_buffers(len(some), ends, pa.py_buffer(x.tobytes())) for x in ([out, out_q] if quality else [out])]
        ids = table["set_id"].combine_chunks().take(pa.array(starts[some]))
        return pa.RecordBatch.from_arrays([ids, texts[0], texts[1] if quality else pa.nulls(len(some), pa.string())], ["set_id", "seq", "qual"])

    return kernel


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pos, obs, ref, q, set_n, wrong, n of rows seq, qual, ref, set_n: equal ones of a batch are one row with their number."""
    for batch in batches:
        if not len(batch):
            continue
        read, place, obs, q = letters_of(batch["seq"], batch["qual"])
        r_ends, r_data = text_bytes(batch["ref"])
        able = np.flatnonzero(place < np.diff(r_ends)[read])
        read, place, obs, q = read[able], place[able], obs[able], q[able]
        ref = r_data[r_ends[read] + place]
        able = np.flatnonzero(~_MISSING[obs] & ~_MISSING[ref])
        size, size_at = np.unique(batch["set_n"].to_numpy(), return_inverse=True)
        columns = [place[able], obs[able].astype(np.int64), ref[able].astype(np.int64), q[able] + 128, size_at[read[able]]]
        key = columns[0]
        for x, top in zip(columns[1:], (256, 256, 512, max(1, len(size))), strict=True):
            key = key * top + x
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        pos, obs, ref, q, at = (x[first] for x in columns)
        wrong = (obs != ref) & ((_BITS[obs] & _BITS[ref]) == 0)
        letter = [pa.array(np.char.mod("%c", x.astype(np.int64)) if len(x) else [], pa.string()) for x in (obs, ref)]
        yield pa.RecordBatch.from_arrays([pa.array(pos.astype(np.int32)), *letter, pa.array((q - 128).astype(np.int32)), pa.array(size[at].astype(np.int64)), pa.array(wrong), pa.array(n.astype(np.int64))], ["pos", "obs", "ref", "q", "set_n", "wrong", "n"])
