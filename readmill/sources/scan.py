"""FASTA and FASTQ files as a Python data source: byte ranges of files, each brought into step with the records by itself.

A record belongs to the range in which it begins.  Plain files and block gzip (gzip members of at most 64 KiB that state
their size) are split; other gzip is one range.  `ord` is a record's byte in its file, or for block gzip the first byte of
its member times 2**16 and its byte there, so it grows in the file's order and doesn't depend on ranges.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "src string, ord bigint, header string, seq string, qual string"
ARROW = pa.schema([("src", pa.string()), ("ord", pa.int64()), ("header", pa.string()), ("seq", pa.string()), ("qual", pa.string())])

#: Bytes read at a time, and bytes before a range in which its reader first looks for records that lead into it.
PIECE, WINDOW = 1 << 20, 1 << 16
# Fixed values of block gzip: how a member and its field with the size begin, and the length of all that.
MEMBER, FIELD, HEAD = b"\x1f\x8b\x08\x04", b"BC\x02\x00", 18


class Damaged(ValueError):
    """What is not a record, with its text."""

    def __init__(self, what: str, text: bytes) -> None:
        super().__init__(f"{what}: {text[:200].decode('utf-8', 'replace')}")


@dataclass
class Span(InputPartition):
    """A range of a file's bytes; packed: plain, gzip or blocks."""

    path: str
    start: int
    end: int
    packed: str


class File:
    """An open file and how its bytes become text."""

    def __init__(self, path: str, packed: str) -> None:
        system, at = pafs.FileSystem.from_uri(path)
        self.size, self.packed = system.get_file_info(at).size, packed
        self.raw = io.BufferedReader(system.open_input_file(at), PIECE)

    def place(self, at: int) -> int:
        """Where text can be read from, at a byte or behind it: there, or at the first member."""
        if self.packed != "blocks" or at == 0:
            return at
        self.raw.seek(at)
        near = self.raw.read(3 << 16)
        found = near.find(MEMBER)
        while found >= 0:
            if self._leads_on(near, found):
                return at + found
            found = near.find(MEMBER, found + 1)
        return self.size

    def _leads_on(self, near: bytes, at: int) -> bool:
        """Whether a member begins there: it is followed by another one that is, as far as can be seen, or by the file's end."""
        for _ in range(3):
            head = near[at : at + HEAD]
            if len(head) < HEAD:
                return True
            if head[:4] != MEMBER or head[12:16] != FIELD:
                return False
            at += int.from_bytes(head[16:18], "little") + 1
        return True

    def order(self, place: int) -> int:
        """The ord of what begins there."""
        return place << 16 if self.packed == "blocks" else place

    def pieces(self, place: int) -> Iterator[tuple[int, bytes]]:
        """Text from there on, each piece with the ord of its first byte."""
        self.raw.seek(place)
        if self.packed == "blocks":
            while head := self.raw.read(HEAD):
                if head[:4] != MEMBER or head[12:16] != FIELD or len(head) < HEAD:
                    raise Damaged("not a member of block gzip", head)
                size = int.from_bytes(head[16:18], "little") + 1
                yield place << 16, zlib.decompress(head + self.raw.read(size - HEAD), 31)
                place += size
            return
        stream = gzip.GzipFile(fileobj=self.raw) if self.packed == "gzip" else self.raw
        while data := stream.read(PIECE):
            yield place, data
            place += len(data)


class Text:
    """Text read so far from a place on; places in it are indices of `data`."""

    def __init__(self, pieces: Iterator[tuple[int, bytes]]) -> None:
        self.data, self._pieces = bytearray(), pieces
        self._starts: list[int] = []
        self._ords: list[int] = []

    def more(self) -> bool:
        piece = next(self._pieces, None)
        if piece is None:
            return False
        self._starts.append(len(self.data))
        self._ords.append(piece[0])
        self.data += piece[1]
        return True

    def find(self, what: bytes, at: int) -> int:
        """Where something is at a place or behind it, reading on for it; -1 if nowhere."""
        while (found := self.data.find(what, at)) < 0:
            at = max(at, len(self.data) - len(what) + 1)
            if not self.more():
                return -1
        return found

    def line(self, at: int) -> tuple[bytes, int] | None:
        """The line at a place and where the next one begins; None at the end."""
        end = self.find(b"\n", at)
        if end < 0:
            return (bytes(self.data[at:]).rstrip(b"\r"), len(self.data)) if at < len(self.data) else None
        return bytes(self.data[at:end]).rstrip(b"\r"), end + 1

    def filled(self, at: int) -> int:
        """The place of the first line from there on that isn't blank, or the end."""
        while (got := self.line(at)) is not None and not got[0].strip():
            at = got[1]
        return at

    def ords(self, places: list[int] | np.ndarray) -> np.ndarray:
        starts, at = np.array(self._starts, np.int64), np.asarray(places, np.int64)
        k = np.searchsorted(starts, at, "right") - 1
        return np.array(self._ords, np.int64)[k] + at - starts[k]

    def ord(self, at: int) -> int:
        k = bisect_right(self._starts, at) - 1
        return self._ords[k] + at - self._starts[k]

    def forget(self, at: int) -> None:
        """Drop what is before a place, which is 0 then."""
        del self.data[:at]
        k = max(0, bisect_right(self._starts, at) - 1)
        self._starts, self._ords = [s - at for s in self._starts[k:]], self._ords[k:]


def fastq_record(text: Text, at: int) -> tuple[bytes, bytes, bytes, int]:
    """Header, letters and qualities of the record at a place, and the place behind it and blank lines.

    Letters go on to the line that begins with +, and qualities until they are as many, whatever their lines begin with;
    then a line that begins with @, or the end, has to follow.
    """
    head, at = text.line(at)
    if not head.startswith(b"@"):
        raise Damaged("a line without a record", head)
    letters: list[bytes] = []
    while True:
        got = text.line(at)
        if got is None or got[0].startswith(b"@"):
            raise Damaged("not a FASTQ record", head)
        at = got[1]
        if got[0].startswith(b"+"):
            break
        letters.append(got[0])
    seq, qual = b"".join(letters), b""
    while len(qual) < len(seq):
        got = text.line(at)
        if got is None:
            break
        qual, at = qual + got[0], got[1]
    if len(qual) != len(seq):
        raise Damaged("letters and qualities differ in number", head)
    at = text.filled(at)
    if at < len(text.data) and text.data[at : at + 1] != b"@":
        raise Damaged("a line without a record", bytes(text.data[at : at + 200]))
    return head[1:], seq, qual, at


def _led_to(text: Text, at: int, limit: int) -> int | None:
    """The first record from a limit on (an ord) to which the records from a place on lead; None if they aren't records."""
    try:
        while at < len(text.data) and text.ord(at) < limit:
            at = fastq_record(text, at)[3]
    except Damaged:
        return None
    return at


def fastq_start(file: File, place: int, window: int) -> tuple[Text, int]:
    """Text and the place in it of the first record that begins at a place of the file or behind it.

    Every line in the window before it that begins with @ may be a header.  Those that are lead to the same record; what
    is a line of qualities is seldom followed by records, and if it is and leads elsewhere, the window is widened, at most
    to the file's first record, which is certain.
    """
    while True:
        begin = file.place(max(0, place - window))
        text, limit = Text(file.pieces(begin)), file.order(place)
        if begin == 0:
            at = text.filled(0)
            while at < len(text.data) and text.ord(at) < limit:
                at = fastq_record(text, at)[3]
            return text, at
        found: set[int] = set()
        known: dict[int, int | None] = {}
        at = text.find(b"\n", 0) + 1
        while at and at < len(text.data) and text.ord(at) < limit:
            if text.data[at : at + 1] == b"@" and at not in known:
                path, here = [], at
                try:
                    while here not in known and here < len(text.data) and text.ord(here) < limit:
                        path.append(here)
                        here = fastq_record(text, here)[3]
                    end = known.get(here, here)
                except Damaged:
                    end = None
                known.update(dict.fromkeys(path, end))
                if end is not None:
                    found.add(end)
            at = text.find(b"\n", at) + 1
        if len(found) == 1:
            return text, found.pop()
        window *= 4


def fasta_start(file: File, place: int, window: int) -> tuple[Text, int]:
    """Text and the place in it of the first line from a place of the file on that begins with >."""
    while (begin := file.place(max(0, place - window))) >= place > 0:  # the line before has to be seen
        window *= 4
    text, limit = Text(file.pieces(begin)), file.order(place)
    at = 0 if begin == 0 else text.find(b"\n", 0) + 1 or len(text.data)
    while (got := text.line(at)) is not None and (text.ord(at) < limit or not got[0].startswith(b">")):
        at = got[1]
    return text, at


Columns = tuple[np.ndarray, list[bytes], list[bytes], list[bytes] | None]


def _four_lines(text: Text, at: int) -> tuple[Columns, int] | None:
    """All records that are in memory from a place on, if each has four lines, and the place behind them."""
    lines = bytes(text.data[at : text.data.rfind(b"\n") + 1]).split(b"\n")
    lines = lines[: (len(lines) - 1) // 4 * 4]
    if not lines:
        return None
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    places = at + np.cumsum(sizes) - sizes
    if b"\r" in text.data:
        lines = [x.rstrip(b"\r") for x in lines]
    head, seq, plus, qual = (lines[k::4] for k in range(4))
    if not all(h[:1] == b"@" and p[:1] == b"+" and len(s) == len(q) and s[:1] not in (b"@", b"+") for h, s, p, q in zip(head, seq, plus, qual, strict=True)):
        return None
    return (text.ords(places[::4]), [h[1:] for h in head], seq, qual), at + int(sizes.sum())


def fastq_batches(text: Text, at: int) -> Iterator[Columns]:
    """Records from a place on, about PIECE bytes at a time."""
    while True:
        while len(text.data) - at < PIECE and text.more():
            pass
        if at >= len(text.data):
            return
        got = _four_lines(text, at)
        if got is None:  # records of other numbers of lines, one by one
            at = text.filled(at)
            places, rows, stop = [], [], at + PIECE
            while at < min(len(text.data), stop):
                places.append(at)
                *row, at = fastq_record(text, at)
                rows.append(row)
            if not rows:
                return
            head, seq, qual = (list(x) for x in zip(*rows, strict=True))
            got = (text.ords(places), head, seq, qual), at
        columns, at = got
        yield columns
        text.forget(at)
        at = 0


def fasta_batches(text: Text, at: int) -> Iterator[Columns]:
    """Records from a place on, about PIECE bytes at a time; sequences may go over several lines, and empty records don't count."""
    while at < len(text.data) or text.more():
        places, heads, seqs, stop = [], [], [], at + PIECE
        while at < min(len(text.data), stop):
            end = text.find(b"\n>", at)
            end = len(text.data) if end < 0 else end
            head, _, body = bytes(text.data[at + 1 : end]).partition(b"\n")
            if head.strip() or body.strip():
                places.append(at)
                heads.append(head.partition(b"\r")[0])
                seqs.append(b"".join(body.split()))
            at = end + 1
        if places:
            yield text.ords(places), heads, seqs, None
        at = min(at, len(text.data))
        text.forget(at)
        at = 0


def read_span(span: Span, kind: str, window: int) -> Iterator[pa.RecordBatch]:
    """Records that begin within a range."""
    file = File(span.path, span.packed)
    start, end = file.place(span.start), file.place(span.end) if span.end < file.size else file.size
    if start >= end:
        return
    text, at = (fastq_start if kind == "fastq" else fasta_start)(file, start, window)
    limit = file.order(end) if end < file.size else 1 << 62
    for ords, head, seq, qual in (fastq_batches if kind == "fastq" else fasta_batches)(text, at):
        n = int(np.searchsorted(ords, limit))
        if n:
            strings = lambda values: pa.array(values[:n], pa.binary()).cast(pa.string())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array([span.path] * n), pa.array(ords[:n]), strings(head), strings(seq), pa.nulls(n, pa.string()) if qual is None else strings(qual)], schema=ARROW)
        if n < len(ords):
            return


def listed(path: str) -> list[tuple[str, int]]:
    """Addresses and sizes of the files of a path: a file, a folder, or a pattern of files; hidden ones don't count."""
    if not re.match(r"\w+:", path):
        path = f"file://{os.path.abspath(path)}"
    path = re.sub(r"^file:/*", "file:///", path)
    scheme = path.partition(":")[0]
    fixed = re.split(r"[*?\[]", path)[0]
    system, at = pafs.FileSystem.from_uri(fixed if fixed == path else fixed.rpartition("/")[0])
    info = system.get_file_info(at)
    found = [info]
    if info.type == pafs.FileType.Directory:
        found = system.get_file_info(pafs.FileSelector(at, recursive=True))
        found = [f for f in found if not any(p[:1] in "._" for p in f.path[len(at) :].strip("/").split("/"))]
    address = lambda f: f"{scheme}://{f.path}"
    files = sorted((address(f), f.size) for f in found if f.type == pafs.FileType.File and (fixed == path or fnmatch.fnmatchcase(address(f), path)))
    if not files:
        raise FileNotFoundError(f"no file at {path}")
    return files


def packed_how(path: str) -> str:
    """plain, gzip or blocks, by extension and first bytes."""
    if not path.endswith(".gz"):
        return "plain"
    system, at = pafs.FileSystem.from_uri(path)
    with system.open_input_file(at) as f:
        head = f.read(HEAD)
    return "blocks" if head[:4] == MEMBER and head[12:16] == FIELD else "gzip"


class SequenceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.kind, self.step, self.window = options["kind"], int(options["step"]), int(options.get("window", WINDOW))
        self.files = listed(options["path"])

    def partitions(self) -> list[InputPartition]:
        spans = []
        for path, size in self.files:
            packed = packed_how(path)
            step = size if packed == "gzip" else self.step
            spans += [Span(path, at, min(at + step, size), packed) for at in range(0, size, max(1, step))]
        return spans or [Span(self.files[0][0], 0, 0, "plain")]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from read_span(partition, self.kind, self.window)


class SequenceFiles(DataSource):
    """Options: kind (fasta, fastq), step (bytes of a range), window."""

    @classmethod
    def name(cls) -> str:
        return "sequence_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SequenceReader:
        return SequenceReader(dict(self.options))


def _bytes(size: str) -> int:
    """A number of bytes as Spark's settings have it: a number, and b, k, m or g with or without a second b."""
    number, unit = re.fullmatch(r"(\d+)\s*([bkmgt]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgt".index(unit.replace("b", "") or " ")


def scan(spark: SparkSession, path: str, kind: str, window: int = WINDOW) -> DataFrame:
    """src, ord, header, seq, qual of the records of FASTA or FASTQ files, by ranges of spark.sql.files.maxPartitionBytes.

    Files are opened by the workers, so their address has to be one that pyarrow knows.  What one task reads of a gzip file is dealt out.
    """
    spark.dataSource.register(SequenceFiles)
    step = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    rows = spark.read.format("sequence_files").options(kind=kind, step=step, window=window).load(path)
    whole = any(packed_how(file) == "gzip" for file, _ in listed(path))
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if whole else rows
