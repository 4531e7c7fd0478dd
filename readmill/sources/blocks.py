"""Text as block gzip: a Python data sink whose files any gzip reads and scan splits."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Text of a member; with what gzip adds to text that it can't shorten, a member is less than 64 KiB.
MEMBER_TEXT = 65280


def member(text: bytes) -> bytes:
    """A gzip member that states its size; that of no text ends a file."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(text) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + (len(body) + 25).to_bytes(2, "little")  # fixed values of the format
    return head + body + zlib.crc32(text).to_bytes(4, "little") + len(text).to_bytes(4, "little")


def members(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """Lines of batches of one column as members."""
    held = bytearray()
    for batch in batches:
        for line in batch.column(0).to_pylist():
            held += line.encode()
            held += b"\n"
            while len(held) >= MEMBER_TEXT:
                yield member(bytes(held[:MEMBER_TEXT]))
                del held[:MEMBER_TEXT]
    if held:
        yield member(bytes(held))
    yield member(b"")


@dataclass
class Written(WriterCommitMessage):
    """A task's number and the file that its successful attempt wrote."""

    task: int
    at: str


class BlockWriter(DataSourceArrowWriter):
    """Attempts write hidden files of their own; only those of committed tasks get a name, which goes by the task's number."""

    def __init__(self, path: str) -> None:
        self.path = path if re.match(r"\w+:", path) else f"file://{os.path.abspath(path)}"

    def _folder(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = self._folder()
        at = f"{folder}/_attempt-{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(at) as out:
            for data in members(iterator):
                out.write(data)
        return Written(TaskContext.get().partitionId(), at)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = self._folder()
        for m in filter(None, messages):
            system.move(m.at, f"{folder}/part-{m.task:05d}.gz")
        with system.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = self._folder()
        for m in filter(None, messages):
            system.delete_file(m.at)


class BlockGzip(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_gzip"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        system, folder = BlockWriter(self.options["path"])._folder()
        if system.get_file_info(folder).type != pafs.FileType.NotFound:
            raise FileExistsError(f"{self.options['path']} is there already")
        return BlockWriter(self.options["path"])


def write_blocks(lines: DataFrame, path: str) -> None:
    """Lines (one column of text, nulls not allowed) as files of block gzip in a new folder."""
    lines.sparkSession.dataSource.register(BlockGzip)
    lines.write.format("block_gzip").mode("append").save(path)
