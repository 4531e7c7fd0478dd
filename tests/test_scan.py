"""Ranges of sequence files and how they get into step with records."""

import gzip
import io
import random
import zlib

import pytest

from readmill.sources import blocks as B
from readmill.sources import scan as R
from readmill.sources import sequence_files as IO


def block_gzip(data: bytes, size: int) -> bytes:
    """Members that state their size, and the empty one at the end."""
    out = b""
    for part in [data[k : k + size] for k in range(0, len(data), size)] + [b""]:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + (6).to_bytes(2, "little") + b"BC\x02\x00"
        out += head + (len(body) + 25).to_bytes(2, "little") + body + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little")
    return out


def wrapped(text: str, width: int) -> str:
    return "\n".join(text[k : k + width] for k in range(0, len(text), width)) or ""


def made(n: int, seed: int, longest: int = 60) -> list[tuple[str, str, str]]:
    """Records whose qualities like to begin with @ and +, and to look like letters."""
    draw = random.Random(seed)
    out = []
    for i in range(n):
        size = draw.choice([0, 1, 2, draw.randrange(longest)])
        out.append((f"R{i} @x|B={i % 3}", "".join(draw.choices("ACGTN-", k=size)), "".join(draw.choices("@+ACGI!", k=size))))
    return out


def fastq(rows, width: int, line: str = "\n") -> bytes:
    text = "".join(f"@{h}\n{wrapped(s, width)}\n+\n{wrapped(q, width)}\n" + ("\n" if i % 7 == 3 else "") for i, (h, s, q) in enumerate(rows))
    return text.replace("\n", line).encode()


def by_ranges(path, step: int, kind: str = "fastq", window: int = 64):
    reader = R.SequenceReader({"path": str(path), "kind": kind, "step": str(step), "window": str(window)})
    got = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert [r["ord"] for r in got] == sorted({r["ord"] for r in got})
    return [(r["header"], r["seq"], r["qual"]) for r in got]


@pytest.mark.parametrize("width", [1000, 13])
@pytest.mark.parametrize("line", ["\n", "\r\n"])
def test_every_range_finds_its_records(tmp_path, width, line):
    rows = made(120, width)
    (tmp_path / "a.fastq").write_bytes(fastq(rows, width, line))
    (tmp_path / "b.fastq.gz").write_bytes(block_gzip(fastq(rows, width, line), 300))
    (tmp_path / "c.fastq.gz").write_bytes(gzip.compress(fastq(rows, width, line)))
    for name in ("a.fastq", "b.fastq.gz", "c.fastq.gz"):
        for step in (37, 100, 777, 10**6):
            assert by_ranges(tmp_path / name, step) == rows


def test_qualities_that_are_records_themselves(tmp_path):
    inner = "@x" + "A" * 8 + "+" * 10 + "B" * 8 + "@y"  # in lines of 10 letters, whole records within the qualities
    rows = [(f"R{i}", "ACGTACGTAC" * 3, "@x" + "A" * 8 + "+" + "I" * 9 + "B" * 10) for i in range(50)]
    rows += [(f"S{i}", "C" * len(inner), inner) for i in range(50)]
    (tmp_path / "a.fastq").write_bytes(fastq(rows, 10))
    for step in (41, 333):
        assert by_ranges(tmp_path / "a.fastq", step, window=16) == rows


def test_letters_longer_than_windows_and_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 512)
    rows = made(40, 5, longest=5000)
    for name, width, size in (("a.fastq", 10**6, None), ("b.fastq", 80, None), ("c.fastq.gz", 80, 1000)):
        data = fastq(rows, width)
        (tmp_path / name).write_bytes(data if size is None else block_gzip(data, size))
        assert by_ranges(tmp_path / name, 900) == rows


def test_fasta_of_block_gzip(tmp_path):
    rows = [(h, s, None) for h, s, _ in made(100, 9, 300)]
    data = ("; a remark\n" + "".join(f">{h}\n{wrapped(s, 50)}\n" for h, s, _ in rows)).encode()
    for name, body in (("a.fasta.gz", block_gzip(data, 257)), ("b.fasta.gz", gzip.compress(data)), ("c.fasta", data)):
        (tmp_path / name).write_bytes(body)
        for step in (50, 1000):
            assert by_ranges(tmp_path / name, step, "fasta") == rows


def test_a_cut_or_damaged_file_is_an_error(tmp_path):
    data = fastq(made(50, 3), 20)
    (tmp_path / "a.fastq").write_bytes(data[: data.rindex(b"+\n") + 2] + b"I" * 70)
    (tmp_path / "b.fastq").write_bytes(data.replace(b"@R25 ", b"R25 "))
    (tmp_path / "c.fastq.gz").write_bytes(block_gzip(data, 500)[:-40])
    for name in ("a.fastq", "b.fastq", "c.fastq.gz"):
        for step in (64, 10**6):
            with pytest.raises((R.Damaged, zlib.error, EOFError)):
                by_ranges(tmp_path / name, step)


def test_tables_of_packed_files(spark, tmp_path):
    rows = made(300, 1)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fastq.gz").write_bytes(block_gzip(fastq(rows, 25), 400))
    (tmp_path / "in" / "b.fastq").write_bytes(fastq(rows[:20], 25))
    (tmp_path / "in" / "_SUCCESS").write_bytes(b"")
    (tmp_path / "e.fastq").write_bytes(b"")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        packed = IO.read_fastq(spark, str(tmp_path / "in" / "a.fastq.gz"))
        assert packed.rdd.getNumPartitions() > 5
        assert [(r["header"], r["seq"], r["qual"]) for r in packed.orderBy("ord").collect()] == rows
        assert IO.read_fastq(spark, str(tmp_path / "in")).count() == 320
        assert IO.read_fastq(spark, f"{tmp_path}/in/*.gz").count() == 300
        assert IO.read_fastq(spark, str(tmp_path / "e.fastq")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with pytest.raises(Exception, match="no file"):
        IO.read_fastq(spark, str(tmp_path / "absent.fastq")).collect()


def test_sizes_as_settings_have_them():
    assert [R._bytes(x) for x in ("700", "134217728b", "128MB", "64k", "1g")] == [700, 1 << 27, 1 << 27, 1 << 16, 1 << 30]


def test_block_gzip_in_order_and_back(spark, tmp_path):
    rows = [(h, s, q) for h, s, q in made(3000, 2) if s]
    (tmp_path / "a.fastq").write_bytes(fastq(rows, 1000))
    reads = IO.read_fastq(spark, str(tmp_path / "a.fastq"))
    out = tmp_path / "out.fastq.gz"
    IO.write_sequences(reads.repartition(5), str(out), compress=True, ordered=True)
    assert sorted(p.name for p in out.iterdir())[0] == "_SUCCESS" and not list(out.glob("_attempt*"))
    joined = b"".join(p.read_bytes() for p in sorted(out.glob("part-*")))
    assert gzip.decompress(joined).decode() == "".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in rows)
    (tmp_path / "one.fastq.gz").write_bytes(joined)
    assert R.packed_how(f"file://{tmp_path}/one.fastq.gz") == "blocks"
    assert by_ranges(tmp_path / "one.fastq.gz", 5000, window=1 << 16) == rows
    assert sorted((r["header"], r["seq"], r["qual"]) for r in IO.read_fastq(spark, str(out)).collect()) == sorted(rows)
    with pytest.raises(Exception, match="already"):
        IO.write_sequences(reads, str(out), compress=True)


def test_members_hold_long_lines():
    import pyarrow as pa

    draw = random.Random(4)
    lines = ["".join(draw.choices("ACGT@!~", k=k)) for k in (0, 10, 200_000, 65_280, 65_279)]
    parts = list(B.members(iter([pa.RecordBatch.from_pydict({"value": lines})])))
    assert gzip.decompress(b"".join(parts)).decode() == "\n".join(lines) + "\n" and max(map(len, parts)) <= 1 << 16
    noise = draw.randbytes(B.MEMBER_TEXT)
    assert len(B.member(noise)) < 1 << 16 and gzip.decompress(B.member(noise)) == noise
