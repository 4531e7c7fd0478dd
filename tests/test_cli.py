"""The command line from file to file."""

import numpy as np
import pytest

from readmill.__main__ import main
from readmill.sources import sequence_files as IO


@pytest.fixture()
def fastq(tmp_path):
    rng = np.random.default_rng(0)
    seqs = ["".join(rng.choice(list("ACGT"), 40)) for _ in range(4)]
    rows = [(f"R{i}|BARCODE=B{i % 2}|COUNT={i + 1},2", seqs[i % 4], "I" * 40 if i % 3 else "!" * 40) for i in range(12)]
    (tmp_path / "x.fastq").write_text("".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in rows))
    return tmp_path / "x.fastq"


def run(spark, *args):
    return main(list(map(str, args)), spark)


def ids(spark, path):
    return sorted(r["read_id"] for r in IO.read_fastq(spark, path + "/*.txt").collect())


def test_filter_with_failed(spark, fastq):
    good, bad = run(spark, "filter", "quality", "-s", fastq, "-q", 30, "--failed")
    assert (good.endswith("x_quality-pass.fastq"), len(ids(spark, good)), len(ids(spark, bad))) == (True, 8, 4)


@pytest.mark.parametrize("args,n", [
    (["headers", "collapse", "-f", "COUNT", "--act", "sum"], 12), (["headers", "rename", "-f", "COUNT", "--names", "N"], 12), (["collapse", "run", "--cf", "COUNT", "--act", "sum"], 4),
    (["consensus", "run", "-n", 2], 2), (["split", "select", "-f", "BARCODE", "-u", "B1"], 6), (["split", "sample", "-n", 5], 5), (["split", "sort", "-f", "BARCODE"], 12),
    (["primers", "extract", "--start", 4, "--len", 8, "--mode", "cut", "--barcode"], 12), (["unify", "consensus", "-k", "COUNT"], 12), (["cluster", "set"], 12), (["align", "multiple"], 12),
])
def test_tools(spark, fastq, args, n):
    (path,) = run(spark, *args, "-s", fastq)
    assert len(ids(spark, path)) == n


def test_tables(spark, fastq):
    (path,) = run(spark, "headers", "table", "-s", fastq, "-f", "ID", "COUNT")
    assert spark.read.csv(path, sep="\t", header=True).count() == 12
    assert len(run(spark, "error", "set", "-s", fastq, "-n", 3)) == 6


def test_mates(spark, tmp_path):
    rng = np.random.default_rng(1)
    seq = "".join(rng.choice(list("ACGT"), 60))
    back = seq[20:].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    for k, s in ((1, seq[:40]), (2, back)):
        (tmp_path / f"r{k}.fastq").write_text(f"@M:1|F=x{k}\n{s}\n+\n{'I' * 40}\n@M:{k + 5}\nA\n+\nI\n")
    one, two = tmp_path / "r1.fastq", tmp_path / "r2.fastq"
    assert [len(ids(spark, p)) for p in run(spark, "pair", "run", "-1", one, "-2", two)] == [1, 1]
    (path,) = run(spark, "assemble", "align", "-1", one, "-2", two, "--1f", "F", "--2f", "F")
    r = IO.read_fastq(spark, path + "/*.txt").first()
    assert (r["read_id"], r["seq"], [tuple(x) for x in r["ann"]]) == ("M:1", seq, [("F", "x1,x2")])


def test_fails_and_logs(spark, fastq, tmp_path):
    paths = run(spark, "collapse", "run", "-s", fastq, "--failed", "--log", tmp_path / "log")
    assert [len(ids(spark, p)) for p in paths[:2]] == [4, 8] and IO.read_log(spark, str(tmp_path / "log"), ["ID", "DUPCOUNT"]).count() == 4
    good, bad = run(spark, "consensus", "run", "-n", 7, "-s", fastq, "--failed")
    assert len(ids(spark, bad)) == 12
    other = tmp_path / "y.fastq"
    other.write_text("".join(fastq.read_text().splitlines(keepends=True)[:16]))
    paths = run(spark, "pair", "run", "-1", fastq, "-2", other, "--failed")
    assert [len(ids(spark, p)) for p in paths[:3]] == [4, 4, 8]
    (path,) = run(spark, "headers", "add", "-f", "X", "-u", "1", "-s", fastq, "-o", tmp_path / "named.fastq")
    assert path == str(tmp_path / "named.fastq") and len(ids(spark, path)) == 12


def blocks(path):
    """A log's blocks as dictionaries."""
    text = "".join(p.read_text() for p in sorted(path.glob("*.txt")))
    return [dict(line.strip().split("> ", 1) if "> " in line else (line.strip().rstrip(">"), "") for line in b.splitlines()) for b in text.split("\n\n") if b.strip()]


def test_every_tool_writes_fails_and_logs(spark, fastq, tmp_path):
    with fastq.open("a") as f:
        f.write("@plain|OTHER=1\nACGTACGT\n+\nIIIIIIII\n")
    log = (tmp_path / f"log{k}" for k in range(9))
    for args, passed, failed, keys in (
        (["unify", "consensus", "-k", "COUNT"], 12, 1, {"ID", "PASS", "READS", "VALUES", "COUNTS"}), (["unify", "delete", "-k", "COUNT"], 0, 13, {"ID", "PASS", "READS", "VALUES", "COUNTS"}),
        (["align", "multiple"], 12, 1, {"ID", "READS", "LENGTH"}), (["cluster", "set"], 12, 1, {"ID", "READS", "CLUSTERS"}), (["cluster", "barcode"], 12, 1, {"ID", "READS", "CLUSTERS"}),
        (["headers", "delete", "-f", "COUNT"], 13, 1, {"ID", "PASS"}),
    ):
        at = next(log)
        good, bad = run(spark, *args, "-s", fastq, "--failed", "--log", at, "--outname", "-".join(args[:2]))
        assert (len(ids(spark, good)), len(ids(spark, bad))) == (passed, failed), args
        found = blocks(at)
        assert set(found[0]) == keys and len(found) == (13 if args[0] == "headers" else 2), args
        if args == ["unify", "delete", "-k", "COUNT"]:
            assert all(b["PASS"] == "false" and b["READS"] == "6" for b in found)
    for action, n in (("set", 7), ("barcode", 3)):
        at = next(log)
        paths = run(spark, "error", action, "-s", fastq, "-n", 3, "--failed", "--log", at, "--outname", action)
        assert len(paths) == n and len(ids(spark, paths[-1])) == 1 and [b["READS"] for b in blocks(at)] == ["6", "6"]


def test_delimiters(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">R1;X:1;Y:2\nACGT\n")
    (path,) = run(spark, "headers", "delete", "-f", "X", "-s", tmp_path / "a.fasta", "--delim", ";", ":", ",")
    assert [r["value"] for r in spark.read.text(path).collect()][0] == ">R1;Y:2"


@pytest.mark.parametrize("args", [
    ["filter", "length"], ["filter", "length", "-s", "nothing.fastq"], ["headers", "rename", "-s", "FILE", "-f", "A", "B", "--names", "C"], ["consensus", "run", "-s", "FILE", "--maxdiv", "0.1", "--maxerror", "0.1"],
    ["consensus", "run", "-s", "FILE", "--freq", "2"], ["primers", "score", "-s", "FILE"], ["consensus", "run", "-s", "FILE", "--cf", "A"], ["filter", "length", "-s", "FILE", "--delim", "|", "|", ","],
])
def test_wrong_options(spark, fastq, args):
    with pytest.raises(SystemExit):
        run(spark, *(fastq if x == "FILE" else x for x in args))


def test_unknown_action(spark):
    with pytest.raises(SystemExit):
        run(spark, "filter", "nothing")
