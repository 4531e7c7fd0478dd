"""Files in and out."""

import gzip

import pytest
from pyspark.sql import functions as F

from readmill import result, streaming
from readmill.functions import annotation as A
from readmill.functions import headers as H
from readmill.operators import filters
from readmill.sources import sequence_files as IO


def test_fastq_round_trip(spark, tmp_path):
    text = "@A x|B=1\nACGT\n+\n@III\n@C|B=2\nGG\n+C|B=2\n!@\n"
    (tmp_path / "a.fastq").write_text(text)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(text)
    for name in ("a.fastq", "b.fq.gz"):
        got = IO.read_sequences(spark, str(tmp_path / name)).orderBy("ord").collect()
        assert [(r["read_id"], r["seq"], r["qual"], [tuple(x) for x in r["ann"]]) for r in got] == [("A x", "ACGT", "@III", [("B", "1")]), ("C", "GG", "!@", [("B", "2")])]
    IO.write_sequences(IO.read_sequences(spark, str(tmp_path / "a.fastq")), str(tmp_path / "out"))
    again = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert again in ("@A x|B=1\nACGT\n+\n@III\n@C|B=2\nGG\n+\n!@\n", "@C|B=2\nGG\n+\n!@\n@A x|B=1\nACGT\n+\n@III\n")


def test_fasta_lines_and_primers(spark, tmp_path):
    (tmp_path / "p.fasta").write_text(">P 1,x\nacg\nTT\n>Q\nNNA\n")
    assert IO.read_primers(spark, str(tmp_path / "p.fasta")) == {"P_1_x": "ACGTT", "Q": "NNA"}
    assert [tuple(r) for r in IO.read_references(spark, str(tmp_path / "p.fasta")).orderBy("name").collect()] == [("P", "ACGTT"), ("Q", "NNA")]
    with pytest.raises(ValueError):
        IO.read_sequences(spark, "x.bam")


def test_tables_and_logs(spark, tmp_path):
    (tmp_path / "o.tsv").write_text("P\t2\nQ\t0\n")
    (tmp_path / "v.tsv").write_text("ID\tX\na\t1\nb\t2\n")
    (tmp_path / "l.log").write_text("ID> a\nLEN> 4\n\nID> b\nLEN> \n\n")
    assert [tuple(r) for r in IO.read_offsets(spark, str(tmp_path / "o.tsv")).collect()] == [("P", 2), ("Q", 0)]
    assert [r["ID"] for r in IO.read_values(spark, str(tmp_path / "v.tsv"), "ID").collect()] == ["a", "b"]
    assert [(r["ID"], r["LEN"]) for r in IO.read_log(spark, str(tmp_path / "l.log"), ["ID", "LEN"]).orderBy("ID").collect()] == [("a", "4"), ("b", "")]
    logs = spark.createDataFrame([("a", 4)], "ID string, LENGTH int")
    IO.write_log(logs, str(tmp_path / "w"))
    assert [(r["ID"], r["LENGTH"]) for r in IO.read_log(spark, str(tmp_path / "w"), ["ID", "LENGTH"]).collect()] == [("a", "4")]


def test_names():
    assert IO.file_kind("x/a.fq.gz") == "fastq" and IO.file_kind("a.fna") == "fasta" and IO.file_kind("a.tsv") == "table"
    assert IO.output_path("d/a.fastq.gz", "quality-pass", "fastq", compress=True) == "d/a_quality-pass.fastq.gz"


def test_pass_and_fail_are_all(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">A\nACGT\n>B\nAC\n")
    reads = IO.read_sequences(spark, str(tmp_path / "a.fasta"))
    out = filters.length(reads, 3)
    assert [r["read_id"] for r in result.passed(out).collect()] == ["A"]
    assert [r["read_id"] for r in result.failed(out, reads).collect()] == ["B"]
    assert result.log(out, "seq").count() == 2


def test_filters_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("t", 0, "A", "A", [], "ACGT", "IIII"), ("t", 1, "B", "B", [], "AC", "!!")], "src string, ord bigint, read_id string, header string, ann array<struct<k:string,v:string>>, seq string, qual string")
    rows.write.parquet(str(tmp_path / "in"))
    q = streaming.run_on_stream(spark, str(tmp_path / "in"), rows.schema, lambda s: filters.quality(s, 20).where("valid"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert [r["read_id"] for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("read_id")).collect()] == ["A"]


def test_fastq_qualities_that_look_like_headers(spark, tmp_path):
    want = [(f"R{i}", "ACGT" * 5, ("@" if i % 3 else "I") + "I" * 19) for i in range(400)]
    (tmp_path / "a.fastq").write_text("".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in want))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = IO.read_fastq(spark, str(tmp_path / "a.fastq")).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["header"], r["seq"], r["qual"]) for r in got] == want


def test_fastq_empty_sequences_and_odd_lines(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@a\nAC\n+\nII\n@b\n\n+\n\n@c\nA\n+\n@\n@d\r\nACG\r\n+\r\n@@I\r\n@e\n\n+\n\n\n")
    got = [(r["header"], r["seq"], r["qual"]) for r in IO.read_fastq(spark, str(tmp_path / "a.fastq")).orderBy("ord").collect()]
    assert got == [("a", "AC", "II"), ("b", "", ""), ("c", "A", "@"), ("d", "ACG", "@@I"), ("e", "", "")]
    (tmp_path / "e.fastq").write_text("@b\n\n+\n")
    assert IO.read_fastq(spark, str(tmp_path / "e.fastq")).first()["seq"] == ""
    for k, text in enumerate(("@a\nAC\n", "@a\nAC\n+\nI\n", "@a\nAC\n+\nII\nACG\n", "@a\nAC\n+\n", "IIII\n")):
        (tmp_path / f"{k}.fastq").write_text(text)
        with pytest.raises(Exception, match="FASTQ|differ|without"):
            IO.read_fastq(spark, str(tmp_path / f"{k}.fastq")).collect()


def test_headers_of_very_many_fields(spark):
    text = "X|" + "|".join(f"F{i}={i}" for i in range(10_050))
    got = spark.createDataFrame([(text,)], "h string").select(F.size(A.parse(F.col("h"))).alias("n"), F.length(H.genbank(F.lit("x " * 10_050 + "x"))["ann"][0]["v"]).alias("m")).first()
    assert (got["n"], got["m"]) == (10_050, 10_050 * 2 - 1)
