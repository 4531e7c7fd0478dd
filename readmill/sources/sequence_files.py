"""FASTA and FASTQ files as tables of reads, and back; plain, gzip or block gzip."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.functions import annotation as A
from readmill.schema import ANN
from readmill.sources.blocks import write_blocks
from readmill.sources.scan import scan

KINDS = {"fasta": ("fasta", "fna", "fa"), "fastq": ("fastq", "fq"), "table": ("tab", "tsv")}


def file_kind(path: str) -> str:
    """fasta, fastq or table by a file's extension (gz aside), else the extension."""
    ext = os.path.splitext(path.removesuffix(".gz"))[1].lstrip(".").lower()
    return next((k for k, v in KINDS.items() if ext in v), ext)


def _reads(rows: DataFrame, parse: bool, delimiters: tuple[str, str, str]) -> DataFrame:
    ann = A.parse(F.col("header"), delimiters) if parse else F.array().cast(ANN)
    return rows.select("src", "ord", A.read_id(F.col("header"), delimiters).alias("read_id"), "header", ann.alias("ann"), "seq", "qual")


def read_fasta(spark: SparkSession, path: str, parse: bool = True, delimiters: tuple[str, str, str] = A.DELIMITERS) -> DataFrame:
    """Reads of FASTA files; sequences may go over several lines. ord follows the file's order.

    Plain files are Spark's text with the records' start as separator; what is packed is read by scan.
    """
    if path.endswith(".gz"):
        return _reads(scan(spark, path, "fasta"), parse, delimiters)
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("src"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "^>", "").alias("body"))
    # a split's first byte, and a row's place in its task, which is less than a split has bytes
    rows = rows.where(F.trim(F.col("body")) != "").withColumn("ord", F.col("block") + F.col("id").bitwiseAND((1 << 33) - 1))
    head = F.regexp_extract("body", r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("body", r"^[^\n]*\n?", ""), r"\s", "")
    return _reads(rows.select("src", "ord", head.alias("header"), seq.alias("seq"), F.lit(None).cast("string").alias("qual")), parse, delimiters)


def read_fastq(spark: SparkSession, path: str, parse: bool = True, delimiters: tuple[str, str, str] = A.DELIMITERS) -> DataFrame:
    """Reads of FASTQ files; letters and qualities may go over several lines and be empty, blank lines between records are ignored.

    Plain files and block gzip are read by ranges that get into step with the records by themselves (scan); other gzip files
    by one task each.  Anything that isn't a record, and qualities that are not as many as letters, raise an error when read.
    """
    return _reads(scan(spark, path, "fastq"), parse, delimiters)


def read_sequences(spark: SparkSession, path: str, parse: bool = True, delimiters: tuple[str, str, str] = A.DELIMITERS) -> DataFrame:
    """Reads of a file by its extension; other kinds raise an error."""
    match file_kind(path):
        case "fasta":
            return read_fasta(spark, path, parse, delimiters)
        case "fastq":
            return read_fastq(spark, path, parse, delimiters)
    raise ValueError(f"{path} is neither FASTA nor FASTQ")


def read_primers(spark: SparkSession, path: str) -> dict[str, str]:
    """Names and upper-case sequences of a primer file, in order; white space, comma, = and | in names become _."""
    rows = read_fasta(spark, path, parse=False).select("ord", F.regexp_replace("header", r"[\s,=|]+", "_").alias("name"), F.upper("seq").alias("seq"))
    return {r["name"]: r["seq"] for r in rows.orderBy("ord").collect()}  # a file of primers, which plans take as parameters


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """name and seq (upper case, without gaps) of reference sequences."""
    return read_fasta(spark, path, parse=False).select(F.element_at(F.split("header", r"\s"), 1).alias("name"), F.upper(F.translate("seq", "-.", "")).alias("seq"))


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """primer and offset of a table without a header."""
    return spark.read.csv(path, sep="\t", schema="primer string, offset int")


def read_values(spark: SparkSession, path: str, field: str) -> DataFrame:
    """A field's column of a table with a header."""
    return spark.read.csv(path, sep="\t", header=True).select(field)


def read_log(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """Blocks of `KEY> value` lines as a map (`entry`), or as columns if fields are given; lines without exactly one `> ` don't count."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).where(F.trim(F.col("value")) != "")
    parts = F.filter(F.transform(F.split("value", "\n"), lambda x: F.split(F.trim(x), "> ")), lambda p: F.size(p) == 2)
    entry = F.map_from_entries(F.transform(parts, lambda p: F.struct(F.trim(p[0]), p[1])))
    out = blocks.select(F.monotonically_increasing_id().alias("ord"), entry.alias("entry"))
    return out.select("ord", *(F.coalesce(F.col("entry")[f], F.lit("")).alias(f) for f in fields)) if fields else out


def count_records(reads: DataFrame) -> int:
    """Number of reads; none is an error."""
    n = reads.count()
    if not n:
        raise ValueError("no records")
    return n


def count_sets(reads: DataFrame, field: str) -> DataFrame:
    """Number of distinct values of a field."""
    return reads.agg(F.count_distinct(A.get(F.col("ann"), field)).alias("sets"))


def header_text(reads: DataFrame) -> Column:
    return A.flatten(F.col("read_id"), F.col("ann"))


def record_text(kind: str, header: Column) -> Column:
    """A read as FASTA or FASTQ lines."""
    if kind == "fasta":
        return F.concat(F.lit(">"), header, F.lit("\n"), F.col("seq"))
    return F.concat(F.lit("@"), header, F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.coalesce("qual", F.rpad(F.lit(""), F.length("seq"), "!")))


def write_sequences(reads: DataFrame, path: str, kind: str = "fastq", compress: bool = False, by: str | None = None, delimiters: tuple[str, str, str] = A.DELIMITERS, ordered: bool = False) -> None:
    """Reads as text files in a folder; by: a folder for each value of a column.

    compress: block gzip, which is read in ranges again (with `by`, Spark's gzip).  ordered: files that give all reads in
    their files' order when they are put together by name; rows are sorted by ranges of it.
    """
    if ordered:
        reads = reads.repartitionByRange("src", "ord").sortWithinPartitions("src", "ord")
    header = A.flatten(F.col("read_id"), F.col("ann"), delimiters)
    rows = reads.select(record_text(kind, header).alias("value"), *([by] if by else []))
    if by:
        rows.write.option("compression", "gzip" if compress else "none").partitionBy(by).text(path)
    elif compress:
        write_blocks(rows, path)
    else:
        rows.write.text(path)


def write_log(logs: DataFrame, path: str) -> None:
    """Rows as blocks of `KEY> value` lines, keys set flush right."""
    width = max(map(len, logs.columns))
    lines = [F.concat(F.lit(f"{c.rjust(width)}> "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in logs.columns]
    logs.select(F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("value")).write.text(path)


def write_table(rows: DataFrame, path: str, null: str = "") -> None:
    """A table with a header, tabs between columns, as text files in a folder; numbers that aren't whole have six decimals."""
    columns = [F.format_string("%.6f", c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]
    shown = [F.when(F.col(c).isNotNull(), x).alias(c) for c, x in zip(rows.columns, columns, strict=True)]
    rows.select(*shown).write.csv(path, sep="\t", header=True, nullValue=null)


def output_path(source: str, label: str, kind: str, folder: str | None = None, name: str | None = None, compress: bool = False) -> str:
    """Where an operator's output goes: the source's stem or a given name, a label and the kind's extension."""
    base = source.removesuffix(".gz")
    stem = name or os.path.splitext(os.path.basename(base))[0]
    return os.path.join(folder if folder is not None else os.path.dirname(source), f"{stem}_{label}.{kind}{'.gz' if compress else ''}")
