"""The shape of reads as DataFrames, and constants that operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Annotations are an ordered array of key and value, without the id.
ANN = "array<struct<k:string,v:string>>"
READS = f"src string, ord bigint, read_id string, header string, ann {ANN}, seq string, qual string"

# Letters that stand for no base, and sets of bases of the IUPAC nucleotide codes.
GAPS, MISSING, MISSING_UPPER = "-.", "-.nN", "-.N"
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
#: Four bits a letter: which of A, C, G, T it may be.
MASKS = {c: sum(1 << "ACGT".index(b) for b in bases) for c, bases in IUPAC.items()}
COMPLEMENT = ("ACGTUacgtuRYKMBVDHrykmbvdh", "TGCAAtgcaaYRMKVBHDyrmkvbhd")


def chars(col: Column) -> Column:
    """The characters of a string; none of an empty one."""
    return F.when(F.length(col) > 0, F.split(col, "")).otherwise(F.array().cast("array<string>"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; without spark.checkpoint.dir only a local master has one, of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="readmill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that its lineage ends there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def upper_fields(fields: list[str] | None) -> list[str]:
    """Field names as annotations have them."""
    return [f.upper() for f in fields or []]
