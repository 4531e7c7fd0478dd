"""Reads made from the `orders` table by expressions that Spark and DuckDB evaluate alike, so queries can be held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.functions import annotation as A

HEX, DNA = "0123456789abcdef", "ACGTACGTACGTACGT"
#: Primers that reads are made with, and as they are searched.
PRIMERS = {"F": "CACGTNTTAG", "O": "GGCRTTACAY", "P": "TTGACWGGAA"}


def _dna(text: str) -> str:
    return f"translate({text}, '{HEX}', '{DNA}')"


#: ord, header, barcode, prim, sample, cnt, seq (barcode, primer, 48 letters), qual, frag (a read of varying length).
READS = f"""
SELECT *, CASE WHEN ord % 4 = 0 THEN 'NN' || substr(seq, 1, 40 + CAST(ord % 27 AS INT)) || 'N' ELSE substr(seq, 1, 40 + CAST(ord % 27 AS INT)) END AS frag,
  'M01:' || ord || '|BARCODE=' || barcode || '|PRIMER=' || prim || '|SAMPLE=' || sample || '|COUNT=' || cnt AS header
FROM (
  SELECT ord, barcode, prim, sample, cnt, qual, barcode || primer || CASE WHEN ord % 3 = 0
    THEN substr(t, 1, CAST(ord % 48 AS INT)) || substr('ACGTN', 1 + CAST(ord % 5 AS INT), 1) || substr(t, 2 + CAST(ord % 48 AS INT)) ELSE t END AS seq
  FROM (
    SELECT o_orderkey AS ord, substr({_dna("md5('b' || o_custkey)")}, 1, 8) AS barcode, o_orderstatus AS prim,
      'S' || substr(o_orderpriority, 1, 1) AS sample, (o_orderkey % 7 + 1) || ',' || (o_orderkey % 5) AS cnt,
      substr(translate(md5('q' || o_orderkey) || md5('r' || o_orderkey) || md5('s' || o_orderkey), '{HEX}', '!*/5:=?ABCDEFGHI'), 1, 66) AS qual,
      CASE WHEN o_orderkey % 11 = 0 THEN 'NNN' WHEN o_orderkey % 5 = 0 THEN substr(p, 1, 2) || 'T' ELSE substr(p, 1, 3) END || substr(p, 4) AS primer,
      substr({_dna("md5('t' || o_custkey) || md5('u' || o_custkey)")}, 1, 48) AS t
    FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'CACGTATTAG' WHEN 'O' THEN 'GGCATTACAC' ELSE 'TTGACTGGAA' END AS p FROM {{orders}})
  )
)
"""

#: Mates of the reads: seq1 is the first 40 letters, seq2 the reverse complement of the last 40; every tenth has no second mate.
MATES = """
SELECT ord, 'M01:1:FC:1:1101:' || ord || ':' || (ord % 1000) AS coord, substr(seq, 1, 40) AS seq1, substr(qual, 1, 40) AS qual1,
  reverse(translate(substr(seq, 27, 40), 'ACGT', 'TGCA')) AS seq2, reverse(substr(qual, 27, 40)) AS qual2, barcode, prim, cnt
FROM reads
"""

#: References of the reads' templates, by customer, behind 18 other letters: one letter less or more in the middle of two thirds of them.
REFERENCES = f"""
SELECT 'ref' || c_custkey AS name, lead || substr(t, 1, 29) || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN substr(t, 30, 1) ELSE substr(t, 30, 1) || 'A' END || substr(t, 31) AS seq
FROM (SELECT c_custkey, substr({_dna("md5('w' || c_custkey)")}, 1, 18) AS lead, substr({_dna("md5('t' || c_custkey) || md5('u' || c_custkey)")}, 1, 48) AS t FROM {{customer}})
"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def plain_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(READS, orders=_orders(spark, sf_dir))


def reads(spark: SparkSession, sf_dir: str, seq: str = "seq") -> DataFrame:
    """The reads in the shape that operators take."""
    rows = plain_reads(spark, sf_dir)
    return rows.select(F.lit("orders").alias("src"), "ord", A.read_id(F.col("header")).alias("read_id"), "header", A.parse(F.col("header")).alias("ann"), F.col(seq).alias("seq"), "qual")


def mates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """First and second mates, with the barcode on the first and primer and count on the second."""
    rows = spark.sql(MATES.replace("FROM reads", "FROM {reads}"), reads=plain_reads(spark, sf_dir))
    one = rows.select(F.lit("r1").alias("src"), "ord", F.concat("coord", F.lit(" 1:N:0:ACGT")).alias("header"), A.pairs({"BARCODE": F.col("barcode"), "COUNT": F.col("cnt")}).alias("ann"), F.col("seq1").alias("seq"), F.col("qual1").alias("qual"))
    two = rows.where("ord % 10 <> 0").select(F.lit("r2").alias("src"), "ord", F.concat("coord", F.lit(" 2:N:0:ACGT")).alias("header"), A.pairs({"PRIMER": F.col("prim"), "COUNT": F.col("cnt")}).alias("ann"), F.col("seq2").alias("seq"), F.col("qual2").alias("qual"))
    return tuple(x.withColumn("read_id", F.col("header")) for x in (one, two))


def oracle(sql: str) -> str:
    """A query over `reads` and `mates` as SQL over the tables."""
    return f"WITH {'RECURSIVE ' * (' walk ' in sql or 'walk (' in sql)}reads AS ({READS.format(orders='orders')}), mates AS ({MATES}) {sql}"
