"""Parts, groups, samples, selections and orders of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readmill.functions import annotation as A
from readmill.operators.pairing import keyed
from readmill.operators.parts import opened
from readmill.schema import checkpointed


def numbered(reads: DataFrame, order: list[Column], name: str = "_n") -> DataFrame:
    """Rows numbered from 0 in an order, without one task seeing all of them.

    Rows are dealt by ranges of the order and sorted; a running count within a range is then moved on by the sizes of the
    ranges before it, of which there is one number a partition.
    """
    spark = reads.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_k{i}" for i in range(len(order))]
    dealt = reads.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # within a partition ids go up by one in the sorted order, from the partition's number times 2**33
    marked = dealt.withColumn("_m", F.monotonically_increasing_id()).withColumns({"_p": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND((1 << 33) - 1)})
    marked = checkpointed(marked)
    sizes = marked.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))
    return marked.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i")).drop(*keys, "_m", "_p", "_i", "_before")


def by_count(reads: DataFrame, most: int) -> DataFrame:
    """`part` from 1: runs of at most so many reads in file order."""
    return numbered(reads, [F.col("ord")]).withColumn("part", (F.floor(F.col("_n") / most) + 1).cast("int")).drop("_n")


def by_group(reads: DataFrame, field: str, threshold: float | None = None) -> DataFrame:
    """`part`: the field's value, or with a threshold `under` or `atleast` (an empty value counts as 0)."""
    value = A.get(F.col("ann"), field)
    if threshold is None:
        return reads.withColumn("part", value)
    number = F.coalesce(F.nullif(value, F.lit("")).cast("double"), F.lit(0.0))
    return reads.withColumn("part", F.when(number < threshold, "under").otherwise("atleast"))


def _draw(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in cols), F.lit(str(seed))))


def sample(reads: DataFrame, n: int, field: str | None = None, values: list[str] | None = None, seed: int = 0) -> DataFrame:
    """n reads drawn without replacement (all, if fewer): of all, of those with one of the values, or of each of the field's values.

    The draw is the order of a hash of ord and seed, so it can be repeated; a group's first n are kept before the shuffle.
    """
    value = A.get(F.col("ann"), field) if field else F.lit("")
    rows = reads.withColumns({"_v": value, "_d": _draw(seed, "ord")})
    if field:
        rows = rows.where(F.col("_v").isin(values) if values else F.col("_v").isNotNull())
    if not field or values:
        return rows.orderBy("_d", "ord").limit(n).drop("_v", "_d")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("_v").orderBy("_d", "ord"))).where(F.col("_r") <= n).drop("_v", "_d", "_r")


def sample_pairs(first: DataFrame, second: DataFrame, n: int, field: str | None = None, kind: str = "annotated", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """n pairs drawn among keys that both sides have (with a field: n of each value that both mates share)."""
    one, two = keyed(first, kind), keyed(second, kind)
    value = lambda: A.get(F.col("ann"), field) if field else F.lit("")
    both = one.select("coord", value().alias("_v")).join(two.select("coord", value().alias("_v")), ["coord", "_v"]).distinct()
    ranked = both.withColumn("_r", F.row_number().over(Window.partitionBy("_v").orderBy(_draw(seed, "coord"), "coord"))).where(F.col("_r") <= n) if field else both.orderBy(_draw(seed, "coord"), "coord").limit(n)
    keys = ranked.select("coord")
    return one.join(keys, "coord", "left_semi"), two.join(keys, "coord", "left_semi")


def select(reads: DataFrame, field: str, values: list[str] | DataFrame, negate: bool = False) -> DataFrame:
    """Reads any of whose listed values is among the given ones (negate: none is); values may be a table of one column.

    A table is joined by its values, so it may be as large as the reads.
    """
    own = A.values(A.get(F.col("ann"), field)) if field.upper() != "ID" else A.values(F.col("read_id"))
    if isinstance(values, list):
        hit = F.coalesce(F.arrays_overlap(own, F.array(*map(F.lit, values)).cast("array<string>")), F.lit(False))
        return reads.where(~hit if negate else hit)
    wanted = values.select(F.col(values.columns[0]).cast("string").alias("_v")).distinct()
    hits = reads.select("ord", F.explode(own).alias("_v")).join(wanted, "_v", "left_semi").select("ord").distinct()
    return reads.join(hits, "ord", "left_anti" if negate else "left_semi")


def sort(reads: DataFrame, field: str, numeric: bool = False) -> DataFrame:
    """Reads in ascending order of a field as text or as a number (empty: 0), file order within ties."""
    value = A.get(F.col("ann"), field)
    return reads.orderBy(F.coalesce(F.nullif(value, F.lit("")).cast("double"), F.lit(0.0)) if numeric else value, "ord")


def sorted_parts(reads: DataFrame, field: str, most: int, numeric: bool = False) -> DataFrame:
    """`part` from 1 of reads in a field's order; ties stay in one part, and a new part opens where the next ties would overfill it.

    Only sizes of ties are looked at in order, by jumps from range to range (parts.opened).  Reads without the field come first.
    """
    value = A.get(F.col("ann"), field)
    rows = reads.withColumn("_v", F.coalesce(F.nullif(value, F.lit("")).cast("double"), F.lit(0.0)) if numeric else value)
    dealt = opened(rows.groupBy("_v").agg(F.count("*").alias("size")), [F.col("_v")], most)
    dealt = dealt.select(F.col("_v").alias("_w"), "part")
    return rows.join(dealt, F.col("_v").eqNullSafe(F.col("_w"))).drop("_v", "_w")
