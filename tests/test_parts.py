"""Parts of sorted groups, against the pass in order."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readmill.functions import annotation as A
from readmill.operators import parts, split
from readmill.schema import READS


def in_order(sizes: list[int], most: int) -> list[int]:
    part, held, out = 1, 0, []
    for size in sizes:
        if held and held + size > most:
            part, held = part + 1, 0
        held += size
        out.append(part)
    return out


@pytest.mark.parametrize("most, largest, n", [(1, 1, 40), (5, 3, 200), (7, 30, 120), (50, 4, 300), (10_000, 9, 100), (3, 3, 1)])
def test_jumps_give_what_the_pass_gives(spark, most, largest, n):
    draw = random.Random(most * n)
    sizes = [draw.randint(1, largest) for _ in range(n)]
    table = spark.createDataFrame(list(enumerate(sizes)), "k int, size bigint").orderBy(F.rand(3))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = parts.opened(table, [F.col("k")], most).orderBy("k").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [(r["k"], r["size"], r["part"]) for r in got] == [(k, c, p) for k, (c, p) in enumerate(zip(sizes, in_order(sizes, most), strict=True))]


def test_last_openings_of_a_range():
    sizes = np.array([2, 3, 1, 4, 1, 1])
    starts = np.cumsum(sizes) - sizes
    following = parts._next(starts, sizes, 4)
    assert following.tolist() == [1, 3, 3, 4, 6, 6]
    assert [x.tolist() for x in parts._last(following)] == [[4, 4, 4, 4, 4, 5], [3, 2, 2, 1, 0, 0]]


def test_reads_without_the_field_and_no_reads(spark):
    rows = [("s", i, f"r{i}", f"r{i}", [("N", v)] if v else [], "A", "I") for i, v in enumerate(["b", None, "a", None, "b"])]
    reads = spark.createDataFrame(rows, READS)
    got = {r["ord"]: r["part"] for r in split.sorted_parts(reads, "N", 3).collect()}
    assert got == {1: 1, 3: 1, 2: 1, 0: 2, 4: 2}
    assert split.sorted_parts(reads.limit(0), "N", 3).select("ord", "part").collect() == []
    assert reads.select(A.get(F.col("ann"), "N").alias("v")).where("v is null").count() == 2
