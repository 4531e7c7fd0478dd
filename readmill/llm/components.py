"""Connected components by alternating star steps; every step is a join and a grouped minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmill.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node that has an edge: root is the smallest node that it can reach.

    Large-star links a node's larger neighbours to its smallest one, small-star its smaller neighbours and itself; the
    edges become stars in a number of rounds that grows with the logarithm of the graph.  Grouped minima are combined
    before the shuffle and joined back, so a hub's neighbours are never gathered.  Each round is written to the shared
    folder.  Nulls have no edges.
    """
    now = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        star = large.join(low, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = stored(star.unionByName(low.withColumnRenamed("low", "v")).distinct())
        if mark == (mark := _mark(now)):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
