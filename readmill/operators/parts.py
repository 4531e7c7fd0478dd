"""Parts of sorted groups that never split a group: the sequential pass over sizes, as jumps that compose over ranges.

Groups lie in a row, and a group's first row says where it is.  When a part opens at one, the next part opens at the group
that has the row `most` behind it (at least at the next group).  So within a range of groups, every group leads to a last
opening in that range, and from there to a first one in a later range.  Openings that lead on are linked from range to
range, and links are squared, so that the chain from the first group is found in as many rounds as the number of ranges has
bits.  It has one opening a range at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readmill.schema import checkpointed


def _next(starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """For each group of a range, the place of the group at which the next part opens; the range's length if behind it."""
    return np.maximum(np.searchsorted(starts + sizes, starts + most, "right"), np.arange(1, len(starts) + 1))


def _last(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group of a range, the place of the last opening that it leads to there, and how many openings follow it."""
    n = len(following)
    more = (following < n).astype(np.int64)
    to = np.where(more, following, np.arange(n))
    while more[to].any():
        more, to = more + more[to], to[to]
    return to, more


def _whole(function: Callable[[pa.Table], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of a whole range, as a partition has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if sum(b.num_rows for b in got):
            yield from function(pa.Table.from_batches(got)).to_batches()

    return run


def opened(sizes: DataFrame, order: list[Column], most: int) -> DataFrame:
    """Rows of sizes, which have a column `size`, with `part` from 1, by an order that tells groups apart.

    A task holds a range's first rows and sizes; what all tasks get is a row for each range.
    """
    spark = sizes.sparkSession
    keys = [f"_k{i}" for i in range(len(order))]
    dealt = sizes.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    groups = checkpointed(dealt.sortWithinPartitions(*keys).drop(*keys).withColumn("_range", F.spark_partition_id()))
    totals = groups.groupBy("_range").agg(F.sum("size").alias("n"))
    firsts = totals.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("first"), "n").orderBy("_range").collect()  # a row a range
    ranges, begins = np.array([r["_range"] for r in firsts], np.int64), np.array([r["first"] for r in firsts], np.int64)
    begin_of = dict(zip(ranges.tolist(), begins.tolist(), strict=True))
    if not begin_of:
        return groups.drop("_range").withColumn("part", F.lit(1))

    def placed(rows: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
        at, size = rows["_range"][0].as_py(), rows["size"].to_numpy()
        return at, begin_of[at] + np.cumsum(size) - size, size

    def leading(rows: pa.Table) -> pa.Table:
        """The last openings of a range, and the row in a later one at whose group the next part opens."""
        _, starts, size = placed(rows)
        last = np.unique(_last(_next(starts, size, most))[0])
        row = starts[last] + np.maximum(most, size[last])
        to = ranges[np.searchsorted(begins, row, "right") - 1]
        keep = row < begins[-1] + firsts[-1]["n"]
        return pa.table({"opening": starts[last][keep], "row": row[keep], "_range": pa.array(to[keep], pa.int32())})

    def landing(wanted: pa.Table, rows: pa.Table) -> pa.Table:
        """Where that is, and the last opening to which it leads."""
        if not wanted.num_rows:
            return pa.table({name: pa.array([], pa.int64()) for name in ("opening", "entry", "last", "more")})
        _, starts, size = placed(rows.sort_by("_at"))
        to, more = _last(_next(starts, size, most))
        entry = np.searchsorted(starts, wanted["row"].to_numpy(), "right") - 1
        return pa.table({"opening": wanted["opening"].to_numpy(), "entry": starts[entry], "last": starts[to[entry]], "more": more[entry] + 1})

    light = groups.select("_range", "size")
    leads = light.mapInArrow(_whole(leading), "opening bigint, row bigint, _range int")
    by_order = light.withColumn("_at", F.monotonically_increasing_id())
    links = checkpointed(leads.groupBy("_range").cogroup(by_order.groupBy("_range")).applyInArrow(landing, "opening bigint, entry bigint, last bigint, more bigint"))

    def first(rows: pa.Table) -> pa.Table:
        _, starts, size = placed(rows)
        to, more = _last(_next(starts, size, most))
        return pa.table({"last": starts[to[:1]], "part": more[:1] + 1})

    head = light.where(F.col("_range") == int(ranges[0])).mapInArrow(_whole(first), "last bigint, part bigint")
    reached, jumps = checkpointed(head), links.select("opening", "last", "more")
    for _ in range(int(len(ranges)).bit_length()):
        on = reached.withColumnRenamed("last", "opening").join(jumps, "opening").select("last", (F.col("part") + F.col("more")).alias("part"))
        reached = checkpointed(reached.unionByName(on))
        then = jumps.select(F.col("opening").alias("last"), F.col("last").alias("end"), F.col("more").alias("others"))
        jumps = checkpointed(jumps.join(then, "last").select("opening", F.col("end").alias("last"), (F.col("more") + F.col("others")).alias("more")))
    entries = links.join(reached.withColumnRenamed("last", "opening"), "opening").select("entry", (F.col("part") + 1).alias("part"))
    known = sorted([(0, 1), *((r["entry"], r["part"]) for r in entries.collect())])  # an opening a range at most
    entry_rows, entry_parts = (np.array(x, np.int64) for x in zip(*known, strict=True))

    end = reached.agg(F.max("part")).first()[0]

    def numbered(rows: pa.Table) -> pa.Table:
        _, starts, size = placed(rows)
        k = int(np.searchsorted(entry_rows, starts[0]))  # the range's first opening, or a later range's
        part = np.full(len(starts), entry_parts[k] - 1 if k < len(entry_parts) else end)
        if k < len(entry_rows) and entry_rows[k] <= starts[-1]:
            following, cuts = _next(starts, size, most), [int(np.searchsorted(starts, entry_rows[k]))]
            while (cut := int(following[cuts[-1]])) < len(starts):
                cuts.append(cut)
            part += np.searchsorted(cuts, np.arange(len(starts)), "right")
        return rows.drop_columns("_range").append_column("part", pa.array(part.astype(np.int32)))

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in groups.drop("_range").dtypes)
    return groups.mapInArrow(_whole(numbered), f"{kinds}, part int")
