"""Error rates of sets of reads against their consensus, and distances between barcodes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmill.functions import annotation as A
from readmill.functions import sequence as S
from readmill.operators import consensus as C
from readmill.operators import profiles
from readmill.schema import checkpointed


def usable_sets(reads: DataFrame, field: str = "BARCODE", least: int = 20, most_diversity: float | None = None) -> DataFrame:
    """Reads of sets of at least `least` reads that all have one length (and, if asked, are alike enough)."""
    sets = C.with_set(reads, field)
    good = sets.groupBy("set_id").agg(F.count("*").alias("n"), F.min(F.length("seq")).alias("a"), F.max(F.length("seq")).alias("b")).where((F.col("n") >= least) & (F.col("a") == F.col("b")))
    out = sets.join(good.select("set_id", F.col("n").alias("set_n")), "set_id")
    if most_diversity is not None:
        out = out.join(C.diversity(sets).where(F.col("diversity") <= most_diversity), "set_id", "left_semi")
    return out


def compared(sets: DataFrame, consensus: DataFrame) -> DataFrame:
    """pos, obs, ref, q, set_n, wrong, n: how often letters met the consensus, where neither is missing; N and gaps never differ.

    A set's consensus (set_id, seq) meets each of its reads as one text, and tasks give sums of equal letters.
    """
    refs = consensus.select("set_id", F.col("seq").alias("ref"))
    joined = sets.join(refs, "set_id").select(F.upper("seq").alias("seq"), "qual", "ref", F.col("set_n").cast("bigint").alias("set_n"))
    return joined.mapInArrow(profiles.compare, "pos int, obs string, ref string, q int, set_n bigint, wrong boolean, n bigint")


def _rates(counts: DataFrame, *keys: str) -> DataFrame:
    error = F.when(F.col("mismatch") > 0, F.col("mismatch") / F.col("total")).otherwise(F.lit(1e-9))
    return counts.withColumn("error", error).withColumn("empirical_q", -10 * F.log10("error")).withColumn("reported_q", F.col("q_sum") / F.col("total")).select(*keys, "mismatch", "total", "q_sum", "error", "empirical_q", "reported_q")


def error_table(letters: DataFrame, by: str) -> DataFrame:
    """mismatch, total, q_sum, error, empirical_q and reported_q by position (pos), quality (q) or size of the set (set_n)."""
    return _rates(letters.groupBy(by).agg(F.sum(F.when(F.col("wrong"), F.col("n")).otherwise(0)).alias("mismatch"), F.sum("n").alias("total"), F.sum(F.col("q") * F.col("n")).alias("q_sum")), by)


def nucleotide_table(letters: DataFrame) -> DataFrame:
    """ref, obs and rates of each pair of different bases; totals are those of the reference base among observed letters, and the rate counts three ways to be wrong."""
    base = F.col("ref").isin(*"ACGT") & F.col("obs").isin(*"ACGT")
    pairs = letters.where(base & (F.col("ref") != F.col("obs"))).groupBy("ref", "obs").agg(F.sum("n").alias("mismatch"))
    totals = letters.where(base).groupBy(F.col("obs").alias("ref")).agg(F.sum("n").alias("total"), F.sum(F.col("q") * F.col("n")).alias("q_sum"))
    out = _rates(pairs.join(totals, "ref"), "ref", "obs")
    return out.withColumn("error", F.col("error") * 3).withColumn("empirical_q", -10 * F.log10("error"))


#: Longest values whose pairs are counted by subsets of places, and values of a block of longer ones.
SUBSET_LENGTH, BLOCK_ROWS = 12, 2000


def pair_distances(values: DataFrame, value: str, pad: str = "none") -> DataFrame:
    """distance, length and n of all pairs of values of a table (repeats count as often as they occur).

    Equal values are joined into one with a weight; `pad` none leaves out values shorter than the longest, head and tail
    fill them with N.  Values of up to SUBSET_LENGTH letters are never paired: see _by_subsets.  Longer ones are compared
    in blocks.
    """
    distinct = checkpointed(values.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("w")))  # values are made once
    longest = distinct.agg(F.max(F.length("v"))).first()[0] or 0
    if pad == "none":
        weighted = distinct.where(F.length("v") == longest)
    else:
        padded = (F.lpad if pad == "head" else F.rpad)(F.col("v"), longest, "N")
        weighted = distinct.where("v is not null").groupBy(padded.alias("v")).agg(F.sum("w").alias("w"))
    if longest <= SUBSET_LENGTH:
        out = _by_subsets(weighted, longest)
    else:
        own = weighted.select(F.lit(0).alias("distance"), (F.col("w") * (F.col("w") - 1) / 2).cast("bigint").alias("n"))
        blocks = max(1, -(-weighted.count() // BLOCK_ROWS))
        out = own.unionByName(_by_blocks(weighted.select(F.lit("").alias("set_id"), "v", "w", F.lit(blocks).alias("blocks"))).select("distance", "n"))
    return out.groupBy("distance").agg(F.sum("n").alias("n")).where("n > 0").withColumn("length", F.lit(longest))


def _by_subsets(weighted: DataFrame, length: int) -> DataFrame:
    """distance, n of all pairs of values, which all have `length` letters, by grouped sums alone.

    Values are grouped by their letters at every subset of places, which gives the pairs that agree at these places at
    least; taking subsets of equal size together, pairs that agree at exactly k places follow by inclusion and exclusion.
    Places are blotted out two at a time and what is equal then is summed at once, so rows never exceed the number of
    different texts with blots, of which there are 5**length of four letters whatever the number of values.
    """
    grouped = weighted.select(F.col("v").alias("key"), "w")
    for i in range(0, length, 2):
        blot = lambda x, k: F.overlay(x, F.lit("\t"), F.lit(k + 1), F.lit(1))
        kinds = [F.col("key"), blot(F.col("key"), i)]
        kinds += [blot(x, i + 1) for x in kinds] if i + 1 < length else []
        grouped = grouped.select(F.explode(F.array(*kinds)).alias("key"), "w").groupBy("key").agg(F.sum("w").alias("w"))
    size = F.length(F.translate("key", "\t", ""))
    weight = F.col("w").cast("decimal(19,0)")
    agreeing = grouped.groupBy(size.alias("size")).agg(F.sum((weight * (weight - 1) / 2).cast("decimal(38,0)")).alias("pairs"))
    factors = [(j, length - k, (-1) ** (j - k) * math.comb(j, k)) for j in range(length + 1) for k in range(j + 1)]
    table = weighted.sparkSession.createDataFrame(factors, "size int, distance int, factor bigint")
    return agreeing.join(F.broadcast(table), "size").groupBy("distance").agg(F.sum(F.col("pairs") * F.col("factor")).cast("bigint").alias("n"))


def _by_blocks(weighted: DataFrame) -> DataFrame:
    """set_id, length, distance, n of pairs of different values within each set, from rows set_id, v, w, blocks.

    A set's values are dealt into blocks; every pair of blocks, and every block with itself, is a cell that one task
    compares in numpy, and only sums by distance leave it.
    """
    k = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    dealt = weighted.select("set_id", "v", "w", k.alias("k"), F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("other"))
    cells = dealt.select("set_id", "v", "w", "k", F.least("k", "other").alias("a"), F.greatest("k", "other").alias("b"))

    def count(cell: pa.Table) -> pa.Table:
        block, values = cell["k"].to_numpy(), cell["v"].to_pylist()
        length, weight = len(values[0]), cell["w"].to_numpy().astype(object)  # whole numbers of any size
        codes = np.frombuffer("".join(values).encode("utf-32-le"), "<u4").reshape(-1, length)
        low = block == cell["a"][0].as_py()
        sides = [np.flatnonzero(low), np.flatnonzero(~low)] if not low.all() else [np.arange(len(values))] * 2
        total = [0] * (length + 1)
        for row, i in enumerate(sides[0].tolist()):
            others = sides[1] if not low.all() else sides[1][row + 1 :]
            far = (codes[others] != codes[i]).sum(axis=1)
            for d in np.unique(far).tolist():
                total[d] += int(weight[i]) * int(weight[others[far == d]].sum())
        used = [d for d, n in enumerate(total) if n]
        return pa.table({"set_id": pa.array([cell["set_id"][0].as_py()] * len(used), pa.string()), "length": pa.array([length] * len(used), pa.int32()), "distance": pa.array(used, pa.int32()), "n": pa.array([total[d] for d in used], pa.int64())})

    return cells.groupBy("set_id", "a", "b").applyInArrow(count, "set_id string, length int, distance int, n bigint")


def barcode_distances(reads: DataFrame, field: str = "BARCODE", pad: str = "none") -> DataFrame:
    """Histogram of the distances of all pairs of barcodes."""
    values = reads.select(F.inline(F.array(F.struct(A.get(F.col("ann"), field).alias("v")))))  # so that the filter doesn't make them again
    return pair_distances(values.where("v is not null"), "v", pad)


def bin_table(length: int, bins: int) -> list[int]:
    """Bin of each distance 0..length among equal bins of the shares 0..1, the last one closed; as numpy's histogram has it."""
    shares = np.arange(length + 1) / max(1, length)
    return [int(np.histogram([x], bins=bins, range=(0.0, 1.0))[0].argmax()) for x in shares]


def set_distances(sets: DataFrame, bins: int = 50) -> DataFrame:
    """bin, n: histogram of the shares of unequal letters over all pairs of reads of one set, for sets of reads of equal lengths.

    Equal reads of a set are one with a weight, so only distinct ones are compared: in numpy by the task that has the set, or
    one block of BLOCK_ROWS of them with another.  Pairs are never rows.
    """
    weighted = sets.groupBy("set_id", F.upper("seq").alias("v")).agg(F.count("*").alias("w"))
    own = weighted.select(F.lit(0).alias("d"), F.length("v").alias("len"), (F.col("w") * (F.col("w") - 1) / 2).cast("bigint").alias("n"))
    sizes = weighted.groupBy("set_id").agg(F.count("*").alias("c")).where("c > 1").select("set_id", F.ceil(F.col("c") / BLOCK_ROWS).alias("blocks"))
    pairs = _by_blocks(weighted.join(sizes, "set_id")).select(F.col("distance").alias("d"), F.col("length").alias("len"), "n")
    counted = checkpointed(own.unionByName(pairs).where("n > 0").groupBy("len", "d").agg(F.sum("n").alias("n")))
    lengths = [r["len"] for r in counted.select("len").distinct().collect()]  # as many as reads have lengths
    spark = sets.sparkSession
    table = spark.createDataFrame([(k, d, b) for k in lengths for d, b in enumerate(bin_table(k, bins))] or [(0, 0, 0)], "len int, d int, bin int")
    return counted.join(F.broadcast(table), ["len", "d"]).groupBy("bin").agg(F.sum("n").alias("n"))


def set_threshold(histogram: DataFrame, bins: int = 50) -> float:
    """Share at which a set histogram is lowest, among the first three quarters of what follows its highest bin, counted from that bin; of ties the mean."""
    counts = [0] * bins
    for r in histogram.collect():  # a row a bin
        counts[r["bin"]] = r["n"]
    rest = counts[counts.index(max(counts)) :]
    head = rest[: int(0.75 * len(rest))] or rest[:1]
    low = [i for i, n in enumerate(head) if n == min(head)]
    return int(sum(low) / len(low)) / bins


def distance_threshold(histogram: DataFrame) -> float:
    """Share of the length at which the histogram is lowest, among its first three quarters; of ties the mean."""
    rows = histogram.select("distance", "n", "length").collect()  # a row a distance, so no more than a barcode is long
    if not rows:
        return 0.0
    bins = [0] * (rows[0]["length"] + 1)
    for r in rows:
        bins[r["distance"]] = r["n"]
    head = bins[: max(1, int(0.75 * len(bins)))]
    low = [i for i, n in enumerate(head) if n == min(head)]
    return int(sum(low) / len(low)) / len(bins)
