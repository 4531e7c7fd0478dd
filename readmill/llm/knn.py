"""Approximate nearest neighbours (operator 9): a block matrix join over int8 products with error bounds."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readmill.llm.common import table

OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
#: Rows of a tile: queries and candidates that one task holds at a time; candidates of one product within it.
QUERY_ROWS, CANDIDATE_ROWS, STEP = 4096, 32_768, 4096


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the rows, a scale for each row, and the length of what the codes leave out."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, summed in order as SQL does; where squares leave the range of doubles, by scaled differences."""
    out = np.sqrt(np.add.accumulate(np.square(a - b), axis=1)[:, -1])
    odd = np.flatnonzero(~(np.isfinite(out) & (out > 1e-140)))
    if len(odd):
        quarter = a[odd] / 4 - b[odd] / 4  # differences themselves may be too large
        most = np.abs(quarter).max(axis=1)
        with np.errstate(over="ignore"):
            out[odd] = most * np.sqrt(np.square(quarter / np.where(most > 0, most, 1)[:, None]).sum(axis=1)) * 4
    return out


@np.errstate(over="ignore", invalid="ignore")
def tile_neighbours(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest candidates in this tile of each query, exact.

    Code products are whole numbers below 2**24 for up to 1040 dimensions, so float32 matrix products give them exactly;
    wider vectors use float64.  |d(x, y) - d(x', y')| is at most the two left-out lengths, so a candidate whose lower
    bound exceeds the k-th smallest upper bound can't be among the k; the rest get their distance from the originals, and so
    do pairs whose bounds aren't finite.
    """
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    (qc, qs, qe), (cc, cs, ce) = quantised(q), quantised(c)
    qn, cn = (np.square(qc, dtype=np.int64).sum(1) * qs**2), (np.square(cc, dtype=np.int64).sum(1) * cs**2)
    q_len, c_len = np.sqrt(qn), np.sqrt(cn)
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    bound = np.full(len(q_ids), np.inf)  # k-th smallest upper bound or exact distance so far
    left = qc.astype(kind)
    for at in range(0, len(c_ids), STEP):
        part = slice(at, at + STEP)
        dots = (left @ cc[part].astype(kind).T).astype(np.float64)
        d = np.sqrt(np.maximum(qn[:, None] + cn[None, part] - 2 * qs[:, None] * cs[None, part] * dots, 0))
        slack = qe[:, None] + ce[None, part] + 1e-7 * (q_len[:, None] + c_len[None, part]) + 1e-140  # and what rounding may do
        finite = np.isfinite(d) & np.isfinite(slack)
        own = q_ids[:, None] == c_ids[None, part]
        upper = np.where(own | ~finite, np.inf, d + slack)
        if upper.shape[1] > k:
            bound = np.minimum(bound, np.partition(upper, k - 1, axis=1)[:, k - 1])
        rows, cols = np.nonzero(((d - slack <= bound[:, None]) | ~finite) & ~own)
        for lo in range(0, len(rows), 65_536):
            r, s = rows[lo : lo + 65_536], cols[lo : lo + 65_536] + at
            exact = distances(q[r], c[s])
            for i, score, vec in zip(r.tolist(), exact.tolist(), c_ids[s].tolist(), strict=True):
                item = (-score, -vec)
                if len(heaps[i]) < k:
                    heapq.heappush(heaps[i], item)
                elif item > heaps[i][0]:
                    heapq.heapreplace(heaps[i], item)
        for i, h in enumerate(heaps):
            if len(h) == k:
                bound[i] = min(bound[i], -h[0][0] * (1 + 1e-12))
    return [(q_id, -v, -s) for q_id, h in zip(q_ids.tolist(), heaps, strict=True) for s, v in h]


def usable(vec: Column) -> Column:
    """Not null, not all zero, and without null, NaN or infinite components."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest other rows by Euclidean distance.

    Queries and candidates are dealt into blocks, and each pair of blocks is a tile that one task works on: candidates
    are sent once for each block of queries, queries once for each block of candidates.  Tiles have bounded sizes, so
    neither side needs to be small.  Exact; ties go to the smaller id.  Rows whose id or vector is null, zero or not
    finite take no part; vectors of different widths aren't compared; an empty table gives no row.  Rows that share an id are one query,
    ranked over what any of them is near, each is a candidate of other ids, and none is one of its own.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), F.size(vec_col).alias("width")
    )
    n, n_q = rows.agg(F.count("*"), F.count_if("q")).first()
    c_blocks = max(math.ceil(n / CANDIDATE_ROWS), min(n // 256 + 1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    q_blocks = max(1, math.ceil(n_q / QUERY_ROWS))

    def block(of: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(of))

    def blocks(of: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(of - 1).cast("bigint")))

    queries = rows.where("q").select("id", "v", "width", block(q_blocks, 1).alias("qb"), blocks(c_blocks).alias("cb"))
    candidates = rows.select("id", "v", "width", blocks(q_blocks).alias("qb"), block(c_blocks, 2).alias("cb"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return OUT.empty_table()
        (q_ids, q), (c_ids, c) = [(t["id"].to_numpy(), np.stack(t["v"].to_numpy())) for t in (left, right)]
        found = tile_neighbours(q_ids, q, c_ids, c, k)
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), OUT.types, strict=True)], schema=OUT) if found else OUT.empty_table()

    keys = ["qb", "cb", "width"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(tile, "query_id bigint, vec_id bigint, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: The same by brute force, every query against all rows.
ORACLE = """
WITH v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
    SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])))) AS score
    FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY rank <= 10
"""
