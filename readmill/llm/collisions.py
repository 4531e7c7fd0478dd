"""Embedding near-dedup (operator 11): candidates by counting collisions of one-dimensional projections.

The unit vectors x and y of two vectors of cosine c lie at distance sqrt(2 - 2c), and their projections on a direction drawn
from the normal distribution differ by a normal number of that deviation.  So with a window of WIDTH around a query's
place, a pair of the least similarity collides in one projection with a known chance p, in m projections at least l times
with a binomial one, and closer pairs more often.  `calibrated` takes the largest l that loses fewer than LOSS of the
pairs of the least similarity; pairs with l collisions get their cosine in double precision.

Only vectors of one label and width are compared.  Equal vectors are one row with its number of copies.  A label's rows are
dealt into blocks, and each pair of blocks is a tile of bounded size that a task works on: in it every projection is sorted,
each query's window is a range of the sorted places, and a row's place tells whether it is in the range.  A tile gives sums and
a forest of links, never its pairs, so a group of near copies costs its rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.llm.common import stored, table
from readmill.llm.components import components
from readmill.llm.knn import usable

LEAST = 0.93
#: Projections, half a window as a multiple of the distance of pairs of the least similarity, share of such pairs that may be lost.
PROJECTIONS, WIDTH, LOSS = 48, 1.5, 1e-6
#: Rows of a block: at least and, for vectors of 64 components, at most; blocks of a label before blocks grow; rows whose windows are counted at a time.
BLOCK_ROWS, MOST_ROWS, BLOCKS, STEP = 512, 16_384, 8, 256
OUT = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def calibrated(least: float, projections: int = PROJECTIONS) -> tuple[float, int]:
    """Half the window and the number of collisions that all but LOSS of the pairs of similarity `least` have."""
    p = math.erf(WIDTH / math.sqrt(2))
    lost = 0.0
    for count in range(projections + 1):
        lost += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if lost > LOSS:
            break
    return WIDTH * math.sqrt(2 - 2 * least), count


def directions(width: int, projections: int = PROJECTIONS) -> np.ndarray:
    """A normal direction a column, the same in every task."""
    return np.random.default_rng(20 + width).standard_normal((width, projections))


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares stay in the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.square(x).sum(axis=1, keepdims=True))


def exact_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, summed in order as SQL does; rows are scaled by powers of two, which changes no digit."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a, b))
    dot, aa, bb = (np.add.accumulate(x, axis=1)[:, -1] for x in (a * b, a * a, b * b))
    return dot / (np.sqrt(aa) * np.sqrt(bb))


class Windows:
    """Sorted projections of a block, and how often the rows of another are in a query's window."""

    def __init__(self, rows: np.ndarray, along: np.ndarray) -> None:
        places = rows @ along
        order = np.argsort(places, axis=0, kind="stable")
        self.sorted = np.take_along_axis(places, order, axis=0)
        rank = np.empty(order.shape, np.uint16)
        np.put_along_axis(rank, order, np.arange(len(rows), dtype=np.uint16)[:, None], axis=0)
        self.rank = np.ascontiguousarray(rank.T)

    def collisions(self, queries: np.ndarray, half: float) -> np.ndarray:
        """Of each query (its places) and row, the projections in which the row is in the query's window."""
        counts = np.zeros((len(queries), self.rank.shape[1]), np.uint8)
        for j, rank in enumerate(self.rank):
            first = np.searchsorted(self.sorted[:, j], queries[:, j] - half).astype(np.uint16)
            size = np.searchsorted(self.sorted[:, j], queries[:, j] + half, "right").astype(np.uint16) - first
            counts += (rank[None, :] - first[:, None]) < size[:, None]  # unsigned: a place before the window wraps round
        return counts


def verified(candidate: np.ndarray, x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray, least: float) -> np.ndarray:
    """Candidates whose cosine is `least` or more: few are gathered pair by pair, many are a product of the rows they are in."""
    near = np.zeros(candidate.shape, bool)
    rows, cols = np.flatnonzero(candidate.any(axis=1)), np.flatnonzero(candidate.any(axis=0))
    n = np.count_nonzero(candidate)
    if n * 8 > len(rows) * len(cols):
        cos = ux[rows] @ uy[cols].T
        near[np.ix_(rows, cols)] = cos >= least
        near &= candidate
        r, c = np.nonzero(np.abs(cos - least) < 1e-9)
        r, c = rows[r], cols[c]
        r, c = r[candidate[r, c]], c[candidate[r, c]]
    else:
        r, c = np.nonzero(candidate)
    for at in range(0, len(r), 65_536):
        i, j = r[at : at + 65_536], c[at : at + 65_536]
        near[i, j] = exact_cosines(x[i], y[j]) >= least
    return near


def tile_links(nodes: tuple[np.ndarray, np.ndarray], copies: tuple[np.ndarray, np.ndarray], vectors: tuple[np.ndarray, np.ndarray], least: float) -> list[tuple[int, int, int | None]]:
    """(node, vectors that it links to, None) sums, and (node, 0, other) links that connect what the tile's links connect.

    The two sides are two blocks, or the same one twice; then a row's own cell is left out.
    """
    (x, y), same = vectors, nodes[0] is nodes[1]
    half, count = calibrated(least)
    along = directions(x.shape[1])
    ux, uy = units(x), units(y)
    windows, places = Windows(uy, along), ux @ along
    mine, theirs = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    part = np.arange(len(y))  # the connected part of each column so far
    out: list[tuple[int, int, int | None]] = []
    for at in range(0, len(x), STEP):
        own = slice(at, at + STEP)
        candidate = windows.collisions(places[own], half) >= count
        if same:
            rows = np.arange(at, min(at + STEP, len(x)))
            candidate[rows - at, rows] = False
        if not candidate.any():
            continue
        near = verified(candidate, x[own], y, ux[own], uy, least)
        mine[own] += near @ copies[1]
        if not same:
            theirs += copies[0][own] @ near
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            cols = np.flatnonzero(near[i])
            if same:
                cols = np.append(cols, at + i)  # the row is a column too
            parts, where = np.unique(part[cols], return_index=True)
            node = int(nodes[0][at + i])
            out += [(node, 0, int(nodes[1][cols[w]])) for w in where if nodes[1][cols[w]] != node]
            if len(parts) > 1:
                part[np.isin(part, parts)] = parts[0]
    for ids, sums in ((nodes[0], mine), (nodes[1], theirs)):
        some = np.flatnonzero(sums)
        out += zip(ids[some].tolist(), sums[some].tolist(), [None] * len(some), strict=True)
    return out


def links(classes: DataFrame, least: float = LEAST) -> DataFrame:
    """node, links, other of all tiles; classes has node, label, width, v and copies."""
    groups = classes.groupBy("label", "width").agg(F.count("*").alias("rows"))
    # rows of a block: BLOCK_ROWS, more if that makes more than BLOCKS blocks, within the memory of MOST_ROWS rows of 64 components
    most = F.greatest(F.lit(16), F.least(F.lit(MOST_ROWS), F.floor(F.lit(MOST_ROWS * 64) / F.col("width"))))
    size = F.least(most, F.greatest(F.lit(BLOCK_ROWS), F.ceil(F.col("rows") / BLOCKS)))
    groups = groups.select(F.col("label").alias("l"), F.col("width").alias("w"), F.ceil(F.col("rows") / size).cast("int").alias("blocks"))
    rows = classes.join(groups, (F.col("label") == F.col("l")) & (F.col("width") == F.col("w"))).drop("l", "w")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = rows.select("label", "width", F.least("block", "tile").alias("a"), F.greatest("block", "tile").alias("b"), "block", "node", "copies", F.col("v").cast("array<double>").alias("v"))

    def work(tile: pa.Table) -> pa.Table:
        block = tile["block"].to_numpy()
        a, b = int(tile["a"][0].as_py()), int(tile["b"][0].as_py())
        side = []
        for k in dict.fromkeys((a, b)):
            rows = tile.filter(pa.array(block == k))
            v = rows["v"].combine_chunks()
            side.append((rows["node"].to_numpy(), rows["copies"].to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)))
        if len(side) == 2 and not (len(side[0][0]) and len(side[1][0])):
            return OUT.empty_table()
        (n, c, v), (n2, c2, v2) = side[0], side[-1]
        found = tile_links((n, n2), (c, c2), (v, v2), least)
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), OUT.types, strict=True)], schema=OUT) if found else OUT.empty_table()

    return tiles.groupBy("label", "width", "a", "b").applyInArrow(work, "node bigint, links bigint, other bigint")


def near_duplicates(vectors: DataFrame, least: float = LEAST, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: with how many other rows of its label a vector has a cosine of `least` or more,
    the smallest id that it reaches over such links, and whether that is its own.

    Rows whose label or vector is null, zero or has null or non-finite components link with nothing; neither do vectors of
    different widths.  Rows with a null id are left out, as no component can name them; repeated rows are vectors that link
    with each other, each with a result.  An empty table gives no row.
    """
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    fit = usable(F.col("v")) & F.col("label").isNotNull()
    grouped = rows.where(fit).groupBy("label", F.size("v").alias("width"), "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()))
    found = stored(links(classes, least))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null"), "node", "other").withColumnRenamed("node", "n")
    joined = stored(classes.join(sums, "node", "left").join(roots, F.col("node") == F.col("n"), "left").select("label", "v", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    low = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    each = joined.join(low, "root").select(F.col("label").alias("l"), F.col("v").alias("u"), "n_links", "component_id")
    out = rows.join(each, fit & (F.col("label") == F.col("l")) & (F.col("v") == F.col("u")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: The same by brute force over all pairs of a label.
ORACLE = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS MATERIALIZED (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM n AS a JOIN n AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) / (a.norm * b.norm) >= {LEAST}
), reach(vec_id, other) AS (
    SELECT vec_id, vec_id FROM embeddings WHERE vec_id IS NOT NULL
    UNION SELECT r.vec_id, l.b FROM reach AS r JOIN links AS l ON r.other = l.a
)
SELECT r.vec_id, (SELECT count(*) FROM links AS l WHERE l.a = r.vec_id) AS n_links, min(r.other) AS component_id, r.vec_id = min(r.other) AS kept
FROM reach AS r GROUP BY r.vec_id
"""
