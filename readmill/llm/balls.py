"""Centroid clustering (operator 12): Lloyd's rounds over metric trees that each task builds of its own rows.

Vectors are whole numbers, so sums, distances and the floor of a mean are exact and don't depend on how rows are dealt.  A
tree covers ROWS rows; a node knows its rows, their count, their integer sum and a ball around them.  A round walks all
trees with the few centroids: a centroid is out of a ball's reach if even the ball's nearest point to it is farther than
the ball's farthest point from the best one.  A ball that only one centroid reaches gives it its count and sum whole; the
others are opened, down to leaves whose rows get exact distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.llm.common import stored, table

DIMENSIONS, CENTROIDS, ROUNDS, FACTOR = 64, 16, 3, 64
#: Rows of a tree and of a leaf; largest component, so that distances fit in longs.
ROWS, LEAF, MOST = 8192, 32, 2**26
TREE = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), ("nodes", pa.binary()), ("radii", pa.binary()), ("sums", pa.binary())])


class Tree:
    """Rows in the order of the tree, and nodes (first row, end, left child or -1; the right one follows), radii and sums."""

    def __init__(self, ids: pa.Array, points: np.ndarray, nodes: np.ndarray, radii: np.ndarray, sums: np.ndarray) -> None:
        self.ids, self.points, self.nodes, self.radii, self.sums = ids, points, nodes, radii, sums

    @classmethod
    def of(cls, ids: pa.Array, points: np.ndarray) -> Tree:
        """Balls are halved at the median of their rows' places between the row farthest from the centre and the one farthest from that."""
        order, nodes, at = np.arange(len(points)), [[0, len(points), -1]], 0
        while at < len(nodes):
            lo, hi, _ = nodes[at]
            if hi - lo > LEAF:
                x = points[order[lo:hi]].astype(np.float64)
                a = x[np.square(x - x.mean(axis=0)).sum(axis=1).argmax()]
                b = x[np.square(x - a).sum(axis=1).argmax()]
                if (a != b).any():  # else all rows are the same
                    half = (hi - lo) // 2
                    order[lo:hi] = order[lo:hi][np.argpartition(x @ (b - a), half)]
                    nodes[at][2] = len(nodes)
                    nodes += [[lo, lo + half, -1], [lo + half, hi, -1]]
            at += 1
        points, nodes = points[order], np.array(nodes, np.int64)
        sums = np.stack([points[lo:hi].sum(axis=0, dtype=np.int64) for lo, hi, _ in nodes])
        radii = np.array([np.sqrt(np.square(points[lo:hi] - s / (hi - lo)).sum(axis=1).max()) for (lo, hi, _), s in zip(nodes, sums, strict=True)])
        return cls(ids.take(pa.array(order)), points, nodes, radii, sums)

    @classmethod
    def read(cls, row: dict) -> Tree:
        of = {k: np.frombuffer(row[k].as_py(), kind) for k, kind in (("points", "<i4"), ("nodes", "<i8"), ("radii", "<f8"), ("sums", "<i8"))}
        return cls(row["ids"].values, of["points"].reshape(-1, DIMENSIONS), of["nodes"].reshape(-1, 3), of["radii"], of["sums"].reshape(-1, DIMENSIONS))

    def row(self) -> list[pa.Array]:
        raw = [pa.array([x.tobytes()], pa.binary()) for x in (self.points.astype("<i4"), self.nodes.astype("<i8"), self.radii.astype("<f8"), self.sums.astype("<i8"))]
        return [pa.ListArray.from_arrays(pa.array([0, len(self.ids)], pa.int32()), self.ids), *raw]

    def reached(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, np.ndarray]]]:
        """(node, its only centroid) for whole balls, and (leaf, centroids that reach it) for the others."""
        whole: list[tuple[int, int]] = []
        leaves: list[tuple[int, np.ndarray]] = []
        front, reach = np.array([0]), np.ones((1, len(centroids)), bool)
        where = centroids.astype(np.float64)
        while len(front):
            first, end, left = self.nodes[front].T
            centre = self.sums[front] / (end - first)[:, None]
            d = np.sqrt(np.square(centre[:, None, :] - where[None]).sum(axis=2))
            r = self.radii[front][:, None]
            best = np.where(reach, d, np.inf).min(axis=1, keepdims=True)
            # what rounding may do to these lengths is far below the margin; ties stay in reach and are settled exactly
            reach = reach & (d - r <= best + r + 1e-9 * (1 + d + r))
            one = reach.sum(axis=1) == 1
            whole += zip(front[one].tolist(), reach[one].argmax(axis=1).tolist(), strict=True)
            is_leaf = ~one & (left < 0)
            leaves += zip(front[is_leaf].tolist(), reach[is_leaf], strict=True)
            down = ~one & (left >= 0)
            front, reach = np.r_[left[down], left[down] + 1], np.r_[reach[down], reach[down]]
        return whole, leaves

    def nearest(self, lo: int, hi: int, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows lo to hi the nearest of some centroids (the first of ties), and the squared distance to it; exact."""
        numbers = np.flatnonzero(among)
        x, c = self.points[lo:hi].astype(np.int64), centroids[numbers]
        d = np.stack([np.square(x - y).sum(axis=1) for y in c], axis=1)
        best = d.argmin(axis=1)
        return numbers[best], d[np.arange(hi - lo), best]

    def gathered(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and integer sum of the rows nearest to each centroid."""
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        whole, leaves = self.reached(centroids)
        for node, k in whole:
            counts[k] += self.nodes[node, 1] - self.nodes[node, 0]
            sums[k] += self.sums[node]
        for node, among in leaves:
            lo, hi, _ = self.nodes[node]
            number, _ = self.nearest(lo, hi, centroids, among)
            np.add.at(counts, number, 1)
            np.add.at(sums, number, self.points[lo:hi])
        return counts, sums

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row in the tree's order its nearest centroid and the squared distance to it."""
        number, distance = np.zeros(len(self.points), np.int64), np.zeros(len(self.points), np.int64)
        whole, leaves = self.reached(centroids)
        for node, among in [(n, np.arange(len(centroids)) == k) for n, k in whole] + leaves:
            lo, hi, _ = self.nodes[node]
            number[lo:hi], distance[lo:hi] = self.nearest(lo, hi, centroids, among)
        return number, distance


def trees(vectors: DataFrame) -> DataFrame:
    """A row for each tree of ROWS rows (id, components) of a task."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def tree() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            points = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)
            return pa.RecordBatch.from_arrays(Tree.of(rows["id"].combine_chunks(), points).row(), schema=TREE)

        for batch in batches:
            while len(batch):
                part, batch = batch[: ROWS - n], batch[ROWS - n :]
                held.append(part)
                n += len(part)
                if n == ROWS:
                    yield tree()
                    held, n = [], 0
        if held:
            yield tree()

    return vectors.select("id", "v").mapInArrow(build, "ids array<bigint>, points binary, nodes binary, radii binary, sums binary")


def _trees_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
    for batch in batches:
        for i in range(len(batch)):
            yield Tree.read({c: batch.column(c)[i] for c in batch.schema.names})


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each centroid's rows; a centroid without rows stays.  Tasks give a row a centroid at most."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for tree in _trees_of(batches):
            for total, part in zip((counts, sums), tree.gathered(centroids), strict=True):
                total += part
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), *map(pa.array, sums[some].T)], ["k", "n", *names])

    names = [f"s{i}" for i in range(DIMENSIONS)]
    parts = forest.mapInArrow(gather, "k bigint, n bigint, " + ", ".join(f"{c} bigint" for c in names))
    out = centroids.copy()
    for row in parts.groupBy("k").agg(F.sum("n"), *(F.sum(F.col(c).cast("decimal(20,0)")) for c in names)).collect():
        out[row[0]] = [int(s) // row[1] for s in row[2:]]
    return out


def whole_numbers(vec: Column) -> Column:
    """floor(FACTOR * x) of each component x as a double, as far as MOST from zero at most."""
    return F.transform(vec.cast("array<double>"), lambda x: F.floor(F.least(F.greatest(x * FACTOR, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int"))


def usable(vec: Column) -> Column:
    """Not null, of DIMENSIONS components, none of them null, NaN or infinite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) == DIMENSIONS) & ~F.coalesce(bad, F.lit(True))


def clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: each vector's cluster after ROUNDS rounds.

    Vectors of another width, null ones and ones with null or non-finite components take no part.  A row with a null id is
    clustered, but is no first centroid; of repeated ids the one with the smaller components comes first.  Fewer than
    CENTROIDS vectors with an id make fewer centroids; without one, or of an empty table, there is no row.  Components of
    2**20 and more count as 2**20, so that distances are longs.
    """
    spark = vectors.sparkSession
    rows = stored(vectors.where(usable(F.col(vec_col))).select(F.col(id_col).cast("bigint").alias("id"), whole_numbers(F.col(vec_col)).alias("v")))
    order = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    first = rows.where("id is not null").select(order.alias("h"), "v").orderBy("h", "v").limit(CENTROIDS).collect()
    if not first:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centroids = np.array([r["v"] for r in first], np.int64)
    forest = stored(trees(rows))
    for _ in range(ROUNDS):
        centroids = moved(forest, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in _trees_of(batches):
            number, distance = tree.assigned(centroids)
            yield pa.RecordBatch.from_arrays([tree.ids, pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    found = stored(forest.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint"))
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = [(k, sums.get(k, 0), sum(sums.values()), h) for k, h in enumerate(digests)]
    return found.join(F.broadcast(spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The same by plain rounds over all vectors and centroids."""
    nearest = "list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    steps = [
        "x AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, v FROM x WHERE vec_id IS NOT NULL QUALIFY k < 16)",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT x.vec_id, x.v, c.k, CAST({nearest} AS BIGINT) AS d FROM x, c{n} AS c QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY d, c.k) = 1)")
        mean = f"SELECT k, list(s ORDER BY i) AS v FROM (SELECT k, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS s FROM a{n}, range(1, 65) AS r(i) GROUP BY k, i) GROUP BY k"
        if n < ROUNDS:
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT k, coalesce(m.v, c.v) AS v FROM c{n} AS c LEFT JOIN ({mean}) AS m USING (k))")
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} AS c USING (k)"
    )


ORACLE = _oracle()
