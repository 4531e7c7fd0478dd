"""Greedy clustering of sequences by identity.

The rule, for a set of distinct texts in order (longest first, then by letters): each text joins the first centroid that it
is near, or becomes one.  Two texts are near if they share enough words, their lengths allow it, and an alignment of them has
enough equal letters.  The outcome depends on the texts alone, not on how they are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmill.functions import annotation as A
from readmill.operators.consensus import with_set
from readmill.operators.split import numbered
from readmill.schema import checkpointed

#: Cells of tables and pairs of texts that a task holds at a time; texts that it compares with the centroids at a time.
CELLS, PAIRS, BLOCK = 4_000_000, 1 << 16, 256
#: Texts of a set that one task clusters, and how often, before near pairs are listed; texts that a task compares with the
#: centroids of a batch; letters of a block of texts whose pairs are listed.
BATCH, BATCHES, DEAL, LETTERS = 20_000, 3, 8_000, 2_400_000


@dataclass(frozen=True)
class Rule:
    """When a text is near a centroid before it in order.

    ident: least share of equal letters, among the columns of a global alignment without the gaps at its ends or, with
    shorter=True, among the letters of the shorter text.  length_ratio: least ratio of their lengths.  They share `shared`
    distinct words of `word` letters at least, or all of the later text's if it has fewer.  aligned=False compares only
    texts of one length, place by place.
    """

    ident: float = 0.9
    length_ratio: float = 0.0
    word: int = 8
    shared: int = 12
    shorter: bool = False
    aligned: bool = True
    gap: int = 2

    def words(self, text: str) -> set[str]:
        return {text[k : k + self.word] for k in range(max(1, len(text) - self.word + 1))}


def in_order(texts: Iterable[str]) -> list[str]:
    """Longest first, then by letters."""
    return sorted(texts, key=lambda t: (-len(t), t))


def _letters(texts: list[str], size: np.ndarray, width: int) -> np.ndarray:
    """Rows of letters as numbers from 1, of a byte if there are few; 0 behind a text's end."""
    codes = np.frombuffer("".join(x.ljust(width, "\0") for x in texts).encode("utf-32-le"), "<u4").reshape(len(texts), width)
    inside = np.arange(width) < size[:, None]
    known = np.unique(codes[inside])
    return np.where(inside, np.searchsorted(known, codes) + 1, 0).astype(np.uint8 if len(known) < 255 else np.uint32)


def identities(one: list[str], other: list[str], rule: Rule) -> np.ndarray:
    """Identity of each pair of texts by the rule; alignments are of match 1, mismatch -1 and gaps rule.gap."""
    size = np.fromiter(map(len, [*one, *other]), np.int64, len(one) + len(other))
    letters = _letters([*one, *other], size, int(size.max(initial=1)))
    return _identities(letters, size, np.arange(len(one)), np.arange(len(one), len(size)), rule)


def _identities(letters: np.ndarray, size: np.ndarray, one: np.ndarray, other: np.ndarray, rule: Rule, only_near: bool = False) -> np.ndarray:
    """Identity of pairs of rows of letters; only_near: 0 instead of one that isn't enough, where that is known before.

    Texts of one length with more than 0.8 of their letters equal aren't aligned.  Score tables of many pairs are filled a
    row at a time, and paths are followed back for all at once (a letter pair before a gap).
    """
    out = np.zeros(len(one))
    n_all, m_all = size[one], size[other]
    order = np.lexsort((m_all, n_all)) if len(one) and (np.ptp(n_all) or np.ptp(m_all)) else np.arange(len(one))  # pairs of like sizes together
    at = 0
    while at < len(order):
        top, wide = int(n_all[order[at]]), int(m_all[order[at : at + PAIRS]].max())
        step = max(1, min(PAIRS, CELLS // 4 // ((top + 1) * (wide + 1))))
        own = order[at : at + step]
        own = own[n_all[own] <= max(top + 8, top * 1.2)]
        at += len(own)
        n, m = n_all[own], m_all[own]
        a, b = letters[one[own], : int(n.max())], letters[other[own], : int(m.max())]
        share, width = np.zeros(len(own)), min(a.shape[1], b.shape[1])
        level = (n == m) & (n > 0)
        if level.any():
            same = a[level, :width] == b[level, :width]
            share[level] = (same if n.min() == width else same & (np.arange(width) < n[level, None])).sum(axis=1, dtype=np.int32) / n[level]
        todo = np.flatnonzero((share <= 0.8) & (n > 0) & (m > 0)) if rule.aligned else []
        if len(todo):
            share[todo] = _aligned_share(a[todo], n[todo], b[todo], m[todo], rule, only_near)
        out[own] = share
    return out


@cache
def _near_scores(most: int, rule: Rule) -> np.ndarray:
    """Whether an alignment of enough identity may have a score, which with rule.gap for each letter added is a sum over the
    columns of two letters: 1 + 2 gap for each of m matches and 2 gap - 1 for each of x mismatches."""
    m, x = np.ogrid[: most + 1, : most + 1]
    out = np.zeros(most * (1 + 2 * rule.gap) + 1, bool)
    able = (m + x <= most) & (m > 0) & (rule.shorter | (m >= rule.ident * (m + x) - 1e-9))
    out[(m * (1 + 2 * rule.gap) + x * (2 * rule.gap - 1))[able]] = True
    return out


def _aligned_share(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, rule: Rule, only_near: bool = False) -> np.ndarray:
    kind = np.int16 if (a.shape[1] + b.shape[1]) * rule.gap < 1 << 14 else np.int32
    gap, rows = kind(rule.gap), np.arange(len(n))
    steps = np.arange(b.shape[1] + 1, dtype=kind) * gap
    h = np.empty((a.shape[1] + 1, len(n), b.shape[1] + 1), kind)
    h[0] = -steps
    for i in range(1, a.shape[1] + 1):
        row = np.empty((len(n), b.shape[1] + 1), kind)
        row[:, 0] = -i * gap
        np.maximum(h[i - 1, :, :-1] + np.where(b == a[:, i - 1, None], kind(1), kind(-1)), h[i - 1, :, 1:] - gap, out=row[:, 1:])
        row += steps
        np.maximum.accumulate(row, axis=1, out=row)
        np.subtract(row, steps, out=h[i])
    out = np.zeros(len(n))
    if only_near:  # paths are followed only where the score leaves it open
        total = h[n, rows, m].astype(np.int64) + rule.gap * (n + m)
        able = total >= 0
        able[able] = _near_scores(int(np.minimum(n, m).max()), rule)[total[able]]
        if rule.shorter:
            able &= total >= np.ceil(rule.ident * np.minimum(n, m) - 1e-9) * (1 + 2 * rule.gap)
        keep = np.flatnonzero(able)
        if len(keep) < len(n):
            if len(keep):
                out[keep] = _followed(a[keep], n[keep], b[keep], m[keep], h[:, keep], rule)
            return out
    return _followed(a, n, b, m, h, rule)


def _followed(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, h: np.ndarray, rule: Rule) -> np.ndarray:
    gap, rows = rule.gap, np.arange(len(n))
    i, j = n.copy(), m.copy()
    matches, columns, trailing, run, last = (np.zeros(len(n), np.int64) for _ in range(5))  # last: 0 none, 1 pair, 2 and 3 gaps
    while (open_ := (i > 0) | (j > 0)).any():
        i0, j0 = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        equal = a[rows, i0] == b[rows, j0]
        here = h[i, rows, j]
        pair = (i > 0) & (j > 0) & (here == h[i0, rows, j0] + np.where(equal, 1, -1))
        up = ~pair & (i > 0) & (here == h[i0, rows, j] - gap)
        kind = np.where(pair, 1, np.where(up, 2, 3))
        run = np.where(open_, np.where(kind == last, run + 1, 1), run)
        columns += open_
        trailing = np.where(open_ & (run == columns) & (kind > 1), run, trailing)
        matches += open_ & pair & equal
        last = np.where(open_, kind, last)
        i, j = i - (open_ & (kind < 3)), j - (open_ & (kind != 2))
    leading = np.where(last > 1, run, 0)
    return matches / np.maximum(1, np.minimum(n, m) if rule.shorter else columns - trailing - leading)


class Texts:
    """Distinct texts in order, as rows of letters, each with its distinct words; a row's number says its place in the order."""

    def __init__(self, texts: list[str], rule: Rule) -> None:
        self.rule, self.size = rule, np.fromiter(map(len, texts), np.int64, len(texts))
        width = max(rule.word, int(self.size.max(initial=0)))
        self.letters = _letters(texts, self.size, width)
        base = int(self.letters.max(initial=0)) + 1
        if base**rule.word < 1 << 62:
            parts = [self._words(at, base) for at in range(0, len(texts), max(1, CELLS // width))]
        else:  # words of more than 62 bits
            number: dict[str, int] = {}
            listed = [[number.setdefault(w, len(number)) for w in rule.words(text)] for text in texts]
            parts = [(np.full(len(x), k), np.array(x, np.int64)) for k, x in enumerate(listed)]
        self.row, self.word = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(2))
        self.words = int(self.word.max(initial=-1)) + 1
        if self.words > 4 * len(self.word):
            known, self.word = np.unique(self.word, return_inverse=True)
            self.words = len(known)
        self.count = np.bincount(self.row, minlength=len(texts))
        self.begin = np.r_[0, np.cumsum(self.count)]

    def _words(self, at: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distinct words of a part of the texts; a word is the number that its letters write."""
        n, rule = self.size[at : at + max(1, CELLS // self.letters.shape[1])], self.rule
        letters = self.letters[at : at + len(n)].astype(np.int64)
        places = letters.shape[1] - rule.word + 1
        word = np.zeros((len(n), places), np.int64)
        for k in range(rule.word):
            word = word * base + letters[:, k : k + places]
        word[np.arange(places) >= np.maximum(1, n - rule.word + 1)[:, None]] = -1
        word.sort(axis=1)
        first = word >= 0
        first[:, 1:] &= word[:, 1:] != word[:, :-1]
        return np.nonzero(first)[0] + at, word[first]

    def met(self, queries: np.ndarray, index: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, other) rows that share enough words, sorted, a part of the queries at a time; without an index every pair of queries once."""
        own = _ranges(self.begin[queries], self.count[queries])
        row, word = np.repeat(np.arange(len(queries)), self.count[queries]), self.word[own]
        there = own if index is None else _ranges(self.begin[index], self.count[index])
        others = queries if index is None else index
        order = np.argsort(self.word[there], kind="stable")
        posted = np.repeat(np.arange(len(others)), self.count[others])[order]
        start = np.r_[0, np.cumsum(np.bincount(self.word[there], minlength=self.words))]
        lo, hi = start[word], start[word + 1]
        if index is None:
            hi = np.empty(len(order), np.int64)
            hi[order] = np.arange(len(order))  # others of the word before the query itself
        run = hi - lo
        ends = np.r_[0, np.cumsum(run)][np.r_[0, np.cumsum(self.count[queries])]]  # words met before each query
        least = min(self.rule.shared, int(self.count[queries].min(initial=1 << 30)), int(self.count[others].min(initial=1 << 30)))
        at = 0
        while at < len(queries):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + CELLS // 2, "right")) - 1)
            part = slice(*np.searchsorted(row, [at, to]))
            key = np.repeat(row[part] * len(others), run[part]) + posted[_ranges(lo[part], run[part])]
            key.sort()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            c = np.diff(np.r_[first, len(key)])
            key, c = key[first[c >= least]], c[c >= least]
            query, other = queries[key // len(others)], others[key % len(others)]
            later = np.maximum(query, other)
            enough = c >= np.minimum(self.rule.shared, self.count[later])
            yield query[enough], other[enough]
            at = to

    def near(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether the later row of each pair is near the earlier one."""
        later, earlier, rule = np.maximum(one, other), np.minimum(one, other), self.rule
        out = self.size[later] >= rule.length_ratio * self.size[earlier]
        if not rule.aligned:
            out &= self.size[later] == self.size[earlier]
        todo = np.flatnonzero(out)
        out[todo] = _identities(self.letters, self.size, later[todo], earlier[todo], rule, True) >= rule.ident
        return out

    def first(self, queries: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """The first of the heads, which are earlier, that each query is near; -1: none."""
        out = np.full(len(self.size), -1)
        for query, head in self.met(queries, heads):
            place = np.arange(len(query)) - np.searchsorted(query, query)
            at, size = 0, 16 if self.rule.aligned else len(query)
            while len(query):
                now = place < at + size
                hit = self.near(query[now], head[now])
                found, where = np.unique(query[now][hit], return_index=True)
                out[found] = head[now][hit][where]
                left = ~now & (out[query] < 0)
                query, head, place = query[left], head[left], place[left]
                at, size = at + size, min(4 * size, 1024)
        return out[queries]

    def pairs(self, queries: np.ndarray, index: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(later, earlier) rows of all near pairs."""
        found = [(np.maximum(q, o)[hit], np.minimum(q, o)[hit]) for q, o in self.met(queries, index) for hit in [self.near(q, o)]]
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one behind the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def greedy(seqs: list[str], rule: Rule) -> list[str]:
    """Each text's centroid, by one pass over the distinct texts in order: BLOCK of them at a time against the centroids before."""
    order = in_order(set(seqs))
    texts, head, centroids = Texts(order, rule), np.arange(len(order)), np.zeros(0, np.int64)
    for at in range(0, len(order), BLOCK):
        block = np.arange(at, min(at + BLOCK, len(order)))
        found = texts.first(block, centroids) if len(centroids) else np.full(len(block), -1)
        head[block[found >= 0]] = found[found >= 0]
        left = block[found < 0]
        near: dict[int, list[int]] = {}
        for later, earlier in sorted(zip(*(x.tolist() for x in texts.pairs(left)), strict=True)):
            near.setdefault(later, []).append(earlier)
        for k in left.tolist():
            head[k] = next((e for e in near.get(k, ()) if head[e] == e), k)
        centroids = np.r_[centroids, left[head[left] == left]]
    of = {seq: order[k] for seq, k in zip(order, head.tolist(), strict=True)}
    return [of[s] for s in seqs]


def _trimmed(start: int, end: int | None):
    text = F.translate(F.upper("seq"), "-.", "NN")
    return F.substring(text, start + 1, 1 << 30 if end is None else end - start)


def _labelled(reads: DataFrame, labels: DataFrame, on: list[str], field: str, prefix: str) -> DataFrame:
    out = reads.join(labels, on)
    return out.withColumn("ann", A.merge(F.col("ann"), A.pairs({field: F.concat(F.lit(prefix), F.col("cluster").cast("string"))})))


OWNED = "set_id string, v string, head string"


def _owned(texts: pa.Table, heads: list[str | None]) -> pa.Table:
    return pa.table({"set_id": texts["set_id"], "v": texts["v"], "head": pa.array(heads, pa.string())})


def _cluster(rule: Rule) -> Callable[[pa.Table], pa.Table]:
    def cluster(group: pa.Table) -> pa.Table:
        return _owned(group, greedy(group["v"].to_pylist(), rule))

    return cluster


def _take(rule: Rule) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def take(heads: pa.Table, rest: pa.Table) -> pa.Table:
        """The first of the heads, all of them earlier, that each text is near."""
        order, own = in_order(heads["head"].to_pylist()), rest["v"].to_pylist()
        if not order or not own:
            return _owned(rest, [None] * len(own))
        texts = Texts(order + own, rule)
        found = texts.first(np.arange(len(order), len(texts.size)), np.arange(len(order)))
        return _owned(rest, [order[k] if k >= 0 else None for k in found.tolist()])

    return take


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys, to a number of tasks that doesn't shrink with their bytes: a few bytes are much work here."""
    return rows.repartition(3 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _placed(left: DataFrame) -> DataFrame:
    """Texts with `id`, their place in the order of sets and texts."""
    return numbered(left, [F.col("set_id"), -F.length("v"), F.col("v")], "id")


def owners(values: DataFrame, rule: Rule) -> DataFrame:
    """set_id, v, head of distinct non-empty texts (set_id, v): the centroid that one greedy pass over each set gives them.

    A set of up to BATCH texts is clustered by one task.  Of larger ones, BATCHES times, the next BATCH texts in order are,
    and the set's other texts, dealt to as many tasks as they need, leave if they are near one of its centroids.  What is
    left then, and by then no dense group leads, is settled by its near pairs: a text whose earlier near texts are all no
    centroids is one, and those near a centroid are none.  The number of rounds is the depth of that dependency, whatever
    the number of centroids, and the outcome doesn't depend on BATCH or BATCHES.
    """
    left = checkpointed(values.select("set_id", "v").where("v <> ''").distinct())
    parts: list[DataFrame] = []
    for _ in range(BATCHES):
        most = left.groupBy("set_id").count().agg(F.max("count")).first()[0] or 0
        if most <= BATCH:
            parts.append(_dealt(left, "set_id").groupBy("set_id").applyInArrow(_cluster(rule), OWNED))
            break
        placed = _placed(left)
        sets = placed.groupBy("set_id").agg(F.min("id").alias("from"), F.ceil(F.count("*") / DEAL).cast("int").alias("deals"))
        placed = checkpointed(placed.join(sets, "set_id").withColumn("first", F.col("id") - F.col("from") < BATCH))
        own = checkpointed(_dealt(placed.where("first").select("set_id", "v"), "set_id").groupBy("set_id").applyInArrow(_cluster(rule), OWNED))
        parts.append(own)
        rest = placed.where("not first").select("set_id", F.pmod(F.xxhash64("v"), F.col("deals")).cast("int").alias("deal"), "v")
        crowded = placed.where("not first").select("set_id", "deals").distinct()
        sent = own.where("v = head").join(crowded, "set_id").select("set_id", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), "head")
        found = checkpointed(_dealt(sent, "set_id", "deal").groupBy("set_id", "deal").cogroup(_dealt(rest, "set_id", "deal").groupBy("set_id", "deal")).applyInArrow(_take(rule), OWNED))
        parts.append(found.where("head is not null"))
        left = found.where("head is null").select("set_id", "v")
    else:
        placed = checkpointed(_placed(left))
        parts.append(_by_pairs(placed, near_pairs(placed, rule)))
    return reduce(DataFrame.unionByName, parts)


def near_pairs(placed: DataFrame, rule: Rule) -> DataFrame:
    """id, earlier: near texts (id, set_id, v) of a set, by their ids.

    A set's texts are dealt to blocks, and a task compares those of two blocks (or one): words in common are counted over
    lists of the texts that have a word, and texts that share enough are compared.  So pairs that share a word by chance
    are never rows; a text goes to as many tasks as its set has blocks.
    """
    blocks = placed.groupBy("set_id").agg(F.ceil(F.sum(F.length("v")) / LETTERS).cast("int").alias("blocks"))
    rows = placed.join(blocks, "set_id").select("set_id", "id", "v", "blocks", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("own"))
    cells = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("set_id", "id", "v", "own", cells).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("id")
        id_, own = cell["id"].to_numpy(), cell["own"].to_numpy()
        texts, rows = Texts(cell["v"].to_pylist(), rule), np.arange(len(id_))
        first = own == own[0]
        if first.all():  # also the only block of its cell that has texts
            later, earlier = texts.pairs(rows) if cell["i"][0] == cell["j"][0] else (rows[:0], rows[:0])
        else:
            later, earlier = texts.pairs(rows[first], rows[~first])
        return pa.table({"id": id_[later], "earlier": id_[earlier]})

    return _dealt(rows.select("set_id", "i", "j", "id", "own", "v"), "set_id", "i", "j").groupBy("set_id", "i", "j").applyInArrow(compare, "id bigint, earlier bigint")


def _by_pairs(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """set_id, v, head of texts (id, set_id, v) by their near pairs: the priority-ordered independent set, by rounds of joins."""
    edges = checkpointed(pairs)
    todo, gone = edges, edges.select("id").limit(0)
    while not todo.isEmpty():
        # centroids that something is near: texts that are in no pair any more but as the earlier one
        new = checkpointed(todo.select(F.col("earlier").alias("id")).distinct().join(todo.select("id").distinct(), "id", "left_anti"))
        near = checkpointed(todo.join(new.withColumnRenamed("id", "earlier"), "earlier", "left_semi").select("id").distinct())
        gone, closed = gone.unionByName(near), new.unionByName(near)
        # only pairs of two open texts still say something
        todo = checkpointed(todo.join(closed, "id", "left_anti").join(closed.withColumnRenamed("id", "earlier"), "earlier", "left_anti"))
    first = edges.join(gone.withColumnRenamed("id", "earlier"), "earlier", "left_anti").groupBy("id").agg(F.min("earlier").alias("first"))
    heads = placed.select(F.col("id").alias("first"), F.col("v").alias("head"))
    return placed.join(first, "id", "left").withColumn("first", F.coalesce("first", "id")).join(heads, "first").select("set_id", "v", "head")


def cluster_sets(
    reads: DataFrame, field: str = "BARCODE", ident: float = 0.9, length_ratio: float = 0.0, start: int = 0, end: int | None = None, cluster_field: str = "CLUSTER", prefix: str = "", **how
) -> DataFrame:
    """Reads with their cluster within their set, in `cluster` and the annotation; sets with an empty stretch are left out.

    Clusters are numbered from 1 in the order of their centroids (longest first, then by letters), whatever a set's size.
    """
    sets = with_set(reads, field).withColumn("_s", _trimmed(start, end))
    empty = sets.where("_s = ''").select("set_id").distinct()
    sets = sets.join(empty, "set_id", "left_anti")
    found = checkpointed(owners(sets.select("set_id", F.col("_s").alias("v")), Rule(ident, length_ratio, **how)))
    heads = found.where("v = head").select("set_id", "head")
    order = numbered(heads, [F.col("set_id"), -F.length("head"), F.col("head")])
    first = order.groupBy("set_id").agg(F.min("_n").alias("_first"))
    order = order.join(first, "set_id").select("set_id", "head", (F.col("_n") - F.col("_first") + 1).cast("int").alias("cluster"))
    labels = found.join(order, ["set_id", "head"]).select("set_id", F.col("v").alias("_s"), "cluster")
    return _labelled(sets, labels, ["set_id", "_s"], cluster_field, prefix).drop("_s")


def cluster_distinct(values: DataFrame, value: str, rule: Rule) -> DataFrame:
    """value, cluster (named by its least member) of distinct texts of a whole table."""
    found = checkpointed(owners(values.select(F.lit("").alias("set_id"), F.col(value).alias("v")), rule))
    least = found.groupBy("head").agg(F.min("v").alias("cluster"))
    return found.join(least, "head").select(F.col("v").alias(value), "cluster")


def cluster_all(reads: DataFrame, ident: float = 0.9, length_ratio: float = 0.0, start: int = 0, end: int | None = None, cluster_field: str = "CLUSTER", prefix: str = "", **how) -> DataFrame:
    """Reads with a cluster of the whole table's sequences (named by its least member)."""
    rows = reads.select("*", F.inline(F.array(F.struct(_trimmed(start, end).alias("_s")))))  # made once, whatever filters it
    return _labelled(rows, cluster_distinct(rows, "_s", Rule(ident, length_ratio, **how)), ["_s"], cluster_field, prefix).drop("_s")


def cluster_barcodes(reads: DataFrame, field: str = "BARCODE", ident: float = 0.9, length_ratio: float = 0.0, cluster_field: str = "CLUSTER", prefix: str = "", **how) -> DataFrame:
    """Reads with a cluster of their barcodes, of which only distinct ones are compared; one common word of 3 letters is enough."""
    rows = with_set(reads, field).withColumnRenamed("set_id", "_s")
    rule = Rule(ident, length_ratio, **{"word": 3, "shared": 1} | how)
    return _labelled(rows, cluster_distinct(rows, "_s", rule), ["_s"], cluster_field, prefix).drop("_s")
