"""SimHash near-dedup (operator 10): fingerprints meet at the words of a covering code.

Fingerprints link at 3 or fewer differing bits.  Two such fingerprints differ by at most one bit in the first or in the
second 32 of them.  Of each half, 31 bits are covered by the Hamming code of that length: it is perfect, so each 31 bits
lie within its covering radius 1 of exactly one code word, their home anchor.  A fingerprint is sent to every anchor
within radius plus threshold, 1 + 1 = 2, of either half: 16 anchors at most (1 if the half is a code word).  The home
anchor of one of two linked fingerprints is then an anchor of the other, and there the whole 64 bits are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.llm.common import stored, table
from readmill.llm.components import components

#: Differing bits at which fingerprints link; homes of an anchor that are compared in one group.
THRESHOLD, HOME_ROWS = 3, 4096
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint_of(text: str, width: int = 3) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 without words."""
    words = text.encode().lower().split()  # bytes: lower() changes A-Z alone, split() cuts at \\x20 and \\x09-\\x0d alone
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # so that a very long text's bits are never all spread out
        part = words[at : at + 65_536 + width - 1]
        m = max(1, len(part) - width + 1)
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(part) >= width else [b" ".join(part)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, m)
        ones += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column) -> Column:
    """SimHash of a text column as a signed long; null texts have no words."""

    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t) for t in pc.fill_null(texts, "").to_pylist()], pa.int64())

    return simhash(text.cast("string"))


def _syndromes() -> np.ndarray:
    """Syndrome of the Hamming code of length 31 for each value of each of four bytes: xor of the places of set bits."""
    out = np.zeros((4, 256), np.uint8)
    for byte in range(4):
        for bit in range(8):
            place = byte * 8 + bit + 1
            out[byte] ^= np.where(np.arange(256) >> bit & 1, place if place <= 31 else 0, 0).astype(np.uint8)
    return out


def _flips() -> np.ndarray:
    """For each syndrome the bits to flip for every code word within 2, the home anchor's (0 or 1 bits) first; unused: -1."""
    out = np.full((32, 16), -1, np.int64)
    out[0, 0] = 0
    for s in range(1, 32):
        pairs = sorted((i, i ^ s) for i in range(32) if i < i ^ s)
        out[s] = [sum(1 << (x - 1) for x in p if x) for p in pairs]  # the first pair is (0, s): one bit
    return out


SYNDROMES, FLIPS = _syndromes(), _flips()


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fingerprint, is home) rows of fingerprints; an anchor is half * 2**31 + code word."""
    out = []
    for half in (0, 1):
        x = (fp.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32)
        s = SYNDROMES[0, x & 255] ^ SYNDROMES[1, x >> 8 & 255] ^ SYNDROMES[2, x >> 16 & 255] ^ SYNDROMES[3, x >> 24]
        flips = FLIPS[s]
        word = ((x.astype(np.int64) & 0x7FFFFFFF)[:, None] ^ flips) | half << 31
        used = flips >= 0
        home = np.zeros(used.shape, bool)
        home[:, 0] = True
        out.append((word[used], np.broadcast_to(fp[:, None], used.shape)[used], home[used]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Group:
    """Homes of one anchor, and links among them and its visitors as a forest: as few links as keep what is connected."""

    def __init__(self, key: tuple[int, int]) -> None:
        self.key, self.homes = key, np.empty(0, np.int64)
        self.part = np.empty(0, np.int64)  # the connected part of each home, so far

    def add(self, fps: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
        """Rows come homes first; links of this turn's rows to homes."""
        if home.any():
            self.homes = np.concatenate([self.homes, fps[home]])
            self.part = np.concatenate([self.part, np.arange(len(self.part), len(self.homes))])
        out: list[tuple[int, int]] = []
        if not len(self.homes) or len(self.homes) + len(fps) < 3 and len(fps) < 2:
            return out
        step = max(1, 4_000_000 // len(self.homes))
        for at in range(0, len(fps), step):
            v = fps[at : at + step]
            near = np.bitwise_count(self.homes.view(np.uint64)[:, None] ^ v.view(np.uint64)[None, :]) <= THRESHOLD
            near &= self.homes[:, None] != v[None, :]
            hit = np.flatnonzero(near.any(axis=0))
            if not len(hit):
                continue
            near, v = near[:, hit], v[hit]
            first = near.argmax(axis=0)
            out.extend(zip(self.homes[first].tolist(), v.tolist(), strict=True))
            low = np.where(near, self.part[:, None], np.iinfo(np.int64).max).min(axis=0)
            high = np.where(near, self.part[:, None], -1).max(axis=0)
            for j in np.flatnonzero(low != high).tolist():
                own = np.flatnonzero(near[:, j])
                parts, where = np.unique(self.part[own], return_index=True)
                if len(parts) > 1:
                    out.extend((int(self.homes[own[w]]), int(v[j])) for w in where)
                    self.part[np.isin(self.part, parts)] = parts[0]
        return out


def links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each (anchor, block) of rows (anchor, block, home, fp) that come sorted so, homes first."""
    group: Group | None = None
    for batch in batches:
        anchor, block, home, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(anchor):
            continue
        cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(anchor)]
        # of groups that lie within the batch, only those with a home and another row can have links
        busy = home[starts] & (ends - starts > 1)
        busy[[0, -1]] = True
        out: list[tuple[int, int]] = []
        for lo, hi in zip(starts[busy].tolist(), ends[busy].tolist(), strict=True):
            key = (int(anchor[lo]), int(block[lo]))
            if group is None or group.key != key:
                group = Group(key)
            out += group.add(fp[lo:hi], home[lo:hi])
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=EDGES)


def fingerprint_links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """a, b: links at THRESHOLD or fewer bits between distinct fingerprints, as many as connect all that are connected."""

    def to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 16_384):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in anchors(fps[at : at + 16_384])], ["anchor", "fp", "home"])

    rows = distinct.select(fp).mapInArrow(to_anchors, "anchor bigint, fp bigint, home boolean")
    homes = distinct.select(fp).mapInArrow(to_anchors, "anchor bigint, fp bigint, home boolean").where("home")
    crowded = stored(homes.groupBy("anchor").count().where(F.col("count") > HOME_ROWS).select("anchor", F.ceil(F.col("count") / HOME_ROWS).cast("int").alias("blocks")))
    if crowded.isEmpty():
        rows = rows.withColumn("block", F.lit(0))
    else:  # the homes of a crowded anchor are dealt into blocks, and its rows are sent to each of them as visitors
        rows = rows.join(crowded, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("home", F.col("home") & (F.col("block") == F.col("own")))
    rows = rows.select("anchor", "block", "home", "fp").repartition("anchor", "block").sortWithinPartitions("anchor", "block", F.desc("home"))
    return rows.mapInArrow(links_of, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links, itself included.

    Equal fingerprints are one node, so copies are never compared; the nodes' links form a forest for each anchor.  Rows
    with a null id are left out, as no component can name them; repeated rows give repeated results; null and empty
    texts have fingerprint zero; an empty table gives no row.
    """
    found = stored(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), fingerprint(F.col(text_col)).alias("fp")))
    nodes = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_links(nodes), "a", "b")
    joined = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    low = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    component = joined.join(low, "root").select("fp", "component_id")
    return found.join(component, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
