"""Document fingerprints (operator 5): MinHash over word shingles in numpy, bands joined in Spark, Jaccard verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.llm.common import stored, table
from readmill.llm.components import components

#: Words of a shingle, permutations, and bands of so many permutations: a pair at 0.8 meets in one of them with 0.99995.
WIDTH, PERMUTATIONS, BANDS, BAND = 5, 128, 25, 5
#: Similarity of near copies; texts of a block that are compared with those of another; most ids that are broadcast (8 bytes each).
THRESHOLD, BLOCK_ROWS, BROADCAST_IDS = 0.8, 2048, 2_000_000
_RNG = np.random.default_rng(20_011)
#: x -> a x + b modulo 2**32 with odd a, a permutation of 32-bit numbers.
A, B = (_RNG.integers(0, 1 << 32, (PERMUTATIONS, 1), np.uint32) | np.uint32(1)), _RNG.integers(0, 1 << 32, (PERMUTATIONS, 1), np.uint32)
MULTIPLIERS = _RNG.integers(0, 1 << 64, WIDTH, np.uint64) | np.uint64(1)
NONE = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)


def word_hashes(text: bytes) -> np.ndarray:
    """XXH64 of each word; words lie between ASCII spaces, A-Z in lower case."""
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """A 32-bit hash of every run of WIDTH words (of all of them, if they are fewer)."""
    if not len(words):
        return np.empty(0, np.uint32)
    width = min(WIDTH, len(words))
    h = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        h += words[k : len(words) - width + 1 + k] * MULTIPLIERS[k]
    h ^= h >> np.uint64(31)
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least value of every permutation over the shingles; all ones without any."""
    out = NONE
    for at in range(0, len(shingles), 256):
        out = np.minimum(out, (shingles[None, at : at + 256] * A + B).min(axis=1))
    return out


def text_form(sig: np.ndarray) -> str:
    """The low 16 bits of every least value, as hex."""
    return sig.astype("<u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of permutations whose fingerprint values agree, an estimate of the Jaccard similarity; texts without words: 1."""
    if (a is NONE) != (b is NONE):
        return 0.0
    return float((a.astype(np.uint16) == b.astype(np.uint16)).mean())


def edited_signature(text: str, words: np.ndarray, shingles: np.ndarray, following: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The edited text and the signatures of the text and of the edited one; what both begin with is done once."""
    half = len(text) // 2
    kept = text[: len(text) - half]
    low = kept.encode()
    parts = low.split()
    whole = len(parts) - (1 if parts and low[-1:].strip() else 0)  # words that the cut can't have touched
    rest = (parts[-1] if whole < len(parts) else b"") + following[:half].encode()
    other = np.concatenate([words[:whole], word_hashes(rest)])
    same = max(0, whole - WIDTH + 1) if len(other) >= WIDTH and len(words) >= WIDTH else 0
    shared = signature(shingles[:same])
    changed = shingle_hashes(other)[same:]

    def with_rest(x: np.ndarray) -> np.ndarray:
        rest = signature(x)
        return rest if shared is NONE else shared if rest is NONE else np.minimum(shared, rest)

    return kept + following[:half], with_rest(shingles[same:]), with_rest(changed)


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id bigint"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("class_id", pa.int64())])


class _Doc:
    def __init__(self, doc_id: int, text: str, class_id: int) -> None:
        self.doc_id, self.text, self.class_id = doc_id, text, class_id
        self.words = word_hashes(text.encode())
        self.shingles = shingle_hashes(self.words)
        self.edited = ""
        self.sig = self.edited_sig = NONE

    def meet(self, following: _Doc) -> None:
        self.edited, self.sig, self.edited_sig = edited_signature(self.text, self.words, self.shingles, following.text)


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows (bucket, guest, doc_id, packed text, class) in order; a row's next one is the row after it in its bucket.

    A row without a text gives the class of the rows of its id, which come right after it; others are classes of their own.
    """
    unpack = zstandard.ZstdDecompressor().decompress
    of_id: tuple[int | None, int | None] = (None, None)
    waiting: list[_Doc] = []  # the row before, and the one before that, which waits for its next one's signature
    bucket: int | None = None
    rows: list[tuple] = []

    def done(doc: _Doc, following: _Doc) -> None:
        rows.append((doc.doc_id, len(doc.text), hashlib.sha256(doc.edited.encode()).hexdigest(), text_form(doc.sig), text_form(doc.edited_sig), likeness(doc.sig, doc.edited_sig), likeness(doc.sig, following.sig), doc.class_id))

    def close() -> None:  # the last row of a bucket is a guest: it needs no result of its own but its signature
        if len(waiting) == 2:
            waiting[1].sig = signature(waiting[1].shingles)
            done(*waiting)
        waiting.clear()

    closed = False
    for batch in batches:
        for b, guest, doc_id, packed, class_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if packed is None:
                of_id = (doc_id, class_id)
                continue
            if b != bucket:
                close()
                bucket, closed = b, False
            if closed:
                continue
            doc = _Doc(doc_id, unpack(packed).decode(), of_id[1] if of_id[0] == doc_id else doc_id)
            if waiting:
                waiting[-1].meet(doc)
                if len(waiting) == 2:
                    done(*waiting)
                    del waiting[0]
            waiting.append(doc)
            closed = guest
        if len(rows) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)
            rows.clear()
    close()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id of every row with an id.

    The edited text is the text whose last half is replaced by the first half-length of the next document's, in
    descending order of ids; after the last comes the first.  Repeated ids come in order of their texts' hashes.  class_id
    is that of near_copies.  Rows are dealt by ranges of ids into sorted buckets, one a task; the first row of each bucket
    is also sent, as a guest, to the bucket before, so that texts are shuffled once, packed, and a row finds its next one
    beside it.  Null texts count as empty; rows with a null id have no place in the order and are left out; an empty table
    gives no row.
    """
    spark = docs.sparkSession
    rows = _named(docs, id_col, text_col)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))
    # of each task, a number that is dealt to it, so that every bucket has a task of its own
    dealt_to = spark.range(64 * parts).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("task")).agg(F.min("id").cast("int")).collect()
    numbers = np.array([n for _, n in sorted(dealt_to)], np.int32)
    numbers = np.concatenate([numbers, np.arange(1 << 30, (1 << 30) + max(0, len(bounds) + 1 - len(numbers)), dtype=np.int32)])

    def bucket(ids: np.ndarray) -> np.ndarray:
        return numbers[np.searchsorted(bounds, ids)]

    @F.arrow_udf("int")
    def bucket_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, ids.to_numpy()), pa.int32())

    tops = dict(rows.select("doc_id").groupBy(bucket_of("doc_id").alias("bucket")).agg(F.max("doc_id")).collect())  # a row a bucket
    order = sorted(tops)
    host = {tops[b]: int(numbers[order[k + 1] if k + 1 < len(order) else order[0]]) for k, b in enumerate(order)}  # of a bucket's first row
    names = ["bucket", "guest", "doc_id", "tie", "packed", "class_id"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosted, pack = pa.array(list(host), pa.int64()), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids, tie, texts = batch.columns
            n = len(ids)
            packed = pa.array([pack(t.encode()) for t in texts.to_pylist()], pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array(bucket(ids.to_numpy())), pa.array(np.zeros(n, bool)), ids, tie, packed, pa.nulls(n, pa.int64())], names)
            yield out
            if len(out := out.filter(pc.is_in(ids, hosted))):
                yield pa.RecordBatch.from_arrays([pa.array([host[i] for i in out.column(2).to_pylist()], pa.int32()), pa.array(np.ones(len(out), bool)), *out.columns[2:]], names)

    def deal_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, classes = batch.columns
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(bucket(ids.to_numpy())), pa.array(np.zeros(n, bool)), ids, pa.array(np.full(n, -(1 << 63))), pa.nulls(n, pa.binary()), classes], names)

    kind = "bucket int, guest boolean, doc_id bigint, tie bigint, packed binary, class_id bigint"
    dealt = rows.select("doc_id", F.greatest(F.xxhash64("text"), F.lit(1 - (1 << 63))).alias("tie"), "text").mapInArrow(deal, kind)
    dealt = dealt.unionByName(near_copies(rows).mapInArrow(deal_classes, kind))
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.desc("doc_id"), "tie")
    return dealt.select("bucket", "guest", "doc_id", "packed", "class_id").mapInArrow(_pairs_of, RESULT)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def same_words(data: bytes) -> int:
    """A hash of all of a text's words, as a signed long."""
    return xxhash.xxh64_intdigest(b" ".join(data.lower().split())) - (1 << 63)


def distinct_shingles(text: Column) -> Column:
    """Struct of same_words and a text's distinct shingle hashes, sorted."""

    @F.arrow_udf("same bigint, shingles array<int>")
    def shingles(texts: pa.Array) -> pa.Array:
        data = [t.encode() for t in texts.to_pylist()]
        hashed = [np.unique(shingle_hashes(word_hashes(d)).view(np.int32)) for d in data]
        return pa.StructArray.from_arrays([pa.array(map(same_words, data), pa.int64()), pa.array(hashed, pa.list_(pa.int32()))], ["same", "shingles"])

    return shingles(text)


def bands(text: Column) -> Column:
    """Struct of a hash of all of a text's words and a hash of each band of its signature; a text without words has one band."""

    @F.arrow_udf("same bigint, keys array<bigint>")
    def keys(texts: pa.Array) -> pa.Array:
        same, out = [], []
        for t in texts.to_pylist():
            data = t.encode()
            sig = signature(shingle_hashes(word_hashes(data))).astype("<u4")[: BANDS * BAND].reshape(BANDS, BAND)
            same.append(same_words(data))
            out.append([xxhash.xxh64_intdigest(band.tobytes(), seed=k) - (1 << 63) for k, band in enumerate(sig)] if t.strip() else [0])
        return pa.StructArray.from_arrays([pa.array(same, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["same", "keys"])

    return keys(text)


def near_copies(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id of every document that is in one class with another id; class_id is the class's smallest id.

    Documents are linked where their sets of word shingles have a Jaccard similarity of at least `threshold`; classes are
    what links connect.  Candidates meet where a band of their signatures agrees; copies (equal words) are one text from
    then on.  Every text of a candidate group is verified against the group's first one.  What that links (`near`) isn't
    compared with itself, as it is in one class already; the others (`far`) are compared with all, in cells of two bounded
    blocks of a group, and only as many links leave a cell as connect what is connected in it.  So no group is in one
    task and no list of pairs is made; work in a group grows with near times far.  Texts without words are copies of each
    other; rows with a null id are left out; an id whose rows differ is one document with all its texts.
    """
    spark = docs.sparkSession
    rows = _named(docs, id_col, text_col)
    known = stored(rows.select(F.col("doc_id").alias("id"), bands(F.col("text")).alias("b")).select("id", "b.same", "b.keys"))
    buckets = known.select("id", F.explode("keys").alias("key"))
    low = buckets.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", "low")
    met = components(buckets.join(low, "key").where("id > low").select("id", "low").distinct(), "id", "low").withColumnRenamed("root", "grp")
    texts = stored(known.join(met, known.id == met.node).groupBy("grp", "same").agg(F.min("id").alias("id")))
    sizes = texts.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1")
    ids = stored(texts.join(sizes, "grp", "left_semi").select("grp", "same", "id"))
    wanted = ids.select("id").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    words = rows.join(wanted, rows.doc_id == wanted.id, "left_semi").select("doc_id", distinct_shingles(F.col("text")).alias("s"))
    words = words.select("doc_id", "s.same", "s.shingles").dropDuplicates(["doc_id", "same"])
    sets = stored(ids.join(words, (ids.id == words.doc_id) & (ids.same == words.same)).select("grp", "id", ids.same, "shingles"))

    first = sets.groupBy("grp").agg(F.min_by("shingles", F.struct("id", "same")).alias("of_first"), F.min("id").alias("first"))
    shared = F.size(F.array_intersect("shingles", "of_first"))
    alike = F.coalesce(shared / F.nullif(F.size("shingles") + F.size("of_first") - shared, F.lit(0)), F.lit(1.0))
    star = stored(sets.join(first, "grp").select("grp", "first", "id", "same", (alike >= threshold).alias("near")))
    counted = star.groupBy("grp").agg(*(F.ceil(F.count_if(F.col("near") if k else ~F.col("near")) / BLOCK_ROWS).cast("int").alias(n) for k, n in ((1, "near_blocks"), (0, "far_blocks"))))
    crowd = star.join(counted.where("far_blocks > 0"), "grp")
    n_near, n_far = F.col("near_blocks"), F.col("far_blocks")
    own = F.when(F.col("near"), F.pmod(F.xxhash64("id", "same"), n_near)).otherwise(n_near + F.pmod(F.xxhash64("id", "same"), n_far)).cast("int")
    cells = crowd.select("grp", "id", "same", own.alias("own"), F.explode(F.sequence(F.when(F.col("near"), n_near).otherwise(0), n_near + n_far - 1)).alias("other"))
    cells = cells.join(sets, ["grp", "id", "same"]).select("grp", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "shingles")
    found = cells.groupBy("grp", "a", "b").applyInArrow(lambda cell: cell_links(cell, threshold), "a bigint, b bigint")
    links = star.where("near and id > first").select(F.col("id").alias("a"), F.col("first").alias("b")).unionByName(found)
    linked = components(links, "a", "b")
    # an id that leads several texts of one group (rows of one id that differ) is one node, and so are its texts
    led = known.join(met, known.id == met.node).join(texts.withColumnRenamed("id", "lead"), ["grp", "same"]).select("id", "lead")
    of_texts = components(led.where("id <> lead").unionByName(linked.select(F.col("node").alias("id"), F.col("root").alias("lead"))), "id", "lead")
    return of_texts.select(F.col("node").alias("doc_id"), F.col("root").alias("class_id"))


def cell_links(cell: pa.Table, threshold: float) -> pa.Table:
    """Links between the texts of two blocks (or within one) at a Jaccard similarity of at least threshold, as a forest."""
    own, ids = cell["own"].to_numpy(), cell["id"].to_numpy()
    sets = [np.asarray(x) for x in cell["shingles"].to_numpy()]
    sizes = np.array([len(x) for x in sets])
    at = [np.flatnonzero(own == cell[k][0].as_py()) for k in "ab"]
    homes = at[0]
    values = np.concatenate([sets[i] for i in homes]) if len(homes) else np.empty(0, np.int32)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(homes)), sizes[homes])[order]
    part = {int(i): int(i) for i in ids}
    out: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while part[i] != i:
            part[i] = part[part[i]]
            i = part[i]
        return i

    for v in at[1].tolist():
        lo, hi = np.searchsorted(values, sets[v], "left"), np.searchsorted(values, sets[v], "right")
        n = hi - lo
        where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        shared = np.bincount(owner[where], minlength=len(homes))
        both = sizes[homes] + sizes[v] - shared
        for h in np.flatnonzero((shared >= threshold * both) & (ids[homes] != ids[v])).tolist():
            x, y = root(int(ids[homes[h]])), root(int(ids[v]))
            if x != y:
                part[max(x, y)] = min(x, y)
                out.append((int(ids[homes[h]]), int(ids[v])))
    return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
