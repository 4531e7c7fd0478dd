"""Source divergence audit (operator 13): an inverted index that corrects a baseline of zero counts.

A group is the documents of one (lang, source).  For two groups g and h of a language, value(g, h) is the sum over the
language's V kept terms of f(p of g, p of h).  If neither had any term it were V times f of the zero counts; postings
(group, term, count) say where it is not.  With z for a count of zero, what a term adds to the baseline is

    [f(g, z) - f(z, z)]  for g's posting,  [f(z, h) - f(z, z)]  for h's,  and
    [f(g, h) - f(g, z) - f(z, h) + f(z, z)]  for a term that both have.

The first two depend on a posting's count alone, so they are emitted once for each distinct count of a group; the third is
a join of postings by term.  Nothing is emitted for a term that neither group has.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readmill.llm.common import stored, table

#: A term is a run of ASCII letters and of bytes that aren't ASCII: what other bytes become a space, A-Z become a-z.
TABLE = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
#: Sums that a task holds, and bytes of a text that it splits at a time.
ENTRIES, SLICE = 500_000, 4_000_000
#: Documents of a language that a kept term is in at least; ranks of part `term`.
LEAST_DOCS, TERM_RANKS = 3, 200
#: Sources of a language that meet at one key.
SOURCE_ROWS = 1024


def share(count: Column, n: Column, v: Column) -> Column:
    """p of a term: 1 + floor(10^9 * (count + 1) / (n + v)), exact."""
    p = F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), (n + v).cast("decimal(20,0)"))
    return F.when(v > 0, 1 + p)


def difference(p: Column, q: Column) -> Column:
    """f: floor((p - q)^2 / q); p and q are at most 10^9 + 1, so all fits in longs."""
    return F.call_function("div", (p - q) * (p - q), q)


def _flushed(found: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (counts, seen) in found.items():
        n = len(counts)
        terms = pa.array(counts.keys(), pa.binary()).cast(pa.string())
        columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), terms, pa.array(counts.values(), pa.int64()), pa.array(map(seen.__getitem__, counts), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "count", "docs"])
    found.clear()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's documents (lang, source, text), given out whenever ENTRIES of them are held."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0
    for batch in batches:
        langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
        for lang, source, text in zip(langs, sources, texts, strict=True):
            counts, seen = found.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(counts), {b""}
            counts[b""] += 1
            for words in slices(text.as_py().translate(TABLE)):
                counts.update(words)
                own.update(words)
            seen.update(own)
            held += len(counts) - before
            if held > ENTRIES:
                yield from _flushed(found)
                held = 0
    yield from _flushed(found)


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in which spaces divide them, some SLICE bytes at a time."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE) if at + SLICE < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: occurrences of a term in a group and documents that it is in.

    Every document has the term '' once, so that groups without terms are there too.  Tasks count in C loops over bytes
    (the letters that aren't ASCII are bytes of 128 and more) and emit sums, not words; Spark sums those.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    sums = rows.mapInArrow(counted, "lang string, source string, term string, count bigint, docs bigint")
    return sums.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: how each group differs from the others of its language (part `pair`) and its
    terms that are commoner than in the language (part `term`, ranks to TERM_RANKS).

    Null text, lang and source are ''.  Groups without terms, and languages without kept terms, have pairs (value 0 if
    there is no kept term).  Repeated rows count each; other columns play no part; an empty table gives no row.  Values
    beyond a long are an error.
    """
    counts = stored(term_counts(docs))
    kept = stored(counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("all")).where(F.col("docs") >= LEAST_DOCS).drop("docs"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_n"))
    postings = counts.join(kept, ["lang", "term"])
    sizes = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = counts.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "lang_n")))
    groups = stored(groups.withColumn("zero", share(F.lit(0), F.col("n"), F.col("v"))))
    postings = stored(postings.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v"))))
    return _pairs(groups, postings).unionByName(_terms(postings))


def _ranked(rows: DataFrame, part: str, ranks: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(order))
    return (out.where(F.col("rank") <= ranks) if ranks else out).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _terms(postings: DataFrame) -> DataFrame:
    q = share(F.col("all"), F.col("lang_n"), F.col("v"))
    rows = postings.select("lang", "source", F.col("term").alias("item"), "p", q.alias("q")).where("p > q").withColumn("value", difference(F.col("p"), F.col("q")))
    return _ranked(rows, "term", TERM_RANKS)


def _pairs(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """Baseline and corrections of all ordered pairs, summed by pair: partial sums are combined before the shuffle."""
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks = 1 + most // SOURCE_ROWS

    def meet(left: DataFrame, right: DataFrame, on: list[str], n: int) -> DataFrame:
        """left and right (whose columns get an r_) by `on`, for two different sources: left dealt by its source, right sent to each of n deals."""
        left = left.withColumn("deal", F.pmod(F.xxhash64("source"), F.lit(n)).cast("int"))
        right = right.select(*on, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in on)).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return left.join(right, [*on, "deal"]).where("source <> r_source")

    def wide(col: Column) -> Column:
        return F.sum(col.cast("decimal(20,0)")).alias("value")

    zero, r_zero, p, r_p = (F.col(c) for c in ("zero", "r_zero", "p", "r_p"))
    both, pair = difference(zero, r_zero), [F.col("source").alias("g"), F.col("r_source").alias("h")]
    group = groups.select("lang", "source", "v", "zero")
    # a language's groups are few keys with many rows, so they are dealt into at least as many deals as make tasks
    deals = max(blocks, 8)
    base = meet(group, group.drop("v"), ["lang"], deals).select("lang", *pair, F.when(F.col("v") > 0, F.col("v").cast("decimal(20,0)") * both).otherwise(F.lit(0)).cast("decimal(38,0)").alias("value"))
    alike = postings.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("m"))
    ours = meet(alike, group.drop("v"), ["lang"], deals).groupBy("lang", *pair).agg(wide(F.col("m") * (difference(p, r_zero) - both)))
    theirs = meet(group.drop("v"), alike, ["lang"], deals).groupBy("lang", *pair).agg(wide(F.col("r_m") * (difference(zero, r_p) - both)))
    posting = postings.select("lang", "term", "source", "p", "zero")
    shared = meet(posting, posting, ["lang", "term"], blocks).groupBy("lang", *pair).agg(wide(difference(p, r_p) - difference(p, r_zero) - difference(zero, r_p) + both))
    parts = [x.select("lang", "g", "h", F.col("value").cast("decimal(38,0)").alias("value")) for x in (base, ours, theirs, shared)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    total = rows.groupBy("lang", "g", "h").agg(F.sum("value").cast("bigint").alias("value"))
    return _ranked(total.select("lang", F.col("g").alias("source"), F.col("h").alias("item"), "value"), "pair")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n_all FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 3),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n_all) AS lang_n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM t GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, k.n_all, coalesce(c.c, 0) AS c FROM groups AS g JOIN kept AS k USING (lang) LEFT JOIN counts AS c USING (lang, source, term)),
sizes AS (SELECT lang, source, sum(c) AS n FROM cells GROUP BY ALL),
p AS (
    SELECT lang, source, term, c, 1 + (1000000000 * (c + 1)) // (n + v) AS p, 1 + (1000000000 * (n_all + 1)) // (lang_n + v) AS q
    FROM cells JOIN sizes USING (lang, source) JOIN langs USING (lang)
), pair AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value
    FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN p AS x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p AS y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
    GROUP BY ALL
), term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE c > 0 AND p > q),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""
