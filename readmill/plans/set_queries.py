"""Consensus, alignment, clustering, assembly and error queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from readmill.functions import annotation as A
from readmill.operators import alignment as L
from readmill.operators import assembly as M
from readmill.operators import clustering as K
from readmill.operators import consensus as C
from readmill.operators import errors as E
from readmill.operators import pairing as J
from readmill.operators import reference as R
from readmill.plans.fixtures import REFERENCES, mates, oracle, reads
from readmill.schema import checkpointed
from readmill.sources import sequence_files as IO

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query of (spark, sf_dir), and its SQL over `reads` and `mates`."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return keep


MISSING = "('-', '.', 'n', 'N')"
LETTERS = f"""
, rs AS (SELECT * FROM reads WHERE {{where}}),
pos AS (SELECT barcode AS set_id, ord, i AS pos, substr(seq, CAST(i AS INT) + 1, 1) AS ch, ascii(substr(qual, CAST(i AS INT) + 1, 1)) - 33 AS q FROM rs, unnest(range(0, 66)) u(i)),
l AS (SELECT set_id, pos, ch, count(*) AS n, sum(q) AS sq, max(q) AS mq FROM pos GROUP BY ALL),
t AS (SELECT set_id, pos, sum(sq) AS aq, sum(CASE WHEN ch NOT IN {MISSING} THEN n END) AS an, min(ch) AS single FROM l GROUP BY ALL),
sz AS (SELECT barcode AS set_id, count(*) AS set_n FROM rs GROUP BY ALL)
"""
QUAL = f"""
, b AS (SELECT l.*, t.aq, t.an, least(({{num}}) // greatest(aq, 1), 90) AS cq, row_number() OVER (PARTITION BY set_id, pos ORDER BY ({{num}}) // greatest(aq, 1) DESC, ch) AS rn FROM l JOIN t USING (set_id, pos) WHERE ch NOT IN {MISSING}),
cons AS (SELECT set_id, pos, CASE WHEN b.ch IS NULL OR cq < {{mq}} OR (set_n > 1 AND b.n / b.an < {{mf}}) THEN 'N' ELSE b.ch END AS ch,
  CASE WHEN b.ch IS NULL OR cq < {{mq}} OR (set_n > 1 AND b.n / b.an < {{mf}}) THEN 0 ELSE cq END AS q FROM t JOIN sz USING (set_id) LEFT JOIN (SELECT * FROM b WHERE rn = 1) b USING (set_id, pos))
"""
FREQ = f"""
, b AS (SELECT l.*, t.an, row_number() OVER (PARTITION BY set_id, pos ORDER BY n DESC, ch) AS rn FROM l JOIN t USING (set_id, pos) WHERE ch NOT IN {MISSING}),
cons AS (SELECT set_id, pos, CASE WHEN set_n = 1 THEN single WHEN b.ch IS NULL OR b.n / b.an < {{mf}} THEN 'N' ELSE b.ch END AS ch FROM t JOIN sz USING (set_id) LEFT JOIN (SELECT * FROM b WHERE rn = 1) b USING (set_id, pos))
"""
SEQS = "SELECT set_id, string_agg(ch, '' ORDER BY pos) AS seq{more} FROM cons GROUP BY set_id"
QUALITY = LETTERS.format(where="true") + QUAL.format(num="sq * sq", mq=20, mf=0.6)


def _sets(spark, d):
    return C.with_set(reads(spark, d))


@query("b2_primer_majority", """
, v AS (SELECT barcode AS set_id, prim, count(*) AS c FROM reads GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY c DESC, prim) AS rn, sum(c) OVER (PARTITION BY set_id) AS n FROM v)
SELECT set_id, string_agg(prim, ',' ORDER BY prim) AS vals, string_agg(CAST(c AS VARCHAR), ',' ORDER BY prim) AS counts, max(CASE WHEN rn = 1 THEN prim END) AS top, round(max(CASE WHEN rn = 1 THEN c / n END), 6) AS freq FROM r GROUP BY set_id""")
def b2(spark, d):
    m = C.majority(_sets(spark, d), "PRIMER")
    return m.select("set_id", F.array_join("values", ",").alias("vals"), F.array_join(F.transform("counts", lambda c: c.cast("string")), ",").alias("counts"), "top", F.round("freq", 6).alias("freq"))


@query("b3_keep_majority", """
, v AS (SELECT barcode, prim, count(*) AS c FROM reads GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY c DESC, prim) AS rn, sum(c) OVER (PARTITION BY barcode) AS n FROM v)
SELECT ord FROM reads JOIN r ON reads.barcode = r.barcode AND reads.prim = r.prim AND rn = 1 AND c / n >= 0.6""")
def b3(spark, d):
    return C.keep_majority(_sets(spark, d), "PRIMER", 0.6).select("ord")


@query("b5_quality_consensus", QUALITY + SEQS.format(more=", string_agg(chr(CAST(q + 33 AS INT)), '' ORDER BY pos) AS qual"))
def b5(spark, d):
    return C.quality_sets(_sets(spark, d), 20, 0.6)


@query("b5_quality_consensus_dependent", LETTERS.format(where="true") + QUAL.format(num="sq * mq", mq=0, mf=0.8) + SEQS.format(more=", string_agg(chr(CAST(q + 33 AS INT)), '' ORDER BY pos) AS qual"))
def b5d(spark, d):
    return C.quality_sets(_sets(spark, d), 0, 0.8, dependent=True)


@query("b6_frequency_consensus", LETTERS.format(where="true") + FREQ.format(mf=0.6) + SEQS.format(more=""))
def b6(spark, d):
    return C.frequency_sets(_sets(spark, d), 0.6).select("set_id", "seq")


@query("b7_gap_positions", LETTERS.format(where="true") + "SELECT set_id, pos FROM (SELECT set_id, pos, sum(CASE WHEN ch <> 'N' THEN n ELSE 0 END) AS bases FROM l GROUP BY ALL) JOIN sz USING (set_id) WHERE set_n > 1 AND 1 - bases / set_n > 0.15")
def b7(spark, d):
    return C.gap_positions(_sets(spark, d).withColumn("seq", F.translate("seq", "N", "-")), 0.15)


@query("b8_diversity", """
, e AS (SELECT a.barcode AS set_id, 1 - list_sum(list_transform(range(1, 67), lambda i: CASE WHEN substr(a.seq, i, 1) = substr(b.seq, i, 1) OR substr(a.seq, i, 1) = 'N' OR substr(b.seq, i, 1) = 'N' THEN 1 ELSE 0 END)) / 66.0 AS err
  FROM reads a JOIN reads b ON a.barcode = b.barcode AND a.ord < b.ord)
SELECT set_id, round(coalesce(avg(err), 0), 6) AS diversity FROM (SELECT DISTINCT barcode AS set_id FROM reads) LEFT JOIN e USING (set_id) GROUP BY set_id""")
def b8(spark, d):
    return C.diversity(_sets(spark, d)).select("set_id", F.round("diversity", 6).alias("diversity"))


@query("b9_set_error", QUALITY + """
, r AS (SELECT set_id, ord, sum(CASE WHEN pos.ch = cons.ch AND pos.ch <> 'N' THEN 1 ELSE 0 END) AS same, sum(CASE WHEN pos.ch <> 'N' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN cons.ch <> 'N' THEN 1 ELSE 0 END) AS b FROM pos JOIN cons USING (set_id, pos) GROUP BY ALL)
SELECT set_id, round(CASE WHEN count(*) < 2 THEN 0 WHEN sum(least(a, b)) = 0 THEN 1 ELSE 1 - sum(same) / sum(least(a, b)) END, 6) AS error FROM r GROUP BY set_id""")
def b9(spark, d):
    sets = _sets(spark, d)
    return C.set_error(sets, C.quality_sets(sets, 20, 0.6)).select("set_id", F.round("error", 6).alias("error"))


@query("b12_build_consensus", LETTERS.format(where="barcode IN (SELECT barcode FROM reads GROUP BY barcode HAVING count(*) >= 5)") + QUAL.format(num="sq * sq", mq=0, mf=0.6) + """
, s AS (""" + SEQS.format(more="") + """), c AS (SELECT barcode AS set_id, count(*) AS n, sum(ord % 7 + 1 + ord % 5) AS total FROM reads GROUP BY ALL)
SELECT set_id, n AS conscount, 'CONSCOUNT=' || n || '|COUNT=' || total AS ann, seq FROM s JOIN c USING (set_id)""")
def b12(spark, d):
    out = C.build(reads(spark, d), least_count=5, copy_fields=["COUNT"], copy_actions=["sum"])
    return out.select("set_id", "conscount", F.substring_index(A.flatten(F.lit("X"), F.col("ann")), "X|", -1).alias("ann"), "seq")


@query("b11_copied_majority", """
, v AS (SELECT barcode AS set_id, sample, count(*) AS c FROM reads GROUP BY ALL)
SELECT set_id, string_agg(sample, ',' ORDER BY sample) AS vals, string_agg(CAST(c AS VARCHAR), ',' ORDER BY sample) AS counts FROM v GROUP BY set_id""")
def b11(spark, d):
    more = C.copied(_sets(spark, d), "SAMPLE", "set")
    return more.select("set_id", A.get(F.col("more"), "SAMPLE").alias("vals"), A.get(F.col("more"), "SAMPLE_COUNT").alias("counts"))


OFFSETS = [("F", 2), ("O", 0), ("P", 1)]
ALIGNED = """
, o(prim, off) AS (VALUES ('F', 2), ('O', 0), ('P', 1)), j AS (SELECT reads.*, off, {s} AS s FROM reads JOIN o USING (prim)),
m AS (SELECT *, max(length(s)) OVER (PARTITION BY barcode) AS n FROM j) SELECT ord, rpad(s, CAST(n AS INT), '-') AS seq FROM m"""


@query("l2_offset_pad", ALIGNED.format(s="repeat('-', off) || frag"))
def l2(spark, d):
    return L.offset_align(C.with_set(reads(spark, d, "frag")), spark.createDataFrame(OFFSETS, "primer string, offset int")).select("ord", "seq")


@query("l2_offset_cut", ALIGNED.format(s="substr(frag, 2 - off + 1)"))
def l2c(spark, d):
    return L.offset_align(C.with_set(reads(spark, d, "frag")), spark.createDataFrame(OFFSETS, "primer string, offset int"), mode="cut").select("ord", "seq")


@query("l1_multiple_align")
def l1(spark, d):
    return L.multiple_align(C.with_set(reads(spark, d, "frag"))).select("ord", "seq", F.length("seq").alias("n"))


COMPARED = LETTERS.format(where="barcode IN (SELECT barcode FROM reads GROUP BY barcode HAVING count(*) >= 5)") + FREQ.format(mf=0.6) + """
, x AS (SELECT pos.pos, pos.ch AS obs, cons.ch AS ref, pos.q, set_n, CASE WHEN pos.ch <> cons.ch THEN 1 ELSE 0 END AS wrong FROM pos JOIN cons USING (set_id, pos) JOIN sz USING (set_id) WHERE pos.ch <> 'N' AND cons.ch <> 'N')
"""
RATES = "sum(wrong) AS mismatch, count(*) AS total, sum(q) AS q_sum, round(CASE WHEN sum(wrong) > 0 THEN sum(wrong) / count(*) ELSE 1e-9 END, 6) AS error, round(-10 * log10(CASE WHEN sum(wrong) > 0 THEN sum(wrong) / count(*) ELSE 1e-9 END), 6) AS empirical_q, round(sum(q) / count(*), 6) AS reported_q"


def _compared(spark, d):
    sets = checkpointed(E.usable_sets(reads(spark, d), least=5).select("set_id", "seq", "qual", "set_n"))
    return E.compared(sets, C.frequency_sets(sets.drop("set_n")))


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes))


for _by in ("pos", "q", "set_n"):

    def _run(spark, d, by=_by):
        return _rounded(E.error_table(_compared(spark, d), by))

    query(f"e2_errors_by_{_by}", COMPARED + f"SELECT {_by}, {RATES} FROM x GROUP BY {_by}")(_run)


@query("e3_nucleotide_errors", COMPARED + """
, p AS (SELECT ref, obs, count(*) AS mismatch FROM x WHERE ref <> obs GROUP BY ALL), tt AS (SELECT obs AS ref, count(*) AS total, sum(q) AS q_sum FROM x GROUP BY ALL)
SELECT ref, obs, mismatch, total, q_sum, round(3 * (mismatch / total), 6) AS error, round(-10 * log10(3 * (mismatch / total)), 6) AS empirical_q, round(q_sum / total, 6) AS reported_q FROM p JOIN tt USING (ref)""")
def e3(spark, d):
    return _rounded(E.nucleotide_table(_compared(spark, d)))


BARCODE_PAIRS = """
, w AS (SELECT barcode AS v, count(*) AS w FROM reads GROUP BY ALL), p AS (SELECT 0 AS distance, w * (w - 1) // 2 AS n FROM w UNION ALL SELECT hamming(a.v, b.v), a.w * b.w FROM w a JOIN w b ON a.v < b.v),
h AS (SELECT distance, sum(n) AS n FROM p GROUP BY distance HAVING sum(n) > 0)"""
SET_PAIRS = """
, s AS (SELECT barcode, seq FROM reads WHERE barcode IN (SELECT barcode FROM reads GROUP BY barcode HAVING count(*) >= 5)),
w AS (SELECT barcode, seq AS v, count(*) AS w FROM s GROUP BY ALL),
p AS (SELECT 0 AS d, w * (w - 1) // 2 AS n FROM w UNION ALL SELECT hamming(a.v, b.v), a.w * b.w FROM w a JOIN w b ON a.barcode = b.barcode AND a.v < b.v),
h AS (SELECT CAST(floor(d * 50 / 66.0 + 1e-12) AS INT) AS bin, sum(n) AS n FROM p WHERE n > 0 GROUP BY ALL)"""


@query("e4_barcode_distances", BARCODE_PAIRS + " SELECT distance, n, 8 AS length FROM h")
def e4(spark, d):
    return E.barcode_distances(reads(spark, d))


@query("e4_set_distances", SET_PAIRS + " SELECT bin, n FROM h")
def e4s(spark, d):
    return E.set_distances(E.usable_sets(reads(spark, d), least=5))


@query("e5_barcode_threshold", BARCODE_PAIRS + """
, bins AS (SELECT i, coalesce(n, 0) AS n FROM range(0, 9) u(i) LEFT JOIN h ON distance = i), head AS (SELECT * FROM bins WHERE i < floor(0.75 * 9))
SELECT 'ALL' AS type, floor(avg(i)) / 9.0 AS threshold FROM head WHERE n = (SELECT min(n) FROM head)""")
def e5(spark, d):
    at = E.distance_threshold(E.barcode_distances(reads(spark, d)))
    return spark.createDataFrame([("ALL", at)], "type string, threshold double")


@query("e6_set_threshold", SET_PAIRS + """
, bins AS (SELECT i, coalesce(n, 0) AS n FROM range(0, 50) u(i) LEFT JOIN h ON bin = i), top AS (SELECT min(i) AS peak FROM bins WHERE n = (SELECT max(n) FROM bins)),
head AS (SELECT i - peak AS i, n FROM bins, top WHERE i >= peak AND i - peak < greatest(1, floor(0.75 * (50 - peak))))
SELECT 'ALL' AS type, floor(avg(i)) / 50.0 AS threshold FROM head WHERE n = (SELECT min(n) FROM head)""")
def e6(spark, d):
    at = E.set_threshold(E.set_distances(E.usable_sets(reads(spark, d), least=5)))
    return spark.createDataFrame([("ALL", at)], "type string, threshold double")


@query("l3_offset_table")
def l3(spark, d):
    rows = reads(spark, d)
    tail = A.get(F.col("ann"), "PRIMER")  # primers as the reads have them: the commonest letters behind the barcode, one letter fewer for each of F and O
    text = F.substring(F.col("seq"), F.when(tail == "F", 10).when(tail == "O", 11).otherwise(9), F.when(tail == "F", 9).when(tail == "O", 8).otherwise(10))
    counted = rows.groupBy(tail.alias("primer"), text.alias("text")).count()
    top = counted.groupBy("primer").agg(F.max_by("text", F.struct("count", "text")).alias("text")).orderBy("primer").collect()  # a row a primer
    return spark.createDataFrame(L.offset_table({r["primer"]: r["text"] for r in top}), "primer string, offset int")


#: One greedy pass over each set's texts of one length, a step for each place in order; all sets step together.
GREEDY = """
, texts AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY v) AS k FROM ({texts})),
pairs AS MATERIALIZED (SELECT a.set_id, a.k, list(b.k) AS near FROM texts AS a JOIN texts AS b ON a.set_id = b.set_id AND b.k < a.k AND hamming(a.v, b.v) <= {most} GROUP BY ALL),
walk (set_id, k, heads) AS (
  SELECT DISTINCT set_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM texts
  UNION ALL SELECT w.set_id, t.k, CASE WHEN list_has_any(w.heads, coalesce(p.near, [])) THEN w.heads ELSE list_append(w.heads, t.k) END
  FROM walk AS w JOIN texts AS t ON t.set_id = w.set_id AND t.k = w.k + 1 LEFT JOIN pairs AS p ON p.set_id = t.set_id AND p.k = t.k),
ended AS MATERIALIZED (SELECT set_id, arg_max(heads, k) AS heads FROM walk GROUP BY set_id),
owner AS (SELECT t.*, CASE WHEN list_contains(e.heads, t.k) THEN t.k ELSE list_min(list_intersect(e.heads, p.near)) END AS head FROM texts AS t JOIN ended AS e USING (set_id) LEFT JOIN pairs AS p USING (set_id, k))
"""


@query("c1_cluster_sets")
def c1(spark, d):
    return K.cluster_sets(reads(spark, d), ident=0.9, start=8).select("ord", "set_id", "cluster")


@query("c1_cluster_sets_by_place", GREEDY.format(texts="SELECT DISTINCT barcode AS set_id, substr(seq, 9) AS v FROM reads", most="5") + """
, n AS (SELECT set_id, head, row_number() OVER (PARTITION BY set_id ORDER BY head) AS cluster FROM (SELECT DISTINCT set_id, head FROM owner))
SELECT ord, barcode AS set_id, CAST(cluster AS INT) AS cluster FROM reads JOIN owner ON barcode = set_id AND substr(seq, 9) = v JOIN n USING (set_id, head)""")
def c1_by_place(spark, d):
    return K.cluster_sets(reads(spark, d), ident=0.9, start=8, aligned=False, shared=1).select("ord", "set_id", "cluster")


@query("c2_cluster_all")
def c2(spark, d):
    return K.cluster_all(reads(spark, d), ident=0.9, start=18).select("ord", "cluster")


@query("c3_cluster_barcodes")
def c3(spark, d):
    return K.cluster_barcodes(reads(spark, d), ident=0.85).select("ord", "cluster")


@query("c3_cluster_barcodes_by_place", GREEDY.format(texts="SELECT DISTINCT '' AS set_id, barcode AS v FROM reads", most="1") + """
, n AS (SELECT head, min(v) AS cluster FROM owner GROUP BY head) SELECT ord, cluster FROM reads JOIN owner ON barcode = v JOIN n USING (head)""")
def c3_by_place(spark, d):
    return K.cluster_barcodes(reads(spark, d), ident=0.85, aligned=False).select("ord", "cluster")


def _mates(spark, d):
    return M.oriented(J.pair(*mates(spark, d), kind="illumina"))


@query("m5_join_mates", "SELECT coord, substr(seq, 1, 40) || 'NNN' || substr(seq, 27, 40) AS seq, substr(qual, 1, 40) || '!!!' || substr(qual, 27, 40) AS qual FROM mates JOIN reads USING (ord) WHERE ord % 10 <> 0")
def m5(spark, d):
    return M.join(_mates(spark, d), 3).select("coord", "seq", "qual")


@query("m1_assembled_headers", "SELECT coord, coord || '|BARCODE=' || barcode || '|COUNT=' || cnt || ',' || cnt AS header FROM mates WHERE ord % 10 <> 0")
def m1(spark, d):
    pairs = J.pair(*mates(spark, d), kind="illumina")
    out = M.assembled_reads(pairs, M.join(M.oriented(pairs)), ["BARCODE", "COUNT"], ["COUNT"])
    return out.select("coord", A.flatten(F.col("coord"), F.col("ann")).alias("header"))


CHANCE = "list_sum(list_transform(range(CAST(same AS BIGINT), n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.25) + (n - k) * ln(0.75)) * CASE WHEN k = same THEN 0.5 ELSE 1 END))"


@query("m2_assemble_overlap", f"""
, m AS (SELECT coord, seq1 AS h, qual1 AS hq, reverse(translate(seq2, 'ACGT', 'TGCA')) AS t, reverse(qual2) AS tq FROM mates WHERE ord % 10 <> 0),
o AS (SELECT m.*, n, list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN substr(h, 40 - n + i, 1) = substr(t, i, 1) OR substr(h, 40 - n + i, 1) = 'N' OR substr(t, i, 1) = 'N' THEN 1 ELSE 0 END)) AS same FROM m, range(8, 41) u(n)),
b AS (SELECT *, (same - n / 4.0) / sqrt(3 * n / 16.0) AS z, row_number() OVER (PARTITION BY coord ORDER BY (same - n / 4.0) / sqrt(3 * n / 16.0) DESC, n) AS rn FROM o)
SELECT coord, substr(h, 1, 40 - n) || list_aggregate(list_transform(range(1, n + 1), lambda i: CASE WHEN substr(h, 40 - n + i, 1) = 'N' THEN substr(t, i, 1) WHEN substr(t, i, 1) = 'N' OR substr(hq, 40 - n + i, 1) >= substr(tq, i, 1) THEN substr(h, 40 - n + i, 1) ELSE substr(t, i, 1) END), 'string_agg', '') || substr(t, n + 1) AS seq,
  CAST(n AS INT) AS overlap, round(1 - same / n, 6) AS error, round(z, 6) AS z, {CHANCE} <= 1e-5 AND 1 - same / n <= 0.3 AS valid FROM b WHERE rn = 1""")
def m2(spark, d):
    return M.align(_mates(spark, d)).select("coord", "seq", "overlap", F.round("error", 6).alias("error"), F.round("z", 6).alias("z"), "valid")


def _references(spark, d):
    """A reference for each customer: its reads' template, with a letter less or more in two thirds of them."""
    rows = spark.sql(REFERENCES, customer=spark.read.parquet(f"{d}/customer.parquet"))
    return rows.select("name", "seq")


WORD_COUNTS = f"""
, refs AS ({REFERENCES.replace("{customer}", "customer")}),
side AS (SELECT coord, 'h' AS side, seq1 AS s FROM mates WHERE ord % 10 <> 0 UNION ALL SELECT coord, 't', reverse(translate(seq2, 'ACGT', 'TGCA')) FROM mates WHERE ord % 10 <> 0),
q AS (SELECT DISTINCT s FROM side), qw AS (SELECT s, i, substr(s, CAST(i AS INT), 9) AS w FROM q, unnest(range(1, 33)) u(i)), rw AS (SELECT name, i, substr(seq, CAST(i AS INT), 9) AS w FROM refs, unnest(range(1, 60)) u(i)),
c AS (SELECT s, name, rw.i - qw.i AS shift, count(*) AS c FROM qw JOIN rw USING (w) WHERE length(w) = 9 AND w NOT LIKE '%N%' GROUP BY ALL),
seeds AS (SELECT s, name, sum(c) AS shared, arg_min(shift, struct_pack(c := -c, shift := shift)) AS shift FROM c GROUP BY ALL)
"""


@query("m6_reference_seeds", WORD_COUNTS + "SELECT s AS seq, name, CAST(shared AS BIGINT) AS shared, CAST(shift AS INT) AS shift FROM seeds")
def m6_seeds(spark, d):
    both = _mates(spark, d)
    texts = both.select(F.col("h_seq").alias("seq")).unionByName(both.select(F.col("t_seq").alias("seq"))).distinct().withColumn("query", F.col("seq"))
    return R.seeds(texts, R.clean(_references(spark, d))).select(F.col("query").alias("seq"), "name", "shared", "shift")


@query("j5_common_references", WORD_COUNTS + """
SELECT coord, count(*) AS n, min(h.name) AS first FROM (SELECT coord, name FROM side JOIN seeds USING (s) WHERE side = 'h') AS h JOIN (SELECT coord, name FROM side JOIN seeds USING (s) WHERE side = 't') AS t USING (coord, name) GROUP BY coord""")
def j5(spark, d):
    return R.common_references(_mates(spark, d), R.clean(_references(spark, d)))


@query("m6_assemble_reference")
def m6(spark, d):
    return M.reference(_mates(spark, d), _references(spark, d), evalue=1e-3).select("coord", "seq", "overlap", "valid", "ref")


@query("m7_assemble_sequential")
def m7(spark, d):
    return M.sequential(_mates(spark, d), _references(spark, d), alpha=1e-6, evalue=1e-3).select("coord", "seq", "overlap", "valid", "ref")


@query("k4_fastq_text", "SELECT '@' || header || chr(10) || seq || chr(10) || '+' || chr(10) || qual AS value FROM reads")
def k4(spark, d):
    rows = reads(spark, d)
    return rows.select(IO.record_text("fastq", A.flatten(F.col("read_id"), F.col("ann"))).alias("value"))


@query("k4_fasta_text", "SELECT '>' || header || chr(10) || seq AS value FROM reads")
def k4a(spark, d):
    return reads(spark, d).select(IO.record_text("fasta", A.flatten(F.col("read_id"), F.col("ann"))).alias("value"))
