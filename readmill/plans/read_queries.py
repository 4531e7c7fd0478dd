"""Filters, primers, pairs, headers, groups and parts as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.functions import annotation as A
from readmill.functions import headers as H
from readmill.functions import sequence as S
from readmill.operators import collapse as D
from readmill.operators import filters as Flt
from readmill.operators import pairing as J
from readmill.operators import primers as P
from readmill.operators import split as X
from readmill.operators import unify as U
from readmill.plans.fixtures import PRIMERS, mates, oracle, plain_reads, reads
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


HEADER = lambda: A.flatten(F.col("read_id"), F.col("ann")).alias("header")
MISS = "'-.nN'"
SUM_Q = "list_sum(list_transform(string_split({q}, ''), lambda c: ascii(c) - 33))"


@query("flagship_unique_reads", f"""
, good AS (SELECT *, {SUM_Q.format(q='qual')} / length(qual) AS mq FROM reads WHERE floor({SUM_Q.format(q='qual')} / length(qual)) >= 25 AND seq NOT LIKE '%N%'),
rep AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY mq DESC, ord) AS rn, count(*) OVER (PARTITION BY seq) AS dupcount FROM good)
SELECT 'M01:' || ord AS id, barcode, prim AS primer, dupcount, seq FROM rep WHERE rn = 1 AND dupcount >= 2""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Unique sequences seen at least twice among reads of good quality."""
    good = Flt.quality(reads(spark, d), 25).where("valid").drop("valid")
    kept = X.by_group(D.unique_reads(good), "DUPCOUNT", 2).where("part = 'atleast'")
    return kept.select(F.col("read_id").alias("id"), A.get(F.col("ann"), "BARCODE").alias("barcode"), A.get(F.col("ann"), "PRIMER").alias("primer"), A.get(F.col("ann"), "DUPCOUNT").cast("bigint").alias("dupcount"), "seq")


@query("f1_filter_length", f"SELECT ord, length(trim(frag, {MISS})) >= 55 AS valid FROM reads")
def f1(spark, d):
    return Flt.length(reads(spark, d, "frag"), 55, inner=True).select("ord", "valid")


@query("f2_filter_missing", f"SELECT ord, length(frag) - length(translate(frag, {MISS}, '')) <= 2 AS valid FROM reads")
def f2(spark, d):
    return Flt.missing(reads(spark, d, "frag"), 2).select("ord", "valid")


@query("f3_filter_repeats", f"SELECT ord, coalesce(list_max(list_transform(regexp_extract_all(translate(frag, {MISS}, ''), 'A+|C+|G+|T+'), lambda x: length(x))), 0) <= 3 AS valid FROM reads")
def f3(spark, d):
    return Flt.repeats(reads(spark, d, "frag"), 3).select("ord", "valid")


@query("f4_filter_quality", f"SELECT ord, CAST(floor({SUM_Q.format(q='qual')} / length(qual)) AS INT) AS mean_q, floor({SUM_Q.format(q='qual')} / length(qual)) >= 25 AS valid FROM reads")
def f4(spark, d):
    return Flt.quality(reads(spark, d), 25).select("ord", S.mean_quality(F.col("qual")).alias("mean_q"), "valid")


LOW = "list_filter(range(0, length({q}), 10), lambda s: list_sum(list_transform(string_split(substr({q}, s + 1, 10), ''), lambda c: ascii(c) - 33)) < 25 * length(substr({q}, s + 1, 10)))"


@query("f6_trim_quality", f"SELECT ord, substr(seq, 1, k) AS seq, substr(qual, 1, k) AS qual, k > 0 AS valid FROM (SELECT *, coalesce(({LOW.format(q='qual')})[1], length(qual)) AS k FROM reads)")
def f6(spark, d):
    return Flt.trim_quality(reads(spark, d), 25).select("ord", "seq", "qual", "valid")


@query("f6_trim_quality_reverse", f"SELECT ord, substr(seq, 67 - k, k) AS seq, substr(qual, 67 - k, k) AS qual, k > 0 AS valid FROM (SELECT *, coalesce(({LOW.format(q='reverse(qual)')})[1], length(qual)) AS k FROM reads)")
def f6r(spark, d):
    return Flt.trim_quality(reads(spark, d), 25, reverse=True).select("ord", "seq", "qual", "valid")


@query("f7_mask_quality", "SELECT ord, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN ascii(substr(qual, i, 1)) - 33 < 20 THEN 'N' ELSE substr(seq, i, 1) END), '') AS seq FROM reads")
def f7(spark, d):
    return Flt.mask_quality(reads(spark, d)).select("ord", "seq")


@query("p9_reverse_complement", "SELECT ord, reverse(translate(seq, 'ACGTN', 'TGCAN')) AS seq, reverse(qual) AS qual FROM reads")
def p9(spark, d):
    return reads(spark, d).select("ord", S.reverse_complement(F.col("seq")).alias("seq"), F.reverse("qual").alias("qual"))


IUPAC_SQL = "CASE substr(p.pat, i, 1) WHEN 'R' THEN 'AG' WHEN 'Y' THEN 'CT' WHEN 'W' THEN 'AT' WHEN 'N' THEN 'ACGT' ELSE substr(p.pat, i, 1) END"
SCORED = f"""
, p(name, pat, o) AS (VALUES ('F', 'CACGTNTTAG', 0), ('O', 'GGCRTTACAY', 1), ('P', 'TTGACWGGAA', 2)),
s AS (SELECT r.*, p.name, p.o, 1 - list_sum(list_transform(range(1, 11), lambda i: CASE WHEN strpos({IUPAC_SQL}, substr(r.seq, 8 + i, 1)) > 0 THEN 1 ELSE 0 END)) / 10.0 AS err FROM reads r CROSS JOIN p),
best AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY err, o) AS rn FROM s)"""


@query("p2_score_primers", SCORED + "SELECT ord, CASE WHEN err < 1 THEN name END AS primer, round(err, 6) AS error, err <= 0.2 AS valid FROM best WHERE rn = 1")
def p2(spark, d):
    return P.score_primers(reads(spark, d), PRIMERS, start=8).select("ord", "primer", F.round("error", 6).alias("error"), "valid")


def _masked(mode: str, seq: str, qual: str) -> None:
    sql = SCORED + f"SELECT ord, 'M01:' || ord || '|BARCODE=' || barcode || ',' || substr(seq, 3, 6) || '|PRIMER=' || prim || ',' || name || '|SAMPLE=' || sample || '|COUNT=' || cnt AS header, {seq} AS seq, {qual} AS qual FROM best WHERE rn = 1 AND err <= 0.2"

    @query(f"p8_mask_primers_{mode}", sql)
    def run(spark, d):
        out = P.mask(P.score_primers(reads(spark, d), PRIMERS, start=8), mode, barcode=True, barcode_length=6).where("valid")
        return out.select("ord", HEADER(), "seq", "qual")


for _mode, _seq, _qual in (("cut", "substr(seq, 19)", "substr(qual, 19)"), ("trim", "substr(seq, 9)", "substr(qual, 9)"), ("mask", "'NNNNNNNNNN' || substr(seq, 19)", "'!!!!!!!!!!' || substr(qual, 19)"), ("tag", "seq", "qual")):
    _masked(_mode, _seq, _qual)


@query("p6_extract_region", "SELECT ord, substr(seq, 9, 10) AS primer, substr(seq, 19) AS seq, substr(seq, 1, 8) AS barcode FROM reads")
def p6(spark, d):
    out = P.mask(P.extract_region(reads(spark, d).withColumn("ann", A.delete(F.col("ann"), ["BARCODE", "PRIMER"])), 8, 10), "cut", barcode=True)
    return out.select("ord", A.get(F.col("ann"), "PRIMER").alias("primer"), "seq", A.get(F.col("ann"), "BARCODE").alias("barcode"))


@query("p4_align_primers")
def p4(spark, d):
    return P.align_primers(reads(spark, d), PRIMERS, most_length=30).select("ord", "primer", F.round("error", 6).alias("error"), "p_start", "p_end", "orient", "valid")


@query("j1_pair_reads", "SELECT coord, 'BARCODE=' || barcode || '|COUNT=' || cnt || ',' || cnt || '|PRIMER=' || prim AS ann1, 'PRIMER=' || prim || '|COUNT=' || cnt || '|BARCODE=' || barcode AS ann2, seq1, seq2 FROM mates WHERE ord % 10 <> 0")
def j1(spark, d):
    out = J.pair(*mates(spark, d), fields_1=["BARCODE"], fields_2=["PRIMER", "COUNT"], kind="illumina")
    text = lambda r: F.substring_index(A.flatten(F.lit("X"), F.col(f"{r}.ann")), "X|", -1)
    return out.select("coord", text("r1").alias("ann1"), text("r2").alias("ann2"), F.col("r1.seq").alias("seq1"), F.col("r2.seq").alias("seq2"))


@query("j1_pair_reads_sum", "SELECT coord, CAST(2 * (ord % 7 + 1) + 2 * (ord % 5) AS VARCHAR) AS c1 FROM mates WHERE ord % 10 <> 0")
def j1s(spark, d):
    out = J.pair(*mates(spark, d), fields_2=["COUNT"], action="sum", kind="illumina")
    return out.select("coord", A.get(F.col("r1.ann"), "COUNT").alias("c1"))


@query("j2_unpaired_reads", "SELECT coord, 1 AS side FROM mates WHERE ord % 10 = 0")
def j2(spark, d):
    return J.unpaired(*mates(spark, d), kind="illumina").select("coord", "side")


@query("j4_coordinate_keys", "SELECT ord, coord AS illumina, 'SRR1.' || ord AS sra, 'ACC' || ord AS m454, 'M01:' || ord AS annotated FROM mates")
def j4(spark, d):
    rows = plain_reads(spark, d)
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    k = F.col("ord").cast("string")
    return rows.select("ord", A.coordinate(text("M01:1:FC:1:1101:", k, ":", (F.col("ord") % 1000).cast("string"), "#ACGT/1"), "illumina").alias("illumina"), A.coordinate(text("SRR1.", k, ".2 x length=3"), "sra").alias("sra"), A.coordinate(text("ACC", k, " length=3"), "454").alias("m454"), A.coordinate(F.col("header")).alias("annotated"))


@query("j6_synchronized_pairs", "SELECT coord, seq1, seq2 FROM mates WHERE ord % 10 <> 0")
def j6(spark, d):
    one, two = mates(spark, d)
    return J.synchronized(one.where("ord % 10 <> 0"), two, kind="illumina").select("coord", F.col("r1.seq").alias("seq1"), F.col("r2.seq").alias("seq2"))


REP = """
, c AS (SELECT *, {key} AS key, {sum} / length(qual) AS mq FROM reads WHERE {where}),
rep AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order} ord) AS rn, count(*) OVER (PARTITION BY {by}) AS dupcount,
  min(ord % 7 + 1) OVER (PARTITION BY {by}) AS low, max(greatest(ord % 7 + 1, ord % 5)) OVER (PARTITION BY {by}) AS high, sum(ord % 7 + 1 + ord % 5) OVER (PARTITION BY {by}) AS total FROM c)
"""


@query("d1_collapse_exact", REP.format(key="seq", sum=SUM_Q.format(q="qual"), where="seq NOT LIKE '%N%'", by="key", order="mq DESC,") + "SELECT ord, dupcount, CAST(total AS VARCHAR) AS total, seq FROM rep WHERE rn = 1")
def d1(spark, d):
    out = D.unique_reads(reads(spark, d), copy_fields=["COUNT"], copy_actions=["sum"])
    return out.select("ord", "dupcount", A.get(F.col("ann"), "COUNT").alias("total"), "seq")


@query("d3_collapse_by_field", REP.format(key="seq", sum=SUM_Q.format(q="qual"), where="seq NOT LIKE '%N%'", by="key, sample", order="") + "SELECT min(ord) AS ord, max(dupcount) AS dupcount, sample, CAST(max(high) AS VARCHAR) AS high, CAST(min(least(low, 1000)) AS VARCHAR) AS low FROM (SELECT ord, dupcount, sample, high, min(least(ord % 7 + 1, ord % 5)) OVER (PARTITION BY key, sample) AS low, key FROM rep) GROUP BY key, sample")
def d3(spark, d):
    rows = reads(spark, d).withColumn("qual", F.lit("")).withColumn("ann", A.copy(F.col("ann"), ["COUNT"], ["LOW"]))
    out = D.unique_reads(rows, uniq_fields=["SAMPLE"], copy_fields=["COUNT", "LOW"], copy_actions=["max", "min"])
    return out.select("ord", "dupcount", A.get(F.col("ann"), "SAMPLE").alias("sample"), A.get(F.col("ann"), "COUNT").alias("high"), A.get(F.col("ann"), "LOW").alias("low"))


@query("d4_collapse_set", "SELECT seq, string_agg(DISTINCT sample, ',' ORDER BY sample) AS samples FROM reads WHERE seq NOT LIKE '%N%' GROUP BY seq")
def d4(spark, d):
    return D.unique_reads(reads(spark, d), copy_fields=["SAMPLE"], copy_actions=["set"]).select("seq", A.get(F.col("ann"), "SAMPLE").alias("samples"))


@query("d5_undetermined", f"SELECT ord, length(seq) - length(translate(seq, 'N', '')) AS n FROM reads WHERE length(seq) - length(translate(seq, 'N', '')) > 1")
def d5(spark, d):
    return D.undetermined(reads(spark, d), 1).select("ord", S.count_letters(F.col("seq"), "N").alias("n"))


@query("d5_duplicates", REP.format(key="seq", sum=SUM_Q.format(q="qual"), where="seq NOT LIKE '%N%'", by="key", order="mq DESC,") + "SELECT ord FROM rep WHERE rn > 1")
def d5b(spark, d):
    rows = reads(spark, d).where(~F.col("seq").contains("N"))
    return D.duplicates(rows, D.unique_reads(rows)).select("ord")


@query("d2_collapse_ambiguous", f"""
, c AS (SELECT *, length(seq) - length(translate(seq, 'N', '')) AS missing, {SUM_Q.format(q='qual')} / length(qual) AS mq FROM reads),
k AS (SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY missing, o) AS i FROM (SELECT barcode, seq, missing, min(ord) AS o FROM c WHERE missing <= 3 GROUP BY ALL)),
walk AS (SELECT barcode, i, seq, [seq] AS heads, seq AS head FROM k WHERE i = 1 UNION ALL
  SELECT barcode, i, seq, CASE WHEN f IS NULL THEN list_append(heads, seq) ELSE heads END, coalesce(f, seq) FROM (
    SELECT k.barcode, k.i, k.seq, heads, CASE WHEN missing = 0 THEN NULL ELSE list_filter(heads, lambda x: list_sum(list_transform(range(1, 67), lambda j: CASE WHEN substr(x, j, 1) = substr(k.seq, j, 1) OR substr(x, j, 1) = 'N' OR substr(k.seq, j, 1) = 'N' THEN 0 ELSE 1 END)) = 0)[1] END AS f
    FROM walk JOIN k ON k.barcode = walk.barcode AND k.i = walk.i + 1)),
rep AS (SELECT c.*, row_number() OVER (PARTITION BY c.barcode, head ORDER BY missing, mq DESC, ord) AS rn, count(*) OVER (PARTITION BY c.barcode, head) AS dupcount FROM c JOIN walk ON c.barcode = walk.barcode AND c.seq = walk.seq)
SELECT ord, dupcount, seq FROM rep WHERE rn = 1""")
def d2(spark, d):
    return D.ambiguous_reads(reads(spark, d), 3, uniq_fields=["BARCODE"]).select("ord", "dupcount", "seq")


NEW = "'M01:' || ord || '|BARCODE=' || barcode || '|PRIMER=' || prim || '|SAMPLE=' || sample"
_HEADERS = {
    "a1_parse_flatten": (f"{NEW} || '|COUNT=' || cnt", lambda a: a),
    "a3_merge": (f"{NEW} || ',' || prim || '|COUNT=' || cnt || '|NEW=1'", lambda a: A.merge(a, A.pairs({"SAMPLE": A.get(a, "PRIMER"), "NEW": F.lit("1")}))),
    "a3_merge_prepend": (f"'M01:' || ord || '|BARCODE=' || barcode || '|PRIMER=' || prim || '|SAMPLE=' || prim || ',' || sample || '|COUNT=' || cnt", lambda a: A.merge(a, A.pairs({"SAMPLE": A.get(a, "PRIMER")}), prepend=True)),
    "a4_add": (f"{NEW} || '|COUNT=' || cnt || ',7|LANE=L1'", lambda a: A.add(a, {"count": F.lit("7"), "lane": F.lit("L1")})),
    "a5_collapse_min": (f"{NEW} || '|COUNT=' || least(ord % 7 + 1, ord % 5)", lambda a: A.collapse(a, "min", ["COUNT"])),
    "a5_collapse_max": (f"{NEW} || '|COUNT=' || greatest(ord % 7 + 1, ord % 5)", lambda a: A.collapse(a, "max", ["COUNT"])),
    "a5_collapse_sum": (f"{NEW} || '|COUNT=' || (ord % 7 + 1 + ord % 5)", lambda a: A.collapse(a, "sum", ["COUNT"])),
    "a5_collapse_set": (f"{NEW} || '|COUNT=' || CASE WHEN ord % 7 + 1 = ord % 5 THEN '' || (ord % 5) ELSE least(ord % 7 + 1, ord % 5) || ',' || greatest(ord % 7 + 1, ord % 5) END", lambda a: A.collapse(a, "set", ["COUNT"])),
    "a5_collapse_first": (f"{NEW} || '|COUNT=' || (ord % 7 + 1)", lambda a: A.collapse(a, "first", ["COUNT"])),
    "a5_collapse_last": (f"{NEW} || '|COUNT=' || (ord % 5)", lambda a: A.collapse(a, "last", ["COUNT"])),
    "a5_collapse_cat": (f"{NEW} || '|COUNT=' || (ord % 7 + 1) || (ord % 5)", lambda a: A.collapse(a, "cat", ["COUNT"])),
    "a6_copy": (f"{NEW} || '|COUNT=' || cnt || '|TOTAL=' || (ord % 7 + 1 + ord % 5)", lambda a: A.copy(a, ["COUNT"], ["TOTAL"], ["sum"])),
    "a7_delete": ("'M01:' || ord || '|BARCODE=' || barcode || '|COUNT=' || cnt", lambda a: A.delete(a, ["primer", "sample"])),
    "a8_expand": (f"{NEW} || '|COUNT1=' || (ord % 7 + 1) || '|COUNT2=' || (ord % 5)", lambda a: A.expand(a, ["COUNT"])),
    "a9_merge_fields": ("'M01:' || ord || '|BARCODE=' || barcode || '|COUNT=' || cnt || '|TAG=' || prim || sample", lambda a: A.merge_fields(a, ["PRIMER", "SAMPLE"], "TAG", "cat", remove=True)),
    "a11_rename": ("'M01:' || ord || '|UMI=' || barcode || '|PRIMER=' || prim || '|COUNT=' || cnt || ',' || sample", lambda a: A.rename(a, ["BARCODE", "SAMPLE"], ["UMI", "COUNT"])),
}
for _name, (_sql, _change) in _HEADERS.items():

    def _run(spark, d, change=_change):
        return reads(spark, d).withColumn("ann", change(F.col("ann"))).select("ord", HEADER())

    query(_name, f"SELECT ord, {_sql} AS header FROM reads")(_run)


@query("a10_header_table", "SELECT 'M01:' || ord AS id, barcode, cnt AS count, '' AS other FROM reads")
def a10(spark, d):
    return reads(spark, d).select(F.col("read_id").alias("id"), *(F.coalesce(A.get(F.col("ann"), f), F.lit("")).alias(f.lower()) for f in ("BARCODE", "COUNT", "OTHER")))


_FORMATS = {
    "h1_generic": ("'a b=' || ord || '|c, d'", H.generic, "'a_b_' || ord || '_c_d'"),
    "h2_roche454": ("CASE WHEN ord % 2 = 0 THEN 'G' || ord || ' length=222' ELSE 'R' || ord || ' length=437 uaccno=GN' || ord END", H.roche454, "CASE WHEN ord % 2 = 0 THEN 'G' || ord || '|LENGTH=222' ELSE 'R' || ord || '|LENGTH=437|UACCNO=GN' || ord END"),
    "h3_genbank": ("CASE WHEN ord % 2 = 0 THEN 'CM' || ord || '.2 Homo sapiens, x=1' ELSE 'gi|' || ord || '|gb|CM1.2| Homo sapiens, y' END", H.genbank, "CASE WHEN ord % 2 = 0 THEN 'CM' || ord || '.2|DESC=Homo_sapiens__x_1' ELSE 'CM1.2|GI=' || ord || '|SOURCE=gb|DESC=Homo_sapiens_y' END"),
    "h4_illumina": ("CASE ord % 3 WHEN 0 THEN 'M:' || ord || ' 2:N:0:ATC' WHEN 1 THEN 'H:' || ord || '#ATC/1' ELSE 'S:' || ord || '/1' END", H.illumina, "CASE ord % 3 WHEN 0 THEN 'M:' || ord || '|INDEX=ATC|READ=2' WHEN 1 THEN 'H:' || ord || '|INDEX=ATC|READ=1' ELSE 'S:' || ord || '|READ=1' END"),
    "h5_imgt": ("'X' || ord || '|IGHV1-18*02|Homo sapiens|(F)|V-REGION|142..417|276 nt|1| | | | |276+24=300|' || CASE WHEN ord % 2 = 0 THEN ' ' ELSE 'partial in 3''' END || '| |'", H.imgt, "'IGHV1-18*02|SPECIES=Homo_sapiens|REGION=V-REGION|FUNCTIONALITY=F|PARTIAL=' || CASE WHEN ord % 2 = 0 THEN 'FALSE' ELSE 'TRUE' END || '|ACCESSION=X' || ord"),
    "h6_sra": ("CASE ord % 3 WHEN 0 THEN 'SRR1.' || ord || '.2 1 length=250' WHEN 1 THEN 'SRR1.' || ord || ' 1 length=250' ELSE 'ERR.' || ord || ' BS:4/1' END", H.sra, "CASE ord % 3 WHEN 0 THEN 'SRR1.' || ord || '|READ=2|DESC=1|LENGTH=250' WHEN 1 THEN 'SRR1.' || ord || '|DESC=1|LENGTH=250' ELSE 'ERR.' || ord || '|DESC=BS:4/1' END"),
    "h7_migec": ("'MIG UMI:TCG:' || ord", H.migec, "'TCG|COUNT=' || ord"),
}
for _name, (_made, _convert, _want) in _FORMATS.items():

    def _run(spark, d, made=_made, convert=_convert):
        got = plain_reads(spark, d).select("ord", convert(F.expr(made)).alias("h"))
        return got.select("ord", A.flatten(F.col("h.read_id"), F.col("h.ann")).alias("header"))

    query(_name, f"SELECT ord, {_want} AS header FROM reads")(_run)

MODE = "SELECT barcode, sample, row_number() OVER (PARTITION BY barcode ORDER BY count(*) DESC, sample) AS rn FROM reads GROUP BY barcode, sample"


@query("u1_unify_consensus", f", m AS ({MODE}) SELECT r.ord, m.sample FROM reads r JOIN m ON r.barcode = m.barcode AND m.rn = 1")
def u1(spark, d):
    return U.consensus(reads(spark, d)).select("ord", A.get(F.col("ann"), "SAMPLE").alias("sample"))


@query("u2_unify_delete", "SELECT ord FROM reads WHERE barcode IN (SELECT barcode FROM reads GROUP BY barcode HAVING count(DISTINCT sample) = 1)")
def u2(spark, d):
    return U.deletion(reads(spark, d)).select("ord")


@query("x1_split_count", "SELECT ord, CAST((row_number() OVER (ORDER BY ord) - 1) // 1000 + 1 AS INT) AS part FROM reads")
def x1(spark, d):
    return X.by_count(reads(spark, d), 1000).select("ord", "part")


@query("x2_split_group", "SELECT ord, CASE WHEN ord % 5 < 3 THEN 'under' ELSE 'atleast' END AS part, sample FROM reads")
def x2(spark, d):
    rows = reads(spark, d).withColumn("ann", A.collapse(F.col("ann"), "last", ["COUNT"]))
    return X.by_group(rows, "COUNT", 3).select("ord", "part", A.get(F.col("ann"), "SAMPLE").alias("sample"))


@query("x3_sample", "SELECT ord, sample FROM (SELECT ord, sample, row_number() OVER (PARTITION BY sample ORDER BY md5(ord || '|5'), ord) AS rn FROM reads) WHERE rn <= 50")
def x3(spark, d):
    return X.sample(reads(spark, d), 50, "SAMPLE", seed=5).select("ord", A.get(F.col("ann"), "SAMPLE").alias("sample"))


@query("x3_sample_values", "SELECT ord FROM reads WHERE sample IN ('S1', 'S2') ORDER BY md5(ord || '|5'), ord LIMIT 100")
def x3v(spark, d):
    return X.sample(reads(spark, d), 100, "SAMPLE", ["S1", "S2"], seed=5).select("ord")


@query("x4_sample_pairs", "SELECT coord FROM (SELECT coord FROM mates WHERE ord % 10 <> 0 ORDER BY md5(coord || '|5'), coord LIMIT 100)")
def x4(spark, d):
    one, two = X.sample_pairs(*mates(spark, d), 100, kind="illumina", seed=5)
    return one.select("coord").intersect(two.select("coord"))


@query("x5_select", "SELECT ord FROM reads WHERE ord % 7 + 1 IN (2, 9) OR ord % 5 IN (2, 9)")
def x5(spark, d):
    return X.select(reads(spark, d), "COUNT", ["2", "9"]).select("ord")


@query("x5_select_not", "SELECT ord FROM reads WHERE sample NOT IN (SELECT 'S' || substr(o_orderpriority, 1, 1) FROM orders WHERE o_orderkey < 2)")
def x5n(spark, d):
    rows = reads(spark, d)
    values = rows.where("ord < 2").select(A.get(F.col("ann"), "SAMPLE").alias("v"))
    return X.select(rows, "SAMPLE", values, negate=True).select("ord")


@query("x6_sort", "SELECT ord, row_number() OVER (ORDER BY ord % 7 + 1, ord) AS place FROM reads")
def x6(spark, d):
    rows = reads(spark, d).withColumn("ann", A.collapse(F.col("ann"), "first", ["COUNT"]))
    key = A.get(F.col("ann"), "COUNT").cast("double")
    return X.numbered(rows, [key, F.col("ord")], "place").select("ord", (F.col("place") + 1).alias("place"))


@query("x6_sorted_parts", """
, s AS (SELECT v, c, row_number() OVER (ORDER BY v) AS i FROM (SELECT ord % 7 + 1 AS v, count(*) AS c FROM reads GROUP BY ALL)),
walk AS (SELECT i, v, 1 AS part, c AS held FROM s WHERE i = 1 UNION ALL
  SELECT s.i, s.v, CASE WHEN held + c > 5000 THEN part + 1 ELSE part END, CASE WHEN held + c > 5000 THEN c ELSE held + c END FROM walk JOIN s ON s.i = walk.i + 1)
SELECT ord, part FROM reads JOIN walk ON ord % 7 + 1 = v""")
def x6p(spark, d):
    rows = reads(spark, d).withColumn("ann", A.collapse(F.col("ann"), "first", ["COUNT"]))
    return X.sorted_parts(rows, "COUNT", 5000, numeric=True).select("ord", "part")


@query("s10_count_records", "SELECT count(*) AS n FROM reads")
def s10(spark, d):
    return reads(spark, d).agg(F.count("*").alias("n"))


@query("s11_count_sets", "SELECT count(DISTINCT barcode) AS sets FROM reads")
def s11(spark, d):
    return IO.count_sets(reads(spark, d), "BARCODE")


@query("s4_key_uniqueness", "SELECT barcode AS read_id, count(*) AS n FROM reads GROUP BY barcode HAVING count(*) > 1")
def s4(spark, d):
    return J.uniqueness(reads(spark, d).withColumn("read_id", A.get(F.col("ann"), "BARCODE")))


@query("s6_references", "SELECT ord, replace(frag, '-', '') AS seq FROM reads")
def s6(spark, d):
    return reads(spark, d, "frag").select("ord", F.upper(F.translate("seq", "-.", "")).alias("seq"))


@query("r6_weight", f"SELECT ord, length(translate(frag, {MISS}, '')) AS w FROM reads")
def r6(spark, d):
    return reads(spark, d, "frag").select("ord", S.weight(F.col("seq")).alias("w"))


#: Which letters match a letter of the pattern below, written out.
AMINO_SQL = "CASE i WHEN 1 THEN 'RBX' WHEN 2 THEN 'RNBX' WHEN 3 THEN 'EQZX' WHEN 4 THEN 'LIJX' WHEN 5 THEN 'ARNDCQEGBZJXIL*' WHEN 6 THEN '-' WHEN 7 THEN '*X' WHEN 8 THEN 'AX' WHEN 9 THEN 'EZX' ELSE 'IJX' END"


@query("r5_amino_scores", f"SELECT ord, CAST(list_sum(list_transform(range(1, 11), lambda i: CASE WHEN strpos({AMINO_SQL}, substr(p, i, 1)) > 0 THEN 1 ELSE 0 END)) AS INT) AS score FROM (SELECT ord, substr(translate(md5('a' || ord), '0123456789abcdef', 'ARNDCQEGBZJXIL*-'), 1, 10) AS p FROM reads)")
def r5(spark, d):
    residues = F.substring(F.translate(F.md5(F.concat(F.lit("a"), F.col("ord").cast("string"))), "0123456789abcdef", "ARNDCQEGBZJXIL*-"), 1, 10)
    return plain_reads(spark, d).select("ord", S.matches(residues, "RBZJX-*AEI", S.amino_pairs()).alias("score"))
