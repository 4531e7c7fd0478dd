"""Known results of single operators."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from readmill import result
from readmill.functions import annotation as A
from readmill.functions import headers as H
from readmill.functions import sequence as S
from readmill.operators import alignment, assembly, clustering, collapse, errors
from readmill.operators import consensus as C
from readmill.operators import primers as P
from readmill.operators import reference, split, unify, user_functions
from readmill.schema import READS


def make(spark, seqs, quals=None, anns=None):
    rows = [("t", i, f"R{i}", f"R{i}", anns[i] if anns else [], s, quals[i] if quals else None) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, READS)


def q(scores):
    return "".join(chr(x + 33) for x in scores)


# Reads, primers and results here and below that operators must match.
SET = ["CGGCGTAA", "CCNNGTAA", "CGGC--TA", "CGNN--TA", "CGGC--AA"]
SET_QUAL = [q([30, 40, 20, 20, 20, 20, 40, 40])] * 5


@pytest.fixture(scope="module")
def five(spark):
    return make(spark, SET, SET_QUAL).withColumn("set_id", F.lit("A"))


def text(places, quality=True):
    return C.assembled(places, quality).first()["seq"]


@pytest.mark.parametrize("least,freq,want", [(0, 0.6, "CGGCGTAA"), (20, 0.6, "CGGCNNAA"), (20, 0.8, "CGGCNNNA")])
def test_quality_consensus(five, least, freq, want):
    assert text(C.quality_consensus(five, least, freq)) == want


@pytest.mark.parametrize("freq,want", [(0.2, "CGGCGTAA"), (0.8, "CGGCGTNA")])
def test_frequency_consensus(five, freq, want):
    assert text(C.frequency_consensus(five, freq), False) == want


def test_set_error_and_gaps(five):
    assert C.set_error(five, C.frequency_consensus(five)).first()["error"] == pytest.approx(1 - 27 / 36)
    assert C.set_error(five, C.quality_consensus(five, 20)).first()["error"] == pytest.approx(1 - 23 / 30)
    assert sorted(r["pos"] for r in C.gap_positions(five, 0.4).collect()) == [4, 5]
    assert C.gap_positions(five, 0.8).count() == 0
    places = C.quality_consensus(five).join(C.gap_positions(five, 0.4), ["set_id", "pos"], "left_anti")
    assert text(places) == "CGGCAA"


@pytest.mark.parametrize("most", [10_000, 2])
def test_consensus_of_arrays_is_that_of_sums(spark, monkeypatch, most):
    """Sets of many sizes and lengths, odd letters, missing qualities: counted in arrays, or (crowded ones) as sums by place and letter."""
    monkeypatch.setattr(C, "MOST_READS", most)
    monkeypatch.setattr(C.profiles, "LETTERS", 200)
    rng = np.random.default_rng(9)
    seqs, quals, sets = [], [], []
    for k in range(300):
        n = int(rng.integers(0, 12)) if k % 3 else 9
        seqs.append("".join(rng.choice(list("ACGTNacgt-.RX"), n)))
        quals.append(q(rng.integers(0, 42, n)) if k % 7 else None)
        sets.append(f"S{min(k % 40, int(rng.integers(0, 40)))}")
    rows = [("t", i, f"R{i}", f"R{i}", [], s, x, b) for i, (s, x, b) in enumerate(zip(seqs, quals, sets, strict=True))]
    reads = spark.createDataFrame(rows, READS + ", set_id string").repartition(3)
    for dependent in (False, True):
        want = {r["set_id"]: (r["seq"], r["qual"]) for r in C.assembled(C._quality_places(reads, 5, 0.5, dependent)).collect()}
        assert {r["set_id"]: (r["seq"], r["qual"]) for r in C.quality_sets(reads, 5, 0.5, dependent).collect()} == want
    want = {r["set_id"]: r["seq"] for r in C.assembled(C._frequency_places(reads, 0.5), False).collect()}
    assert {r["set_id"]: r["seq"] for r in C.frequency_sets(reads, 0.5).collect()} == want
    assert C.quality_sets(reads.limit(0)).count() == C.frequency_sets(reads.where("seq = ''")).count() == 0


PRIMED = ["CCACGTTTTAGTAATTAATA", "CCNCGTTTTAGTAATTAATA", "GGGCGTTTTAGTAATTAATA", "GGNNGTTTTACTAATTAATA", "NNGCNNNNNACTAATTAATA", "GGGATANNNACTAATTAATA", "N" * 20]
PRIMERS = {"PR1": "CACGTTTT", "PR2": "GGCGTTTT", "PR3": "GGANATAA"}


def test_score_primers(spark):
    got = P.score_primers(make(spark, PRIMED), PRIMERS, start=1, most_error=1.0).orderBy("ord").collect()
    assert [(r["primer"], r["error"]) for r in got] == [("PR1", 0), ("PR1", 1 / 8), ("PR2", 0), ("PR2", 2 / 8), ("PR2", 6 / 8), ("PR3", 3 / 8), (None, 1.0)]


def test_align_primers(spark):
    got = P.align_primers(make(spark, PRIMED), PRIMERS, skip_rc=True).orderBy("ord").collect()
    assert [(r["primer"], r["error"]) for r in got] == [("PR1", 0), ("PR1", 1 / 8), ("PR2", 0), ("PR2", 2 / 8), ("PR3", 3 / 8), ("PR3", 3 / 8), (None, 1.0)]


def test_align_reverse_complement(spark):
    read = "TTTTTTAAAACGTGTTTTTTTT"  # holds CACGTTTT turned round
    r = P.align_primers(make(spark, [read], [q(range(22))]), PRIMERS).first()
    assert (r["primer"], r["error"], r["orient"], r["valid"]) == ("PR1", 0.0, "RC", True)
    assert r["qual"] == q(range(22))[::-1]


def test_extract(spark):
    got = P.extract_region(make(spark, PRIMED), 4, 8).orderBy("ord").collect()
    assert [r["primer"] for r in got] == ["GTTTTAGT"] * 3 + ["GTTTTACT", "NNNNNACT", "TANNNACT", "NNNNNNNN"]


@pytest.mark.parametrize("mode,want", [("cut", "AGTAATTAATA"), ("mask", "NNNNNNAGTAATTAATA"), ("trim", "CGTTTTAGTAATTAATA"), ("tag", PRIMED[0])])
def test_mask(spark, mode, want):
    hit = make(spark, PRIMED[:1], ["I" * 20]).withColumns({"primer": F.lit("A"), "p_start": F.lit(3), "p_end": F.lit(9), "gaps": F.lit(0), "valid": F.lit(True)})
    out = P.mask(hit, mode, barcode=True)
    r = out.select("seq", "qual", A.flatten(F.lit("SEQ"), F.col("ann")).alias("h")).first()
    assert (r["seq"], len(r["qual"]), r["h"]) == (want, len(want), "SEQ|PRIMER=A|BARCODE=CCA")
    assert P.mask(hit, mode, barcode=True, barcode_length=2).select(A.get(F.col("ann"), "BARCODE")).first()[0] == "CA"


def test_letter_matches():
    pairs = [("A", "A"), ("A", "C"), ("R", "A"), ("A", "N"), ("N", "A"), ("-", "-"), ("-", "A"), ("A", ".")]
    plain, ones = S.letter_pairs(None, None, None), S.letter_pairs(True, True, True)
    assert [a in plain[b] for a, b in pairs] == [True, False, True, True, True, True, False, False]
    assert [a in ones[b] for a, b in pairs] == [True, False, True, True, True, True, True, True]
    assert [a in S.PRIMER_MATCH[b] for a, b in pairs] == [True, False, True, True, False, False, False, False]


def test_mean_quality(spark):
    got = make(spark, ["AAA"] * 4, [q([20, 20, 21]), q([40, 10, 9]), q([2, 2, 2]), ""]).select(S.mean_quality(F.col("qual")).alias("m")).collect()
    assert [r["m"] for r in got] == [20, 19, 2, 0]


CODES = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "N": "ACGT"}


def agree(a, b):
    return len(a) == len(b) and all(x == "N" or y == "N" or set(CODES[x]) & set(CODES[y]) for x, y in zip(a, b, strict=True))


def test_ambiguous_letters(spark):
    pairs = [("TANTA", "TAGTA", True), ("TANTA", "TACTA", True), ("TAGTA", "TACTA", False), ("TARTA", "TAGTA", True), ("TARTA", "TAYTA", False), ("TA-TA", "TAGTA", True)]
    got = spark.createDataFrame(pairs, "a string, b string, want boolean").withColumn("got", collapse.letters_agree(F.col("a"), F.col("b"))).collect()
    assert all(r["got"] == r["want"] for r in got)


@pytest.mark.parametrize("letters,p,n", [("ACGN", [0.35, 0.3, 0.2, 0.15], 5), ("ACRYN", [0.4, 0.4, 0.05, 0.05, 0.1], 7), ("AN", [0.7, 0.3], 13)])
def test_ambiguous_collapse_against_a_loop(spark, letters, p, n):
    rng = np.random.default_rng(3)
    seqs = ["".join(rng.choice(list(letters), n - i % 2, p=p)) for i in range(120)]
    heads, count = [], {}
    for k in range(3):
        for s in dict.fromkeys(s for s in seqs if s.count("N") == k):
            h = s if k == 0 else next((h for h in heads if agree(s, h)), s)
            if h == s:
                heads.append(s)
            count[h] = count.get(h, 0) + seqs.count(s)
    got = collapse.ambiguous_reads(make(spark, seqs), 2).collect()
    assert {r["seq"]: r["dupcount"] for r in got} == count


def test_ambiguous_collapse_of_very_unclear_reads(spark, monkeypatch):
    """Reads with more unclear letters than parts can tell apart are compared without parts; the outcome is the same."""
    monkeypatch.setattr(collapse, "MOST_HIDDEN", 1)
    test_ambiguous_collapse_against_a_loop(spark, "ACRYN", [0.4, 0.4, 0.05, 0.05, 0.1], 7)
    monkeypatch.setattr(collapse, "MOST_HIDDEN", 0)
    test_ambiguous_collapse_against_a_loop(spark, "ACGN", [0.35, 0.3, 0.2, 0.15], 5)


def test_no_key_of_ambiguous_collapse_holds_a_length(spark):
    """Reads that hide letters anywhere, so that together they hide every part of six: no key has more than a few of the pairs."""
    rng = np.random.default_rng(11)
    seqs = []
    for k in range(4000):
        s = rng.choice(list("ACGT"), 60)
        if k % 2:
            s[rng.choice(60, 3, replace=False)] = "N"
        seqs.append("".join(s))
    rows = [(s, [], 60, s.count("N"), k) for k, s in enumerate(seqs)]
    keys, parts = collapse._indexed(spark.createDataFrame(rows, "_key string, _uniq array<string>, _n int, _missing int, _ord bigint"))
    unclear, clear = keys.where("_missing > 0"), keys.where("_missing = 0")
    for left, right, complete in ((unclear, clear, True), (unclear, unclear, False)):
        met = collapse._candidates(left, right, parts, complete)
        assert met.count() < 200
        assert all(r["count"] < 10 for r in met.groupBy("_n", "uniq", "at", "shown").count().collect())


def field(k, v):
    return [(k, v)]


def test_unify(spark):
    rows = [("AAAA", s) for s in ("S1", "S1", "S2", "S3")] + [("CCCC", "S1"), ("CCCC", "S2"), ("GGGG", "S2"), ("GGGG", "S2"), ("TTTT", "S3")]
    reads = make(spark, ["A"] * 9, anns=[[("BARCODE", b), ("SAMPLE", s)] for b, s in rows])
    got = unify.consensus(reads).orderBy("ord").select(A.get(F.col("ann"), "SAMPLE")).collect()
    assert [r[0] for r in got] == ["S1"] * 6 + ["S2", "S2", "S3"]
    assert sorted(r["ord"] for r in unify.deletion(reads).collect()) == [6, 7, 8]


@pytest.mark.parametrize("change,want", [
    (lambda a: A.merge(a, A.pairs({"TEST1": F.lit("C,C"), "TEST2": F.lit("3")})), "SEQ1|TEST1=A,B,C,C|TEST2=1,2,3"),
    (lambda a: A.merge(a, A.pairs({"TEST1": F.lit("C,C"), "TEST2": F.lit("3")}), prepend=True), "SEQ1|TEST1=C,C,A,B|TEST2=3,1,2"),
    (lambda a: A.rename(a, ["TEST2"], ["TEST1"]), "SEQ1|TEST1=A,B,1,2"),
    (lambda a: A.rename(a, ["TEST2"], ["NEW"]), "SEQ1|TEST1=A,B|NEW=1,2"),
    (lambda a: A.collapse(a, "sum", ["TEST2"]), "SEQ1|TEST1=A,B|TEST2=3"),
    (lambda a: A.expand(a, ["TEST1"]), "SEQ1|TEST2=1,2|TEST11=A|TEST12=B"),
])
def test_annotation_algebra(spark, change, want):
    row = spark.createDataFrame([("SEQ1|TEST1=A,B|TEST2=1,2",)], "h string")
    assert row.select(A.flatten(A.read_id(F.col("h")), change(A.parse(F.col("h"))))).first()[0] == want


def test_parse_flatten_and_numbers(spark):
    heads = ["A", "A|B=1", "x y|b=1|B=2|C=3"]
    got = spark.createDataFrame([(h,) for h in heads], "h string").select(A.flatten(A.read_id(F.col("h")), A.parse(F.col("h")))).collect()
    assert [r[0] for r in got] == ["A", "A|B=1", "x y|B=2|C=3"]
    numbers = spark.createDataFrame([(3.0,), (0.5,), (0.0005,), (12.25,), (-2.0,)], "x double").select(A.number_text(F.col("x"))).collect()
    assert [r[0] for r in numbers] == ["3", "0.5", "0.0005", "12.25", "-2"]
    with pytest.raises(Exception, match="no value"):
        spark.createDataFrame([("A|B",)], "h string").select(A.parse(F.col("h"))).collect()


@pytest.mark.parametrize("kind,header,want", [
    ("sra", "SRR001666.1 071112 length=36", "SRR001666.1"), ("sra", "SRR1383326.1.1 1 length=250", "SRR1383326.1"),
    ("454", "GXGJ56Z01AE06X length=222", "GXGJ56Z01AE06X"), ("illumina", "M:132:1:2 2:N:0:A", "M:132:1:2"), ("illumina", "H:5:58#ATC/1", "H:5:58"),
    ("annotated", "A b|C=1", "A b"),
])
def test_coordinates(spark, kind, header, want):
    assert spark.createDataFrame([(header,)], "h string").select(A.coordinate(F.col("h"), kind)).first()[0] == want


def test_headers_that_do_not_fit(spark):
    row = spark.createDataFrame([("nothing",)], "h string")
    assert all(row.select(f(F.col("h")).isNull()).first()[0] for f in (H.roche454, H.illumina, H.imgt, H.sra, H.migec))


def test_clusters():
    a = "ACGTTGCAAGCTTAGCCATGCATCGATTACGCTAGCATCGATCGGGATCTTAGCATCA"
    b = "TTTTGGGGCCCCAAAATTTTGGGGCCCCAAAATTTTGGGGCCCCAAAATTTTGGGGCC"
    got = clustering.greedy([a, a[:30] + "T" + a[31:], b, b[:5] + "A" + b[6:], a], clustering.Rule(0.9))
    assert got[0] == got[1] == got[4] and got[2] == got[3] and got[0] != got[2]


@pytest.mark.parametrize("most", [100, 3])
def test_multiple_alignment_keeps_reads_and_columns(spark, monkeypatch, most):
    """Every read keeps its letters, a set's reads have one width, and up to MOST_SET distinct reads are aligned as by one task."""
    monkeypatch.setattr(alignment, "MOST_SET", most)
    rng = np.random.default_rng(5)
    seqs, anns = [], []
    for k in range(60):
        base = "ACGTTGCAGGTACCATG"[k % 3 :]
        i = int(rng.integers(0, len(base)))
        seqs.append([base, base[:i] + base[i + 1 :], base[:i] + "TT" + base[i:], base[: i + 5]][int(rng.integers(0, 4))])
        anns.append([("BARCODE", f"B{k % 4}")])
    reads = C.with_set(make(spark, seqs, ["I" * len(s) for s in seqs], anns))
    got = {r["ord"]: (r["seq"], r["qual"]) for r in alignment.multiple_align(reads).collect()}
    for b in range(4):
        own = [i for i in range(60) if i % 4 == b]
        assert len({len(got[i][0]) for i in own}) == 1 and [got[i][0].replace("-", "") for i in own] == [seqs[i] for i in own]
        distinct = sorted(dict.fromkeys(seqs[i] for i in own), key=lambda s: (-sum(seqs[i] == s for i in own), -len(s), next(i for i in own if seqs[i] == s)))
        if most >= len(distinct):
            want = dict(zip(distinct, alignment.progressive_align(distinct), strict=True))
            assert all(got[i] == (want[seqs[i]], "".join("!" if c == "-" else "I" for c in want[seqs[i]])) for i in own)
    other = alignment.multiple_align(reads, lambda texts: [t.ljust(30, "-") for t in texts])
    assert {len(r["seq"]) for r in other.collect()} == {30}


@pytest.mark.parametrize("want", [
    ["ACGTTGAA----GGTACC", "ACGTTGAACTTCGGTACC", "ACGTTGAA--TCGGTACC"],  # two inserts of unlike lengths: each alone against the first would begin in one column
    ["ACGGTACCTTGA------", "ACGGTACCTTGACATGCC", "-----ACCTTGACATGCC"],  # reads that end or begin earlier
    ["ACGAACTGGATCAC", "ACGAACTGGATCAC", "ACGAA--GGATCAC", "ACGAA--GGATCAT"],  # a gap that two share
    ["ACGT", "ACGT"], ["AC", "AC"], ["ACGTACGT"], ["ACGNACGT", "ACG-ACGT"],
])
def test_progressive_alignment(want):
    got = alignment.progressive_align([w.replace("-", "") for w in want])
    assert got == want


def test_progressive_alignment_against_pairs():
    """Of two sequences the alignment has the best score by plain tables, ends at half."""
    rng = np.random.default_rng(12)

    def plain(a, b, gap=2.0):
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if i or j:
                    steps = [h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1)] if i and j else []
                    steps += [h[i - 1, j] - gap * (0.5 if j in (0, len(b)) else 1)] if i else []
                    steps += [h[i, j - 1] - gap * (0.5 if i in (0, len(a)) else 1)] if j else []
                    h[i, j] = max(steps)
        return h[-1, -1]

    for _ in range(40):
        a, b = ("".join(rng.choice(list("ACG"), int(rng.integers(1, 12)))) for _ in range(2))
        x, y = alignment._merged([a], [b], 2.0)
        core = [k for k, (p, r) in enumerate(zip(x, y, strict=True)) if p != "-" and r != "-"]
        ends = lambda k, core=core: not core or k < core[0] or k > core[-1]
        score = sum((1 if p == r else -1) if "-" not in (p, r) else -2 * (0.5 if ends(k) else 1) for k, (p, r) in enumerate(zip(x, y, strict=True)))
        assert score == pytest.approx(plain(a, b))


def plain_identity(a, b):
    if len(a) == len(b) and (same := sum(x == y for x, y in zip(a, b, strict=True)) / len(a)) > 0.8:
        return same
    x, y = alignment.global_align(a, b)
    columns = list(zip(x, y, strict=True))
    for turn in (1, -1):
        columns = columns[::turn]
        first = columns[0].index("-") if "-" in columns[0] else None
        while first is not None and columns and columns[0][first] == "-":
            columns = columns[1:]
        columns = columns[::turn]
        if not columns:
            return 0.0
    return sum(p == q for p, q in columns) / len(columns)


def test_identities_against_single_alignments():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ACG"), int(n))) for n in rng.integers(1, 14, 60)]
    texts += [t[2:] + "A" for t in texts if len(t) > 4]
    for t in texts[::5]:
        assert clustering.identities([t] * len(texts), texts, clustering.Rule()).tolist() == pytest.approx([plain_identity(t, x) for x in texts])


def plain_greedy(texts, rule):
    """One pass, each text against all centroids before it."""

    def near(seq, head):
        words, others = ({x[k : k + rule.word] for k in range(max(1, len(x) - rule.word + 1))} for x in (seq, head))
        if len(words & others) < min(rule.shared, len(words)) or len(seq) < rule.length_ratio * len(head):
            return False
        if not rule.aligned:
            return len(seq) == len(head) and sum(map(str.__eq__, seq, head)) / len(seq) >= rule.ident
        if rule.shorter and (len(seq) != len(head) or sum(map(str.__eq__, seq, head)) / len(seq) <= 0.8):
            x, y = alignment.global_align(seq, head)
            return sum(p == q for p, q in zip(x, y, strict=True)) / len(seq) >= rule.ident
        return plain_identity(seq, head) >= rule.ident

    heads, out = [], {}
    for seq in sorted(set(texts), key=lambda s: (-len(s), s)):
        out[seq] = next((h for h in heads if near(seq, h)), None)
        if out[seq] is None:
            heads.append(seq)
            out[seq] = seq
    return out


def families(n, seed=7, groups=12, size=8):
    rng = np.random.default_rng(seed)
    seqs = []
    for _ in range(groups):
        base = rng.choice(list("ACGT"), n)
        for k in range(size):
            x = base.copy()
            x[rng.integers(0, n, max(1, n // 12))] = rng.choice(list("ACGT"))
            seqs.append("".join(x)[: n - k // 6])
    return seqs


@pytest.mark.parametrize("batch,batches", [(1000, 3), (5, 2), (30, 1), (1, 0)])
@pytest.mark.parametrize("n,rule", [
    (8, dict(ident=0.85, word=3, shared=1)), (8, dict(ident=0.85, word=3, shared=1, aligned=False)), (40, dict(ident=0.9, word=5, shared=4)),
    (20, dict(ident=0.8, word=3, shared=1, length_ratio=0.96)), (24, dict(ident=0.85, word=4, shared=2, shorter=True)),
])
def test_clusters_are_those_of_one_pass_whatever_the_rounds(spark, monkeypatch, n, rule, batch, batches):
    monkeypatch.setattr(clustering, "BATCH", batch)
    monkeypatch.setattr(clustering, "BATCHES", batches)
    seqs, rule = families(n), clustering.Rule(**rule)
    want = plain_greedy(seqs, rule)
    assert dict(zip(seqs, clustering.greedy(seqs, rule), strict=True)) == want and 1 < len(set(want.values())) < len(want)
    least = {h: min(s for s, x in want.items() if x == h) for h in want.values()}
    got = clustering.cluster_distinct(spark.createDataFrame([(s,) for s in [*seqs, ""]], "v string"), "v", rule).collect()
    assert {r["v"]: r["cluster"] for r in got} == {s: least[h] for s, h in want.items()}


@pytest.mark.parametrize("batch", [1000, 7])
def test_clusters_of_sets_have_one_order_and_numbering(spark, monkeypatch, batch):
    monkeypatch.setattr(clustering, "BATCH", batch)
    monkeypatch.setattr(clustering, "BATCHES", 1)
    seqs, rule = families(30, groups=9), clustering.Rule(0.9, word=5, shared=3)
    names = [f"B{k % 3 if k % 5 else 0}" for k in range(len(seqs))]
    got = clustering.cluster_sets(make(spark, seqs, anns=[[("BARCODE", b)] for b in names]), word=5, shared=3).collect()
    assert len(got) == len(seqs)
    for b in set(names):
        own = [s for s, x in zip(seqs, names, strict=True) if x == b]
        heads = plain_greedy(own, rule)
        number = {h: k for k, h in enumerate(dict.fromkeys(heads.values()), 1)}
        assert {r["seq"]: r["cluster"] for r in got if r["set_id"] == b} == {s: number[h] for s, h in heads.items()}


def test_near_pairs_have_no_rows_for_words_met_by_chance(spark, monkeypatch):
    """Words in common are counted within tasks, also over several blocks; the pairs are those of plain comparisons."""
    monkeypatch.setattr(clustering, "LETTERS", 800)
    seqs, rule = clustering.in_order(set(families(40))), clustering.Rule(0.9, word=5, shared=4)
    left = spark.createDataFrame([(k, "", s) for k, s in enumerate(seqs)], "id long, set_id string, v string")
    pairs = clustering.near_pairs(left, rule)
    assert "array_distinct" not in pairs._jdf.queryExecution().toString()
    want = set()
    for k, s in enumerate(seqs):
        enough = [j for j in range(k) if len(rule.words(s) & rule.words(seqs[j])) >= min(4, len(rule.words(s)))]
        want |= {(k, j) for j in enough if plain_identity(s, seqs[j]) >= 0.9}
    assert {(r["id"], r["earlier"]) for r in pairs.collect()} == want and len(want) > 100


def test_many_barcodes_cluster_in_time():
    """Thousands of barcodes, in seconds: pairs are compared together, not a barcode at a time."""
    rng = np.random.default_rng(8)
    seqs = clustering.in_order({"".join(x) for x in rng.choice(list("ACGT"), (4000, 8))})
    rule, start = dict(ident=0.85, word=3, shared=1), time.perf_counter()
    heads, by_place = (clustering.greedy(seqs, clustering.Rule(**rule, aligned=aligned)) for aligned in (True, False))
    assert time.perf_counter() - start < 10
    letters = np.array([list(s.encode()) for s in seqs], np.uint8)
    own = [k for k, h in enumerate(by_place) if h == seqs[k]]
    far = (letters[:, None] != letters[own][None]).sum(axis=2)
    assert by_place == [seqs[own[k]] for k in (far <= 1).argmax(axis=1)] and len(own) > 1000
    assert all(plain_identity(s, h) >= 0.85 for s, h in list(zip(seqs, heads, strict=True))[::50])


def test_cluster_sets_leave_out_empty(spark):
    anns = [[("BARCODE", b)] for b in "XXY"]
    got = clustering.cluster_sets(make(spark, ["ACGTACGT", "ACG", "ACGTACGT"], anns=anns), start=4).collect()
    assert [r["set_id"] for r in got] == ["Y"]


def test_assembly_finds_the_overlap():
    rng = np.random.default_rng(1)
    seq = "".join(rng.choice(list("ACGT"), 90))
    got = assembly.assemble_pair(seq[:55], q([30] * 55), seq[40:], q([30] * 50), 1e-5, 0.3, 8, 1000, False)
    assert (got[0], got[2], got[3], got[6]) == (seq, 15, 0.0, True)
    inside = assembly.assemble_pair(seq, None, seq[20:60], None, 1e-5, 0.3, 8, 1000, False)
    assert (inside[0], inside[2], inside[6]) == (seq, 40, True)
    assert not assembly.assemble_pair("ACGT", None, "ACGT", None, 1e-5, 0.3, 8, 1000, False)[6]


@pytest.mark.parametrize("scan_reverse", [False, True])
def test_assembly_of_batches_is_that_of_pairs(scan_reverse):
    """Mates of many lengths, with unclear letters, without qualities, inside each other, and too short."""
    rng = np.random.default_rng(14)
    rows = []
    for k in range(300):
        seq = "".join(rng.choice(list("ACGTN-R"), int(rng.integers(4, 50)), p=[0.22, 0.22, 0.22, 0.22, 0.06, 0.03, 0.03]))
        a, b = sorted(rng.integers(0, len(seq) + 1, 2).tolist())
        h, t = (seq[:b], seq[a:]) if k % 3 else (seq[a:], seq[:b])
        t = t if k % 5 else "".join(rng.permutation(list(t)))
        rows.append((h, q(rng.integers(0, 42, len(h))) if k % 7 else None, t, q(rng.integers(0, 42, len(t))) if k % 11 else None))
    for alpha, least, most in ((1e-3, 8, 1000), (0.5, 3, 12)):
        got = assembly.assemble_batch(*map(list, zip(*rows, strict=True)), alpha, 0.3, least, most, scan_reverse)
        assert got == [assembly.assemble_pair(*r, alpha, 0.3, least, most, scan_reverse) for r in rows]
    assert sum(r[6] for r in got) > 30


def test_overlap_qualities():
    assert assembly.merged("ACN-", q([30, 20, 5, 6]), "AGT.", q([20, 30, 10, 9])) == ("AGTN", q([30, 18, 10, 9]))


def test_functions_of_ones_own(spark, five):
    """For reads, for pairs, and for sets' consensus; one for alignments is in test_multiple_alignment_keeps_reads_and_columns."""

    def short(batch):
        return batch.assign(seq=batch["seq"].str[:3], qual=None, valid=batch["seq"].str.len() > 4, size=batch["seq"].str.len())

    reads = make(spark, ["ACGTACGT", "ACG", "TTTTT"], anns=[[("A", "1")], [], [("A", "2")]])
    out = user_functions.per_read(reads, short, "valid boolean, size int")
    assert sorted((r["ord"], r["seq"], r["valid"], r["size"]) for r in out.collect()) == [(0, "ACG", True, 8), (1, "ACG", False, 3), (2, "TTT", True, 5)]
    assert sorted(r["ord"] for r in result.failed(out, reads).collect()) == [1] and out.where("ord = 2").first()["ann"][0]["v"] == "2"
    with pytest.raises(Exception, match="lack size"):
        user_functions.per_read(reads, lambda b: b.assign(valid=True), "valid boolean, size int").collect()
    mates = spark.createDataFrame([("a", "ACGT", "IIII", "GGTT", "5555"), ("b", "AC", None, "GG", None)], "coord string, h_seq string, h_qual string, t_seq string, t_qual string")
    got = user_functions.per_pair(mates, lambda b: b.assign(seq=b["h_seq"] + "-" + b["t_seq"], qual=None, valid=b["h_qual"].notna())).collect()
    assert sorted((r["coord"], r["seq"], r["valid"]) for r in got) == [("a", "ACGT-GGTT", True), ("b", "AC-GG", False)]
    own = C.build(five.drop("set_id").withColumn("ann", A.pairs({"BARCODE": F.lit("B")})), places_of=lambda sets: sets.groupBy("set_id").agg(F.lit(0).alias("pos"), F.lit("T").alias("ch"), F.lit(7).alias("q")))
    assert [(r["seq"], r["qual"], r["conscount"]) for r in own.collect()] == [("T", "(", 5)]


def test_mid_p():
    p = assembly.mid_p_values(4)
    assert p[4] == pytest.approx(0.25**4 / 2) and p[0] == pytest.approx(1 - 0.75**4 / 2)


def plain_local(read, ref, match=1.0, mismatch=-2.0, gap=2.5):
    """Score of the best local alignment, and the place of the reference's letter for each letter of the read in one such."""
    h = np.zeros((len(read) + 1, len(ref) + 1))
    for i in range(1, len(read) + 1):
        for j in range(1, len(ref) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (match if read[i - 1] == ref[j - 1] != "N" else mismatch), h[i - 1, j] - gap, h[i, j - 1] - gap)
    return h.max()


def mutated(rng, text, changes):
    out = list(text)
    for _ in range(changes):
        at, kind = int(rng.integers(5, len(out) - 5)), rng.integers(0, 3)
        out[at : at + (kind < 2)] = ["", rng.choice(list("ACGT")), rng.choice(list("ACGT"))][kind]
    return "".join(out)


def test_gapped_extension_against_plain_tables():
    rng = np.random.default_rng(3)
    refs = ["".join(rng.choice(list("ACGT"), int(n))) for n in rng.integers(60, 200, 60)]
    reads, shifts = [], []
    for k, ref in enumerate(refs):
        at = int(rng.integers(0, len(ref) - 50))
        reads.append("GATTACA" * (k % 5 == 0) + mutated(rng, ref[at : at + 50], k % 5) + "N" * (k % 3))
        shifts.append(at - 7 * (k % 5 == 0))
    score, q_start, q_end, t_start, t_end = reference.extended(reads, refs, np.array(shifts))
    assert score.tolist() == [plain_local(r, t) for r, t in zip(reads, refs, strict=True)]
    for k, (read, ref) in enumerate(zip(reads, refs, strict=True)):  # what lies between the ends has that score by itself, ends matching
        own, other = read[q_start[k] : q_end[k]], ref[t_start[k] : t_end[k]]
        assert plain_local(own, other) == score[k] and own[0] == other[0] and own[-1] == other[-1]


def test_reference_assembly(spark):
    rng = np.random.default_rng(2)
    refs = {f"r{k}": "".join(rng.choice(list("ACGT"), 200)) for k in range(4)}
    refs["twin"] = refs["r0"][:100] + "".join(rng.choice(list("ACGT"), 100))  # as good for the head, but not for the tail
    a = refs["r0"]
    gone, more = a[10:40] + a[41:71], a[80:100] + "G" + a[100:140]
    rows = [
        ("apart", a[10:60], a[80:140]), ("overlap", a[10:70], a[50:110]), ("gapped", gone, more), ("none", "".join(rng.choice(list("ACGT"), 60)), a[80:140]),
        ("other", refs["r1"][:50], refs["r2"][60:110]), ("turned", a[120:170], a[20:70]), ("short", "ACG", a[:50]), ("lower", a[10:60], a[80:140]), ("empty", "", ""),
    ]
    mates = spark.createDataFrame([(n, h, "I" * len(h), t, "5" * len(t)) for n, h, t in rows], "coord string, h_seq string, h_qual string, t_seq string, t_qual string")
    known = spark.createDataFrame([(n, s.lower() if n == "r3" else s[:90] + "." + s[90:]) for n, s in refs.items()], "name string, seq string")
    got = {r["coord"]: r for r in assembly.reference(mates, known).collect()}
    assert len(got) == len(rows)
    assert got["apart"]["seq"] == a[10:60] + "N" * 20 + a[80:140] and got["apart"]["valid"] and got["apart"]["ref"] == "r0"
    assert got["overlap"]["seq"] == a[10:110] and got["overlap"]["overlap"] == 20 and got["overlap"]["error"] == 0
    assert got["turned"]["seq"] == a[20:70] + "N" * 50 + a[120:170] and got["turned"]["overlap"] == -50
    assert got["gapped"]["ref"] == "r0" and got["gapped"]["valid"] and got["gapped"]["evalue_1"] < 1e-5  # each mate has a gap, and is placed by its first letters
    assert got["gapped"]["seq"] == gone + "N" * (80 - 70) + more
    assert [got[n]["valid"] for n in ("none", "other", "short", "empty")] == [False] * 4
    filled = {r["coord"]: r["seq"] for r in assembly.reference(mates, known, fill=True).collect()}
    assert filled["apart"] == a[10:140] and filled["turned"] == a[20:170]
    again = {r["coord"]: r for r in assembly.sequential(mates, known, alpha=1e-9).collect()}
    assert again["overlap"]["ref"] is None and again["overlap"]["valid"] and again["apart"]["ref"] == "r0" and len(again) == len(rows)


def test_hits_of_repeated_words_are_ranked(spark):
    rng = np.random.default_rng(6)
    base = "".join(rng.choice(list("ACGT"), 120))
    refs = [(f"n{k}", mutated(rng, base, k)) for k in range(8)]
    queries = [(k, mutated(rng, base[20:90], k % 4)) for k in range(12)]
    got = reference.hits(spark.createDataFrame(queries, "query bigint, seq string"), spark.createDataFrame(refs, "name string, seq string"), 1e-5, 3).collect()
    for k, text in queries:
        own = sorted((r["rank"], r["score"], r["name"]) for r in got if r["query"] == k)
        scores = {n: plain_local(text, s) for n, s in refs}
        assert [s for _, s, _ in own] == sorted((scores[n] for _, _, n in own), reverse=True) and all(scores[n] == s for _, s, n in own) and len(own) == 3


def test_restored_quality_and_offsets():
    assert alignment.restored_quality("A-CG", "IJK") == "I!JK"
    primers = {"a": "ACGTTGCAGG", "b": "GTTGCAGG", "c": "TTACGTTGCAGG"}
    assert alignment.offset_table(primers) == [("a", 2), ("b", 4), ("c", 0)]
    assert alignment.offset_table({"a": "GGACGTTGCA", "b": "GGACGTTG"}, reverse=True) == [("a", 2), ("b", 0)]


def test_barcode_distances(spark):
    reads = make(spark, ["A"] * 5, anns=[[("BARCODE", b)] for b in ("AAAA", "AAAA", "AAAC", "CCCC", "AA")])
    got = {r["distance"]: r["n"] for r in errors.barcode_distances(reads).collect()}
    assert got == {0: 1, 1: 2, 3: 1, 4: 2}


def test_sorted_parts_keep_ties(spark):
    anns = [[("N", str(v))] for v in (3, 1, 1, 2, 2, 2, 10)]
    parts = split.sorted_parts(make(spark, ["A"] * 7, anns=anns), "N", 4, numeric=True).select("ord", "part").collect()
    by = {r["ord"]: r["part"] for r in parts}
    assert [by[i] for i in (1, 2, 3, 4, 5, 0, 6)] == [1, 1, 2, 2, 2, 2, 3]


def test_reverse_complement_twice(spark):
    seqs = ["ACGTRYKMBVDHN-.", "", "acgtn"]
    back = make(spark, seqs).select(S.reverse_complement(S.reverse_complement(F.col("seq"))).alias("s")).collect()
    assert [r["s"] for r in back] == seqs


def test_empty_sequences(spark):
    r = make(spark, ["", "NN"], ["", "!!"]).select(S.longest_run(F.translate("seq", "-.nN", "")).alias("a"), S.mean_quality(F.col("qual")).alias("b"), S.phred(F.col("qual")).alias("c")).collect()
    assert [tuple(x) for x in r] == [(0, 0, []), (0, 0, [0, 0])]




def shared_words(spark):
    rng = np.random.default_rng(21)
    refs = [("".join(rng.choice(list("ACGT"), 40)), f"r{k}") for k in range(60)]
    refs += [(t[:20] + "A" + t[21:], f"s{n}") for t, n in refs[:20]] + [("ACGTACGTACGTACGTAAAA", "u")]
    mates = [(f"c{k}", refs[int(rng.integers(0, 81))][0][: int(rng.integers(4, 30))] + "N", "".join(rng.choice(list("ACGT"), 8)) + refs[int(rng.integers(0, 81))][0][10:]) for k in range(120)]
    mates += [(f"d{k}", refs[k][0][:25], refs[k][0][12:]) for k in range(20)] + [("short", "AC", "ACGTACGTACGT")]
    return mates, refs, spark.createDataFrame(mates, "coord string, h_seq string, t_seq string"), spark.createDataFrame(refs, "seq string, name string")


def plain_seeds(text, refs, n=4):
    out = {}
    for seq, name in refs:
        shifts = [j - i for i in range(len(text) - n + 1) for j in range(len(seq) - n + 1) if text[i : i + n] == seq[j : j + n] and "N" not in text[i : i + n]]
        if shifts:
            out[name] = (len(shifts), min(set(shifts), key=lambda x: (-shifts.count(x), x)))
    return out


def test_common_references_by_blocks_and_deals(spark, monkeypatch):
    monkeypatch.setattr(reference, "BLOCK_LETTERS", 900)
    monkeypatch.setattr(reference, "DEAL_LETTERS", 2000)
    mates, refs, rows, known = shared_words(spark)
    want = {c: sorted(set(plain_seeds(h, refs)) & set(plain_seeds(t, refs))) for c, h, t in mates}
    got = {r["coord"]: (r["n"], r["first"]) for r in reference.common_references(rows, known, 4).collect()}
    assert got == {c: (len(x), x[0]) for c, x in want.items() if x}


@pytest.mark.parametrize("block", [900, 1 << 30])
def test_only_references_of_both_mates_are_extended(spark, monkeypatch, block):
    """Those that both have among their best, whatever the blocks; and the same common hit as by all hits of each."""
    monkeypatch.setattr(reference, "BLOCK_LETTERS", block)
    monkeypatch.setattr(reference, "DEAL_LETTERS", 2000)
    mates, refs, rows, known = shared_words(spark)
    most = lambda text: {n for n, _ in sorted(plain_seeds(text, refs).items(), key=lambda x: (-x[1][0], x[0]))[:5]}
    pairs = spark.createDataFrame([(k, h, t) for k, (_, h, t) in enumerate(mates)], "pair long, h_seq string, t_seq string")
    got = {(r["pair"], r["name"]) for r in reference.candidates(pairs, known, 5, 4).collect()}
    assert got == {(k, n) for k, (_, h, t) in enumerate(mates) for n in most(h) & most(t)} and len(got) > 20
    texts = sorted({x for m in mates for x in m[1:]})
    hits = reference.hits(spark.createDataFrame(list(enumerate(texts)), "query bigint, seq string"), known, 1e-2, 5).collect()
    best = {}
    for r in hits:
        best.setdefault(texts[r["query"]], {})[r["name"]] = (r["evalue"], r["name"])
    want = {(h, t): min(both) for _, h, t in mates if (both := [best[h][n] for n in best.get(h, {}) if n in best.get(t, {})])}
    found = {(r["h_seq"], r["t_seq"]): (r["h_evalue"], r["name"]) for r in reference.common_hits(rows, known, 1e-2, 5).collect()}
    assert found == want and len(want) > 10


def test_bound_of_extensions():
    """What is left out by words of four letters can't have the score."""
    rng = np.random.default_rng(4)
    targets = ["".join(rng.choice(list("ACGTN"), 60)) for _ in range(600)]
    reads = []
    for t in targets:
        x = list(t[10:45])
        for _ in range(int(rng.integers(0, 7))):
            i, kind = int(rng.integers(0, len(x))), int(rng.integers(0, 3))
            x[i : i + (kind != 1)] = rng.choice(list("ACGT"), int(kind != 2)).tolist()
        reads.append("".join(x))
    shifts = np.full(600, 10)
    score = reference.extended(reads, targets, shifts)[0]
    for least in (8.0, 14.5, 20.0):
        kept = reference.reachable(reads, targets, shifts, np.full(600, least))
        assert kept[score >= least].all()
    assert reference.reachable(reads, targets[::-1], shifts, np.full(600, 20.0)).mean() < 0.2
