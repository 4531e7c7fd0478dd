"""Sets of reads with a common annotation: majority values, consensus sequences, and gates on sets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readmill.functions import annotation as A
from readmill.functions import sequence as S
from readmill.operators import profiles
from readmill.schema import MISSING, chars, checkpointed

#: Letters that can stand in a read; their number bounds what a position aggregates to.
LETTERS = "ACGTURYSWKMBDHVN-."
#: Reads of a set that one task counts.
MOST_READS = 10_000


def with_set(reads: DataFrame, field: str = "BARCODE") -> DataFrame:
    """`set_id`, the field's value; reads without it are an error elsewhere and are left out here.

    The value comes out of a generator, so that the filter stays above it: below, where annotations are parsed, it would
    have them parsed again for the filter, and all that their header is made of with them.
    """
    value = F.inline(F.array(F.struct(A.get(F.col("ann"), field).alias("set_id"))))
    return reads.select("*", value).where(F.col("set_id").isNotNull())


def majority(sets: DataFrame, field: str) -> DataFrame:
    """set_id, n, values (sorted), counts, top (the first of ties), freq: a field's values in each set."""
    counted = sets.groupBy("set_id", A.get(F.col("ann"), field).alias("v")).agg(F.count("*").alias("c"))
    return counted.groupBy("set_id").agg(
        F.sum("c").alias("n"), F.array_sort(F.collect_list(F.struct("v", "c"))).alias("_all"), F.min(F.struct((-F.col("c")).alias("c"), "v")).alias("_top")
    ).select("set_id", "n", F.transform("_all", lambda x: x["v"]).alias("values"), F.transform("_all", lambda x: x["c"]).alias("counts"), F.col("_top.v").alias("top"), (-F.col("_top.c") / F.col("n")).alias("freq"))


def keep_majority(sets: DataFrame, field: str, least: float) -> DataFrame:
    """Of sets whose majority value reaches the frequency, the reads that have it, with `top` and `freq`; other sets go."""
    top = majority(sets, field).where(F.col("freq") >= least).select("set_id", "top", "freq")
    return sets.join(top, "set_id").where(A.get(F.col("ann"), field) == F.col("top"))


def positions(sets: DataFrame) -> DataFrame:
    """set_id, pos, ch, q, one row a letter; reads shorter than their set's longest are taken to end in gaps of quality 0."""
    each = F.arrays_zip(chars(F.col("seq")).alias("ch"), S.phred(F.coalesce("qual", F.lit(""))).alias("q"))
    return sets.select("set_id", "ord", F.posexplode(each).alias("pos", "x")).select("set_id", "ord", "pos", F.upper("x.ch").alias("ch"), F.coalesce("x.q", F.lit(0)).alias("q"))


def letter_sums(sets: DataFrame) -> DataFrame:
    """set_id, pos, ch, n, sum_q, max_q: combined before the shuffle, so a large set is a few rows from each task."""
    return positions(sets).groupBy("set_id", "pos", "ch").agg(F.count("*").alias("n"), F.sum("q").alias("sum_q"), F.max("q").alias("max_q"))


def _sizes(sets: DataFrame) -> DataFrame:
    return sets.groupBy("set_id").agg(F.count("*").alias("set_n"))


def _consensus(sets: DataFrame, kernel: Callable, places: Callable[[DataFrame], DataFrame], quality: bool) -> DataFrame:
    """set_id, seq, qual of each set: a set of up to MOST_READS reads is counted in arrays by the task that has them all, larger
    ones as sums by place and letter, which are combined before they are shuffled."""
    crowded = checkpointed(sets.groupBy("set_id").count().where(F.col("count") > MOST_READS).select("set_id"))
    n = crowded.count()
    sent = F.broadcast(crowded) if n <= 100_000 else crowded
    few = sets.join(sent, "set_id", "left_anti") if n else sets
    rows = few.select("set_id", F.upper("seq").alias("seq"), "qual").repartition("set_id").sortWithinPartitions("set_id")
    out = rows.mapInArrow(profiles.by_sets(kernel), "set_id string, seq string, qual string")
    return out.unionByName(assembled(places(sets.join(sent, "set_id", "left_semi")), quality)) if n else out


def _places(sets: DataFrame, quality: bool) -> DataFrame:
    """set_id, pos, ch (and q) of sets' consensus texts."""
    each = F.arrays_zip(chars(F.col("seq")).alias("ch"), S.phred(F.col("qual")).alias("q")) if quality else F.transform(chars(F.col("seq")), lambda c: F.struct(c.alias("ch")))
    return sets.select("set_id", F.posexplode(each).alias("pos", "x")).select("set_id", "pos", "x.*")


def quality_sets(sets: DataFrame, least_quality: int = 0, least_freq: float = 0.6, dependent: bool = False) -> DataFrame:
    """set_id, seq, qual: quality_consensus as texts."""
    kernel = profiles.consensus_kernel(True, least_quality, least_freq, dependent)
    return _consensus(sets, kernel, lambda x: _quality_places(x, least_quality, least_freq, dependent), True)


def frequency_sets(sets: DataFrame, least_freq: float = 0.6) -> DataFrame:
    """set_id, seq, qual (null): frequency_consensus as texts."""
    return _consensus(sets, profiles.consensus_kernel(False, 0, least_freq, False), lambda x: _frequency_places(x, least_freq), False)


def quality_consensus(sets: DataFrame, least_quality: int = 0, least_freq: float = 0.6, dependent: bool = False) -> DataFrame:
    """set_id, pos, ch, q of each set's consensus.

    Of the letters at a place that aren't missing, the one with the largest quality wins (the first of ties): the square of
    its sum (dependent: its largest times its sum) over the sum of all, as whole numbers; it is capped at 90.  Too low a quality or
    share of letters gives N.  In a set of one read only the quality counts.
    """
    return _places(quality_sets(sets, least_quality, least_freq, dependent), True)


def _quality_places(sets: DataFrame, least_quality: int, least_freq: float, dependent: bool) -> DataFrame:
    known = ~F.col("ch").isin(*MISSING)
    num = F.col("sum_q").cast("double") * F.col("max_q" if dependent else "sum_q")
    total = letter_sums(sets).groupBy("set_id", "pos").agg(
        F.sum("sum_q").alias("all_q"), F.sum(F.when(known, F.col("n"))).alias("all_n"),
        F.collect_list(F.when(known, F.struct("ch", "n", num.alias("num")))).alias("letters"),
    )
    scored = F.transform("letters", lambda x: F.struct((-F.floor(x["num"] / F.greatest("all_q", F.lit(1)))).cast("bigint").alias("q"), x["ch"].alias("ch"), (x["n"] / F.col("all_n")).alias("freq")))
    best = total.withColumn("best", F.array_min(scored)).join(_sizes(sets), "set_id")
    q = F.least(-F.col("best.q"), F.lit(90))
    bad = F.col("best").isNull() | (q < least_quality) | ((F.col("set_n") > 1) & (F.col("best.freq") < least_freq))
    return best.select("set_id", "pos", F.when(bad, F.lit("N")).otherwise(F.col("best.ch")).alias("ch"), F.when(bad, F.lit(0)).otherwise(q).cast("int").alias("q"))


def frequency_consensus(sets: DataFrame, least_freq: float = 0.6) -> DataFrame:
    """set_id, pos, ch: each set's most frequent letter that isn't missing (the first of ties), N if it is too rare; a set of one read is the read."""
    return _places(frequency_sets(sets, least_freq), False)


def _frequency_places(sets: DataFrame, least_freq: float) -> DataFrame:
    known = ~F.col("ch").isin(*MISSING)
    places = letter_sums(sets).groupBy("set_id", "pos").agg(
        F.sum(F.when(known, F.col("n"))).alias("all_n"), F.min(F.when(known, F.struct((-F.col("n")).alias("n"), "ch"))).alias("best"), F.min("ch").alias("only")
    ).join(_sizes(sets), "set_id")
    ch = F.when(F.col("best").isNull() | (-F.col("best.n") / F.col("all_n") < least_freq), F.lit("N")).otherwise(F.col("best.ch"))
    return places.select("set_id", "pos", F.when(F.col("set_n") == 1, F.col("only")).otherwise(ch).alias("ch"))


def gap_positions(sets: DataFrame, most: float) -> DataFrame:
    """set_id, pos of places where a larger share than `most` of a set's reads has a gap or has ended; none in sets of one read."""
    letters = letter_sums(sets).groupBy("set_id", "pos").agg(F.sum(F.when(~F.col("ch").isin("-", "."), F.col("n")).otherwise(0)).alias("bases"))
    return letters.join(_sizes(sets), "set_id").where((F.col("set_n") > 1) & (1 - F.col("bases") / F.col("set_n") > most)).select("set_id", "pos")


def assembled(places: DataFrame, quality: bool = True) -> DataFrame:
    """set_id, seq and qual of consensus places in order."""
    item = F.struct("pos", "ch", *(["q"] if quality else []))
    out = places.groupBy("set_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    qual = S.phred_string(F.transform("x", lambda v: v["q"])) if quality else F.lit(None).cast("string")
    return out.select("set_id", F.array_join(F.transform("x", lambda v: v["ch"]), "").alias("seq"), qual.alias("qual"))


def by_set(places: DataFrame) -> DataFrame:
    """set_id, refs: consensus letters as an array by place, null where there is none; of places, or of consensus texts."""
    if "seq" in places.columns:
        return places.select("set_id", chars(F.col("seq")).alias("refs"))
    known = F.map_from_entries(F.collect_list(F.struct("pos", "ch")))
    out = places.groupBy("set_id").agg(known.alias("_at"), F.max("pos").alias("_last"))
    return out.select("set_id", F.transform(F.sequence(F.lit(0), "_last"), lambda i: F.element_at("_at", i)).alias("refs"))


def set_error(sets: DataFrame, consensus: DataFrame) -> DataFrame:
    """set_id, error: one less the share of letters that agree with the consensus, among places where both have one; 1 if there is none, 0 in sets of one read.

    A set's consensus meets each of its reads as one array, and reads' counts are summed before they are shuffled.
    """
    joined = sets.join(by_set(consensus), "set_id")
    both = F.filter(F.arrays_zip(chars(F.upper("seq")).alias("a"), F.col("refs").alias("b")), lambda x: x["a"].isNotNull() & x["b"].isNotNull() & (x["a"] != "N"))
    agree = lambda x: (x["b"] != "N") & ((x["a"] == x["b"]) | (S.mask_of(x["a"]).bitwiseAND(S.mask_of(x["b"])) != 0))
    # a read counts as long as the fewer of its own and the consensus's letters that aren't ignored
    per_read = joined.select("set_id", both.alias("both"), F.size(F.filter("refs", lambda c: ~c.isin("n", "N"))).alias("b"))
    per_read = per_read.select("set_id", F.size(F.filter("both", agree)).alias("same"), F.least(F.size("both"), F.col("b")).alias("total"))
    sums = per_read.groupBy("set_id").agg(F.sum("same").alias("same"), F.sum("total").alias("total"), F.count("*").alias("n"))
    return sums.select("set_id", F.when(F.col("n") < 2, 0.0).when(F.col("total") == 0, 1.0).otherwise(1 - F.col("same") / F.col("total")).alias("error"))


def diversity(sets: DataFrame) -> DataFrame:
    """set_id, diversity: mean share of unequal letters over all pairs of a set's reads, for sets of reads of equal lengths.

    Places are added up by letter instead of pairing reads: at a place with counts n of letters, matching pairs are the sum
    of n n' over letters that match.  This is the pairwise mean if every pair has the same number of places.
    """
    counts = letter_sums(sets).groupBy("set_id", "pos").agg(F.collect_list(F.struct("ch", "n")).alias("l"), F.sum("n").alias("n"))
    mask = lambda x: S.mask_of(x["ch"])
    same = F.aggregate("l", F.lit(0).cast("bigint"), lambda a, x: a + x["n"] * F.aggregate("l", F.lit(0).cast("bigint"), lambda b, y: b + F.when(mask(x).bitwiseAND(mask(y)) != 0, y["n"]).otherwise(0)))
    places = counts.select("set_id", (same - F.col("n")).alias("same"), (F.col("n") * (F.col("n") - 1)).alias("pairs"))
    return places.groupBy("set_id").agg((1 - F.sum("same") / F.nullif(F.sum("pairs"), F.lit(0))).alias("d")).select("set_id", F.coalesce("d", F.lit(0.0)).alias("diversity"))


def copied(sets: DataFrame, field: str, action: str) -> DataFrame:
    """set_id and the annotations that a field gives a set: its min, max, sum, set (with counts) or majority (with its share)."""
    value = A.get(F.col("ann"), field)
    name = field.upper()
    if action in ("set", "majority"):
        m = majority(sets, field)
        fields = {name: F.array_join("values", ","), f"{name}_COUNT": F.array_join(F.transform("counts", lambda c: c.cast("string")), ",")} if action == "set" else {name: F.col("top"), f"{name}_FREQ": A.number_text(F.col("freq"))}
        return m.select("set_id", A.pairs(fields).alias("more"))
    number = F.transform(A.values(value), lambda x: F.coalesce(F.nullif(x, F.lit("")).cast("double"), F.lit(0.0)))
    one = {"min": F.min(F.array_min(number)), "max": F.max(F.array_max(number)), "sum": F.sum(F.aggregate(number, F.lit(0.0), lambda a, x: a + x))}[action]
    return sets.groupBy("set_id").agg(one.alias("x")).select("set_id", A.pairs({name: A.number_text(F.col("x"))}).alias("more"))


def build(reads: DataFrame, field: str = "BARCODE", least_count: int = 1, least_quality: int = 0, least_freq: float = 0.6, most_gap: float | None = None, primer_field: str | None = None, primer_freq: float | None = None, copy_fields: list[str] | None = None, copy_actions: list[str] | None = None, dependent: bool = False, most_diversity: float | None = None, most_error: float | None = None, quality: bool = True, places_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """set_id, conscount, ann, seq, qual: a consensus of every set that passes the gates, in the order primer, count, gaps, diversity, error.

    quality: by qualities, else by frequency; places_of: a consensus of one's own, from sets to rows set_id, pos, ch, q (q: if
    quality).  most_diversity and most_error exclude each other.
    """
    if most_diversity is not None and most_error is not None:
        raise ValueError("give the greatest diversity or the greatest error, not both")
    sets = with_set(reads, field)
    if primer_field and primer_freq is not None:
        sets = keep_majority(sets, primer_field, primer_freq).drop("top", "freq")
    counts = sets.groupBy("set_id").agg(F.count("*").alias("conscount")).where(F.col("conscount") >= least_count)
    sets = sets.join(counts.select("set_id"), "set_id", "left_semi") if least_count > 1 else sets
    if places_of:
        places = places_of(sets)
    else:
        places = quality_sets(sets, least_quality, least_freq, dependent) if quality else frequency_sets(sets, least_freq)
    if most_gap is not None:
        places = _places(places, quality) if "seq" in places.columns else places
        places = places.join(gap_positions(sets, most_gap), ["set_id", "pos"], "left_anti")
    out = (places if "seq" in places.columns else assembled(places, quality)).join(counts, "set_id")
    if most_diversity is not None:
        out = out.join(diversity(sets).where(F.col("diversity") <= most_diversity), "set_id", "left_semi")
    if most_error is not None:
        out = out.join(set_error(sets, places).where(F.col("error") <= most_error), "set_id", "left_semi")
    ann: Column = A.pairs({"CONSCOUNT": F.col("conscount")})
    extra = []
    if primer_field:
        m = majority(sets, primer_field)
        names = ({"PRCONS": F.col("top"), "PRFREQ": A.number_text(F.col("freq"))} if primer_freq is not None else {"PRIMER": F.array_join("values", ","), "PRCOUNT": F.array_join(F.transform("counts", lambda c: c.cast("string")), ",")})
        extra.append(m.select("set_id", A.pairs(names).alias("more")))
    extra += [copied(sets, f, a) for f, a in zip(copy_fields or [], copy_actions or [], strict=True)]
    for k, x in enumerate(extra):
        out = out.join(x.withColumnRenamed("more", f"_more{k}"), "set_id", "left")
    ann = reduce(lambda a, k: A.merge(a, F.col(f"_more{k}")), range(len(extra)), ann)
    return out.select("set_id", "conscount", ann.alias("ann"), "seq", "qual")

