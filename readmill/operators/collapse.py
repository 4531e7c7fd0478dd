"""Removal of duplicate reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readmill.functions import annotation as A
from readmill.functions import sequence as S
from readmill.schema import MISSING_UPPER, chars, checkpointed, upper_fields


def _parts(reads: DataFrame, uniq_fields: list[str] | None, inner: bool) -> DataFrame:
    """Reads with the text and fields by which they are collapsed, and their missing letters; out of a generator, so that a
    filter on these stays above it and nothing is made twice."""
    seq = S.strip(F.col("seq"), MISSING_UPPER) if inner else F.col("seq")
    uniq = F.array(*(A.get(F.col("ann"), f) for f in uniq_fields or [])).cast("array<string>")
    key = F.upper(seq)
    return reads.select("*", F.inline(F.array(F.struct(key.alias("_key"), uniq.alias("_uniq"), S.count_letters(key, MISSING_UPPER).alias("_missing")))))


def _order(max_field: str | None, min_field: str | None, compat: bool = False) -> Column:
    """What makes a member the representative: fewer missing letters, then the field's or mean quality, then file order.

    compat: min_field takes the largest value too, as older results have it.
    """
    if max_field or min_field:
        number = F.coalesce(A.get(F.col("ann"), max_field or min_field).cast("double"), F.lit(0.0))
        best = number if max_field or compat else -number
    else:
        best = F.when(F.length("qual") > 0, S.total_quality(F.col("qual")) / F.length("qual")).otherwise(F.lit(0.0))
    return F.struct((-F.col("_missing")).alias("m"), best.alias("b"), (-F.col("ord")).alias("o"))


def _copied(ann: Column, members: str, fields: list[str], actions: list[str]) -> dict[str, Column]:
    return {f: F.expr(f"{members}_{i}") for i, f in enumerate(fields)}


def _aggregates(fields: list[str], actions: list[str]) -> dict[str, Column]:
    """min, max and sum of a field over members, each member's list of values first reduced alike; set of all values."""
    out = {}
    for i, (field, action) in enumerate(zip(fields, actions, strict=True)):
        value = A.get(F.col("ann"), field)
        numbers = F.transform(A.values(value), lambda x: F.coalesce(F.nullif(x, F.lit("")).cast("double"), F.lit(0.0)))
        match action:
            case "min":
                out[f"_copy_{i}"] = A.number_text(F.min(F.array_min(numbers)))
            case "max":
                out[f"_copy_{i}"] = A.number_text(F.max(F.array_max(numbers)))
            case "sum":
                out[f"_copy_{i}"] = A.number_text(F.sum(F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)))
            case "set":
                out[f"_copy_{i}"] = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(A.values(value))))), ",")
            case _:
                raise ValueError(f"no such action: {action}")
    return out


def unique_reads(reads: DataFrame, uniq_fields: list[str] | None = None, copy_fields: list[str] | None = None, copy_actions: list[str] | None = None, max_field: str | None = None, min_field: str | None = None, inner: bool = False, compat: bool = False) -> DataFrame:
    """One read of each group of equal sequences (and uniq_fields), with DUPCOUNT and copied fields; reads with a missing letter are left out.

    One grouped aggregation, combined before its shuffle.  Sequences are compared in upper case; an absent field is null
    and equals only null.  The representative has the largest max_field (smallest min_field), else the best mean quality.
    """
    fields, actions = upper_fields(copy_fields), copy_actions or []
    parts = _parts(reads, uniq_fields, inner).where("_missing = 0")
    best = F.max_by(F.struct("src", "ord", "read_id", "header", "ann", "seq", "qual"), _order(max_field, min_field, compat))
    grouped = parts.groupBy("_key", "_uniq").agg(best.alias("_rep"), F.count("*").alias("dupcount"), *(x.alias(k) for k, x in _aggregates(fields, actions).items()))
    ann = A.delete(F.col("_rep.ann"), fields)
    ann = F.concat(ann, A.pairs({**_copied(ann, "_copy", fields, actions), "DUPCOUNT": F.col("dupcount")}))
    return grouped.select("_rep.src", "_rep.ord", "_rep.read_id", "_rep.header", ann.alias("ann"), "_rep.seq", "_rep.qual", "dupcount")


def undetermined(reads: DataFrame, most_missing: int = 0, inner: bool = False) -> DataFrame:
    """Reads with more missing letters than are allowed; with DUPCOUNT 1 they may be kept."""
    out = _parts(reads, None, inner).where(F.col("_missing") > most_missing)
    return out.withColumn("ann", F.concat("ann", A.pairs({"DUPCOUNT": F.lit(1)}))).withColumn("dupcount", F.lit(1).cast("bigint")).drop("_key", "_uniq", "_missing")


def duplicates(reads: DataFrame, kept: DataFrame) -> DataFrame:
    """Reads that a collapse did not keep."""
    return reads.join(kept.select("ord"), "ord", "left_anti")


def letters_agree(a: Column, b: Column) -> Column:
    """Whether texts of equal length have base sets that meet at every place; N and gaps agree with anything."""
    free = lambda x: x.isin(*MISSING_UPPER)
    same = lambda x, y: (x == y) | free(x) | free(y) | (S.mask_of(x).bitwiseAND(S.mask_of(y)) != 0)
    return F.forall(F.zip_with(chars(a), chars(b), same), lambda x: x)


#: Letters that aren't bases which a key may have and still be matched by its parts; deals of what is compared without.
MOST_HIDDEN, DEALS = 8, 16


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k)


def _indexed(keys: DataFrame) -> tuple[DataFrame, int]:
    """keys with `parts` (interleaved letters), `hidden` (bits of the parts with other letters than bases) and `far`, and the number of parts.

    Two keys hide a part for each such letter at most, so with two parts more than both can hide, every pair that isn't far
    has two parts that neither hides.
    """
    letters = F.length(F.regexp_replace("_key", "[ACGT]", ""))
    keys = keys.withColumn("far", letters > MOST_HIDDEN)
    most = keys.where("not far").agg(F.max(letters)).first()[0] or 0
    parts = max(6, 2 * most + 2)
    take = lambda k: lambda c, i: i % parts == k
    keys = keys.withColumn("parts", F.array(*(F.array_join(F.filter(chars(F.col("_key")), take(k)), "") for k in range(parts))))
    hidden = F.aggregate(F.transform("parts", lambda x, k: F.when(x.rlike("[^ACGT]"), _bit(k)).otherwise(0)), F.lit(0), lambda a, x: a + x)
    return keys.withColumn("hidden", hidden), parts


def _lowest(hidden: Column, i: Column, j: Column) -> Column:
    """Whether i < j are the two lowest parts that aren't hidden, of two that aren't."""
    below = _bit(j) - 1
    return hidden.bitwiseAND(below) == below - _bit(i)


def _candidates(left: DataFrame, right: DataFrame, parts: int, complete: bool) -> DataFrame:
    """x, y and the key of pairs, none of them far, that have equal letters in the two lowest parts which neither hides, y before x.

    A key stands for two parts and their letters, so what meets there is alike.  complete: right keys hide nothing, so a
    left key needs only the two lowest parts that it shows itself, and right keys go only to those of their length and fields.
    """
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in range(parts) for i in range(j)))
    group = ["_n", "uniq"]
    shown = F.concat_ws("|", F.get("parts", F.col("at.i")), F.get("parts", F.col("at.j")))
    free = (F.getbit("hidden", F.col("at.i")) == 0) & (F.getbit("hidden", F.col("at.j")) == 0)
    key = F.struct("_missing", "_ord", "_key", "_uniq")
    left, right = (side.where("not far").withColumn("uniq", F.to_json(F.struct("_uniq"))) for side in (left, right))
    x = left.withColumn("at", F.explode(pairs)).where(free & (_lowest(F.col("hidden"), F.col("at.i"), F.col("at.j")) if complete else F.lit(True)))
    x = x.select(*group, "at", shown.alias("shown"), F.col("hidden").alias("x_hidden"), key.alias("x"))
    if complete:
        needed = x.groupBy(*group).agg(F.collect_set("at").alias("needed"))  # as many as pairs of parts at most
        y = right.join(needed, group).withColumn("at", F.explode("needed"))
    else:
        y = right.withColumn("at", F.explode(pairs)).where(free)
    y = y.select(*group, "at", shown.alias("shown"), F.col("hidden").alias("y_hidden"), key.alias("y"))
    both = x.join(y, [*group, "at", "shown"])
    return both.where(_lowest(F.col("x_hidden").bitwiseOR(F.col("y_hidden")), F.col("at.i"), F.col("at.j")) & (F.col("y") < F.col("x")))


def _agreeing(left: DataFrame, right: DataFrame, parts: int, complete: bool) -> DataFrame:
    """(x, y) structs of left and right keys of one length and uniq_fields that agree, y before x.

    Keys with more than MOST_HIDDEN letters that aren't bases are compared with all of their length and fields, in deals.
    """
    both = _candidates(left, right, parts, complete).select("x", "y")
    if not left.where("far").isEmpty():
        key = F.struct("_missing", "_ord", "_key", "_uniq")

        def side(rows: DataFrame, name: str, dealt: bool) -> DataFrame:
            deal = F.pmod(F.xxhash64("_key"), F.lit(DEALS)).cast("int") if dealt else F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)))
            return rows.select(deal.alias("deal"), "_n", F.to_json(F.struct("_uniq")).alias("uniq"), key.alias(name))

        on = ["deal", "_n", "uniq"]
        far = side(left.where("far"), "x", True).join(side(right, "y", False), on)
        if not complete:
            far = far.unionByName(side(left.where("not far"), "x", False).join(side(right.where("far"), "y", True), on))
        both = both.unionByName(far.where(F.col("y") < F.col("x")).select("x", "y"))
    return both.where(letters_agree(F.col("x._key"), F.col("y._key")))


def _owners(same: DataFrame) -> DataFrame:
    """_key, _uniq, _head: in order of missing letters and file order, a key with missing letters joins the first head that it agrees with, or becomes one.

    Keys without missing letters are heads.  Of the others, those that agree with one of these are settled by one join;
    what is left depends on the order among itself and is settled in rounds: a key whose first neighbour that isn't a
    member is a head becomes its member, and one without such a neighbour becomes a head.  Rounds are checkpointed.
    """
    keys, parts = _indexed(checkpointed(same))
    keys = checkpointed(keys)
    unclear, clear = keys.where("_missing > 0"), keys.where("_missing = 0")
    led = _agreeing(unclear, clear, parts, clear.where("hidden > 0 or far").isEmpty()).groupBy("x").agg(F.min("y").alias("y"))
    settled = checkpointed(led.select("x._key", "x._uniq", F.col("y._key").alias("_head")))
    heads = keys.where("_missing = 0").select("_key", "_uniq", F.col("_key").alias("_head"))
    on = lambda a, b: (a["_key"] == b["_key"]) & a["_uniq"].eqNullSafe(b["_uniq"])
    rest = unclear.join(settled, on(unclear, settled), "left_anti")
    edges = checkpointed(_agreeing(rest, rest, parts, False))
    now = checkpointed(rest.select(F.struct("_missing", "_ord", "_key", "_uniq").alias("x"), F.lit(None).cast("string").alias("_head")))
    while not now.where("_head is null").isEmpty():
        of_y = now.select(F.col("x").alias("y"), F.col("_head").alias("head_of_y"))
        first = edges.join(of_y, "y").where(F.col("head_of_y").isNull() | (F.col("head_of_y") == F.col("y._key")))
        first = first.groupBy("x").agg(F.min(F.struct("y", "head_of_y")).alias("f"))
        head = F.coalesce("_head", F.when(F.col("f").isNull(), F.col("x._key")).otherwise(F.col("f.head_of_y")))
        now = checkpointed(now.join(first, "x", "left").select("x", head.alias("_head")))
    return heads.unionByName(settled).unionByName(now.select("x._key", "x._uniq", "_head"))


def ambiguous_reads(reads: DataFrame, most_missing: int, uniq_fields: list[str] | None = None, copy_fields: list[str] | None = None, copy_actions: list[str] | None = None, max_field: str | None = None, min_field: str | None = None, inner: bool = False) -> DataFrame:
    """Like unique_reads, but reads with up to most_missing missing letters join the first earlier group that they agree with.

    Equal texts are combined first; then distinct ones are matched by joins (see _owners), so no group of reads is ever
    gathered in one task.
    """
    fields, actions = upper_fields(copy_fields), copy_actions or []
    parts = _parts(reads, uniq_fields, inner).where(F.col("_missing") <= most_missing)
    order = F.struct("_missing", "ord")
    same = parts.groupBy("_key", "_uniq", "_missing").agg(F.min(order).alias("_first")).select("_key", "_uniq", F.length("_key").alias("_n"), F.col("_first._missing").alias("_missing"), F.col("_first.ord").alias("_ord"))
    owners = _owners(same)
    led = parts.join(owners, (parts["_key"].eqNullSafe(owners["_key"])) & (parts["_uniq"].eqNullSafe(owners["_uniq"])), "inner").select(parts["*"], owners["_head"])
    best = F.max_by(F.struct("src", "ord", "read_id", "header", "ann", "seq", "qual"), _order(max_field, min_field))
    grouped = led.groupBy("_head", "_uniq").agg(best.alias("_rep"), F.count("*").alias("dupcount"), *(x.alias(k) for k, x in _aggregates(fields, actions).items()))
    ann = F.concat(A.delete(F.col("_rep.ann"), fields), A.pairs({**_copied(F.col("ann"), "_copy", fields, actions), "DUPCOUNT": F.col("dupcount")}))
    return grouped.select("_rep.src", "_rep.ord", "_rep.read_id", "_rep.header", ann.alias("ann"), "_rep.seq", "_rep.qual", "dupcount")


