"""Header annotations as an ordered array of (k, v): parsing, writing, and the algebra on them, natively."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readmill.schema import ANN, upper_fields

DELIMITERS = ("|", "=", ",")


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in text)


def read_id(header: Column, delimiters: tuple[str, str, str] = DELIMITERS) -> Column:
    """What stands before the first field."""
    return F.substring_index(header, delimiters[0], 1)


def parse(header: Column, delimiters: tuple[str, str, str] = DELIMITERS) -> Column:
    """Annotations of a header without its id: keys in upper case, of repeated keys the last value at the first place.

    A field without a value separator raises an error when it is read.
    """
    sep, eq, _ = delimiters
    parts = F.split(header, _quoted(sep))
    fields = F.slice(parts, F.lit(2), F.size(parts))

    def pair(x: Column) -> Column:
        parts = F.split(x, _quoted(eq))
        return F.struct(F.upper(parts[0]).alias("k"), F.when(F.size(parts) > 1, parts[1]).otherwise(F.raise_error(F.concat(F.lit("no value in field "), x))).alias("v"))

    return _last_wins(F.transform(fields, pair))


def _last_wins(pairs: Column) -> Column:
    keys = F.transform(pairs, lambda p: p["k"])
    distinct = F.array_distinct(keys)
    return F.when(F.size(distinct) == F.size(keys), pairs).otherwise(F.transform(distinct, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("v"))))


def flatten(name: Column, ann: Column, delimiters: tuple[str, str, str] = DELIMITERS) -> Column:
    """Header text of an id (NONE if null) and annotations."""
    sep, eq, _ = delimiters
    fields = F.transform(ann, lambda p: F.concat(F.upper(p["k"]), F.lit(eq), F.coalesce(p["v"], F.lit(""))))
    return F.concat_ws(sep, F.coalesce(name, F.lit("NONE")), fields)


def get(ann: Column, field: str) -> Column:
    """A field's value, null if the header has none."""
    return F.get(F.filter(ann, lambda p: p["k"] == field.upper()), F.lit(0))["v"]


def has(ann: Column, field: str) -> Column:
    return F.exists(ann, lambda p: p["k"] == field.upper())


def values(value: Column, delimiter: str = ",") -> Column:
    """The list in a value."""
    return F.split(value, _quoted(delimiter))


def pairs(items: dict[str, Column]) -> Column:
    """Annotations of field names and values; those whose value is null are left out."""
    if not items:
        return F.array().cast(ANN)
    made = F.array(*(F.struct(F.lit(k.upper()).alias("k"), v.cast("string").alias("v")) for k, v in items.items()))
    return F.filter(made, lambda p: p["v"].isNotNull())


def merge(ann: Column, other: Column, prepend: bool = False, delimiter: str = ",") -> Column:
    """ann with other's fields: new ones come last, values of known ones are joined to theirs, behind or before."""

    def joined(p: Column) -> Column:
        more = F.get(F.filter(other, lambda q: q["k"] == p["k"]), F.lit(0))["v"]
        both = F.concat(more, F.lit(delimiter), p["v"]) if prepend else F.concat(p["v"], F.lit(delimiter), more)
        return F.struct(p["k"].alias("k"), F.coalesce(both, p["v"]).alias("v"))

    new = F.filter(other, lambda q: ~F.exists(ann, lambda p: p["k"] == q["k"]))
    return F.concat(F.transform(ann, joined), new)


def add(ann: Column, items: dict[str, Column], delimiter: str = ",") -> Column:
    """Fields with given values, merged."""
    return merge(ann, pairs(items), delimiter=delimiter)


def number_text(x: Column) -> Column:
    """A double as text with at most 12 significant digits, without an exponent for usual sizes and without zeros at its end."""
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,12)").cast("string"), r"0+$", ""), r"\.$", "")
    digits = F.greatest(F.lit(0), F.lit(12) - F.ceil(F.log10(F.greatest(F.abs(x), F.lit(1e-12)))).cast("int"))
    rounded = F.when(F.abs(x) >= 1, F.round(x * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)).otherwise(x)
    return F.when(x == F.floor(x), F.floor(x).cast("string")).when(F.abs(x) >= 1, F.regexp_replace(F.regexp_replace(rounded.cast("decimal(38,12)").cast("string"), r"0+$", ""), r"\.$", "")).otherwise(plain)


def collapsed(value: Column, action: str | None, delimiter: str = ",") -> Column:
    """A value's list reduced: min, max, sum (empty counts as 0; text that is no number raises), set, first, last or cat."""
    items = values(value, delimiter)
    numbers = F.transform(items, lambda x: F.coalesce(F.nullif(x, F.lit("")).cast("double"), F.lit(0.0)))
    match action:
        case "min":
            return number_text(F.array_min(numbers))
        case "max":
            return number_text(F.array_max(numbers))
        case "sum":
            return number_text(F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x))
        case "set":
            return F.array_join(F.array_sort(F.array_distinct(items)), delimiter)
        case "first":
            return F.element_at(items, 1)
        case "last":
            return F.element_at(items, -1)
        case "cat":
            return F.array_join(items, "")
    return value


def collapse(ann: Column, action: str, fields: list[str], delimiter: str = ",") -> Column:
    """The values of the given fields reduced."""
    names = upper_fields(fields)
    return F.transform(ann, lambda p: F.struct(p["k"].alias("k"), F.when(p["k"].isin(names), collapsed(p["v"], action, delimiter)).otherwise(p["v"]).alias("v")))


def delete(ann: Column, fields: list[str]) -> Column:
    """Annotations without the given fields."""
    names = upper_fields(fields)
    return F.filter(ann, lambda p: ~p["k"].isin(names))


def select(ann: Column, fields: list[str]) -> Column:
    """The given fields alone, in header order."""
    names = upper_fields(fields)
    return F.filter(ann, lambda p: p["k"].isin(names))


def copy(ann: Column, fields: list[str], names: list[str], actions: list[str] | None = None, delimiter: str = ",") -> Column:
    """Fields' values copied to other names, all from the annotations as they came; then reduced if actions are given."""
    out = ann
    for field, name in zip(fields, names, strict=True):
        out = merge(out, pairs({name: get(ann, field)}), delimiter=delimiter)
    for name, action in zip(names, actions or [], strict=False):
        out = collapse(out, action, [name], delimiter)
    return out


def expand(ann: Column, fields: list[str], separator: str = ",") -> Column:
    """Each of the fields' lists as fields of their own, NAME1, NAME2 and so on, at the end; the field goes."""

    def numbered(field: str):
        return lambda v, i: F.struct(F.concat(F.lit(field), (i + 1).cast("string")).alias("k"), v.alias("v"))

    for field in upper_fields(fields):
        items = F.coalesce(values(get(ann, field), separator), F.array().cast("array<string>"))
        ann = F.concat(delete(ann, [field]), F.transform(items, numbered(field)))
    return ann


def merge_fields(ann: Column, fields: list[str], name: str, action: str | None = None, remove: bool = False, delimiter: str = ",") -> Column:
    """The fields' values as one list under a new name, reduced if an action is given."""
    joined = F.concat_ws(delimiter, *(get(ann, f) for f in fields))
    out = merge(delete(ann, fields) if remove else ann, pairs({name: joined}), delimiter=delimiter)
    return collapse(out, action, [name], delimiter) if action else out


def rename(ann: Column, fields: list[str], names: list[str], actions: list[str] | None = None, delimiter: str = ",") -> Column:
    """Fields under other names, in place; where the name is taken the values are merged behind its own."""

    def named(old: str, new: str):
        return lambda p: F.struct(F.when(p["k"] == old, F.lit(new)).otherwise(p["k"]).alias("k"), p["v"].alias("v"))

    for i, (old, new) in enumerate(zip(upper_fields(fields), upper_fields(names), strict=True)):
        taken = merge(delete(ann, [old]), pairs({new: get(ann, old)}), delimiter=delimiter)
        ann = F.when(has(ann, new), taken).otherwise(F.transform(ann, named(old, new)))
        if actions:
            ann = collapse(ann, actions[i], [new], delimiter)
    return ann


def coordinate(header: Column, kind: str = "annotated") -> Column:
    """The key that mates share: what machines and archives of a kind put before the mate's number."""
    match kind:
        case "illumina" | "solexa":
            return F.element_at(F.split(header, r"[ /#]"), 1)
        case "sra" | "ena":
            return F.substring_index(F.element_at(F.split(header, r"\s"), 1), ".", 2)
        case "454":
            return F.element_at(F.split(header, r"\s"), 1)
        case "annotated":
            return read_id(header)
    return header
