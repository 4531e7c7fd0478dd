"""Headers of sequencers and archives as id and annotations; each gives a struct (read_id, ann), null where it doesn't fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readmill.functions.annotation import pairs


def _made(ok: Column, name: Column, fields: dict[str, Column]) -> Column:
    return F.when(ok, F.struct(name.alias("read_id"), pairs(fields).alias("ann")))


def _squeezed(text: Column, letters: str) -> Column:
    return F.regexp_replace(text, rf"[{letters}\s]+", "_")


def generic(header: Column) -> Column:
    """All of the header is the id; runs of separators and white space become _."""
    return _made(F.lit(True), _squeezed(header, "|=,"), {})


def roche454(header: Column) -> Column:
    """ID, LENGTH and, in the older style, UACCNO."""
    f = F.split(header, " ")
    return _made(F.size(f).isin(2, 3), f[0], {"LENGTH": F.replace(f[1], F.lit("length="), F.lit("")), "UACCNO": F.replace(F.get(f, F.lit(2)), F.lit("uaccno="), F.lit(""))})


def genbank(header: Column) -> Column:
    """ID, GI, SOURCE and DESC of five parts between bars, else ID and DESC."""
    old, new = F.split(header, r"\|"), F.split(header, " ")
    is_old = F.size(old) == 5
    desc = F.when(is_old, _squeezed(F.trim(F.get(old, F.lit(4))), "=,")).otherwise(_squeezed(F.array_join(F.slice(new, F.lit(2), F.size(new)), "_"), "=,"))
    part = lambda i: F.when(is_old, F.get(old, F.lit(i)))
    return _made(header.isNotNull(), F.coalesce(part(3), new[0]), {"GI": part(1), "SOURCE": part(2), "DESC": desc})


def illumina(header: Column) -> Column:
    """ID, INDEX where there is one, and READ, in three layouts."""
    words = F.split(header, " ")
    new, indexed = F.size(words) == 2, header.contains("#")
    last = F.split(F.get(words, F.lit(1)), ":")
    tail = F.split(F.get(F.split(header, "#"), F.lit(1)), "/")
    plain = F.split(header, "/")
    name = F.when(new, words[0]).when(indexed, F.element_at(F.split(header, "#"), 1)).otherwise(plain[0])
    index = F.when(new, F.get(last, F.lit(3))).when(indexed, F.get(tail, F.lit(0)))
    read = F.when(new, last[0]).when(indexed, F.get(tail, F.lit(1))).otherwise(F.get(plain, F.lit(1)))
    ok = F.when(new, F.size(last) >= 4).when(indexed, F.size(tail) >= 2).otherwise(F.size(plain) >= 2)
    return _made(ok, name, {"INDEX": index, "READ": read})


def imgt(header: Column, simple: bool = False) -> Column:
    """ID (the allele), SPECIES, REGION, FUNCTIONALITY, PARTIAL and ACCESSION; the id alone if simple."""
    f = F.split(header, r"\|")
    part = lambda i: F.get(f, F.lit(i))
    if simple:
        return _made(F.size(f) >= 2, part(1), {})
    partial = F.when(F.regexp_replace(part(13), r"\s", "") == "", "FALSE").otherwise("TRUE")
    fields = {"SPECIES": F.regexp_replace(part(2), r"\s", "_"), "REGION": part(4), "FUNCTIONALITY": F.regexp_replace(part(3), r"[\(\)\[\]]", ""), "PARTIAL": partial, "ACCESSION": part(0)}
    return _made(F.size(f) >= 14, part(1), fields)


def sra(header: Column) -> Column:
    """ID, READ where the id has one, DESC, and LENGTH where given."""
    f = F.split(header, " ")
    name = F.split(f[0], r"\.")
    numbered = F.size(name) == 3
    third = F.get(f, F.lit(2))
    fields = {"READ": F.when(numbered, F.get(name, F.lit(2))), "DESC": F.get(f, F.lit(1)), "LENGTH": F.when(third.contains("length"), F.replace(third, F.lit("length="), F.lit("")))}
    return _made(F.size(f) >= 2, F.when(numbered, F.substring_index(f[0], ".", 2)).otherwise(f[0]), fields)


def migec(header: Column) -> Column:
    """ID and COUNT between colons."""
    f = F.split(header, ":")
    return _made(F.size(f) >= 3, F.get(f, F.lit(1)), {"COUNT": F.get(f, F.lit(2))})
