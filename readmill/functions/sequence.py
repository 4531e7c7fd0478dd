"""Sequence and quality expressions; all of them native, so they stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from readmill.schema import COMPLEMENT, MASKS, MISSING, chars


def reverse_complement(seq: Column) -> Column:
    """Complement of each letter (IUPAC codes too), last first."""
    return F.reverse(F.translate(seq, *COMPLEMENT))


def strip(seq: Column, letters: str = MISSING) -> Column:
    """seq without the given letters at its ends."""
    return F.btrim(seq, F.lit(letters))


def count_letters(seq: Column, letters: str = MISSING) -> Column:
    """How many of seq's characters are among letters."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def weight(seq: Column, letters: str = MISSING) -> Column:
    """How many of seq's characters are bases, that is not among letters."""
    return F.length(F.translate(seq, letters, ""))


def longest_run(seq: Column) -> Column:
    """Length of the longest run of one letter; 0 for an empty sequence."""
    runs = F.regexp_extract_all(seq, F.lit(r"((.)\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def phred(qual: Column) -> Column:
    """Quality scores of a Phred+33 string."""
    return F.transform(chars(qual), lambda c: F.ascii(c) - 33)


def phred_string(scores: Column) -> Column:
    """Phred+33 string of quality scores."""
    return F.array_join(F.transform(scores, lambda q: F.chr(q + 33)), "")


def total_quality(qual: Column) -> Column:
    """Sum of the scores of a Phred+33 string.

    An aggregate over characters is interpreted per character; counting each of the 94 possible characters by translate
    would scan the string 94 times, so the fold it is.
    """
    return F.aggregate(chars(qual), F.lit(0), lambda a, c: a + F.ascii(c) - 33)


def mean_quality(qual: Column) -> Column:
    """Floor of the mean score; 0 for an empty string."""
    return F.when(F.length(qual) > 0, F.floor(total_quality(qual) / F.length(qual))).otherwise(F.lit(0)).cast("int")


def mask_of(letter: Column) -> Column:
    """Four-bit base set of a nucleotide letter (16 for a gap, 0 for anything else)."""
    known = [F.lit(x) for k, v in ({**MASKS, "-": 16, ".": 16}).items() for x in (k, v)]
    return F.coalesce(F.element_at(F.create_map(*known), letter), F.lit(0))


def letter_pairs(read_n: bool | None, pattern_n: bool | None, gaps: bool | None) -> dict[str, str]:
    """For each letter of a pattern the letters of a read that match it, as a string.

    Two letters match if their base sets meet, two gaps too; the arguments override what N in the read, N in the pattern
    and gaps do, in the order: gap in the read, N in the read, gap in the pattern, N in the pattern.
    """

    def match(a: str, b: str) -> bool:
        for hit, answer in ((a in "-.", gaps), (a in "Nn", read_n), (b in "-.", gaps), (b in "Nn", pattern_n)):
            if hit and answer is not None:
                return answer
        if a in "-." or b in "-.":
            return a in "-." and b in "-."
        return bool(MASKS[a] & MASKS[b])

    letters = [*MASKS, "-", "."]
    return {b: "".join(a for a in letters if match(a, b)) for b in letters}


#: How primers are matched: N in a read is a mismatch, N in a primer a match, gaps are mismatches.
PRIMER_MATCH = letter_pairs(False, True, False)


def matches(region: Column, pattern: str, table: dict[str, str] | None = None) -> Column:
    """Number of places at which a region's letters match a fixed pattern; places past the region's end don't."""
    table = table or PRIMER_MATCH
    terms = []
    for i, p in enumerate(pattern.upper(), 1):
        letter = F.substring(region, i, 1)
        terms.append(F.when(letter.isin(*table[p]), 1).otherwise(0))
    return reduce(lambda a, b: a + b, terms, F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    """Places at which two strings of equal length differ."""
    return F.aggregate(F.zip_with(chars(a), chars(b), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


#: Residues that ambiguous amino acid codes stand for (fixed values); X is any.
AMINO = {"B": "RN", "Z": "EQ", "J": "LI"}


def amino_pairs(read_x: bool | None = None, pattern_x: bool | None = None, gaps: bool | None = None) -> dict[str, str]:
    """letter_pairs for amino acids: for each letter of a pattern the letters of a read that match it."""
    letters = [chr(c) for c in range(65, 91)] + ["*"]
    stands = {c: set(AMINO.get(c, c)) for c in letters} | {"X": set(letters)}

    def match(a: str, b: str) -> bool:
        for hit, answer in ((a in "-.", gaps), (a == "X", read_x), (b in "-.", gaps), (b == "X", pattern_x)):
            if hit and answer is not None:
                return answer
        if a in "-." or b in "-.":
            return a in "-." and b in "-."
        return bool(stands[a] & stands[b])

    return {b: "".join(a for a in [*letters, "-", "."] if match(a, b)) for b in [*letters, "-", "."]}


def pair_error(a: Column, b: Column) -> Column:
    """Share of places at which two reads of equal length differ; N and other codes match what they may stand for."""
    same = F.aggregate(F.zip_with(chars(F.upper(a)), chars(F.upper(b)), lambda x, y: (mask_of(x).bitwiseAND(mask_of(y)) != 0).cast("int")), F.lit(0), lambda s, x: s + x)
    return 1 - same / F.length(a)
