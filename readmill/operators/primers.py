"""Primer matching, masking, and barcode extraction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readmill.functions import annotation as A
from readmill.functions import sequence as S
from readmill.schema import COMPLEMENT, IUPAC

MODES = ("cut", "mask", "trim", "tag")


def reverse_primers(primers: dict[str, str]) -> dict[str, str]:
    return {k: v.upper().translate(str.maketrans(*COMPLEMENT))[::-1] for k, v in primers.items()}


def score_primers(reads: DataFrame, primers: dict[str, str], start: int = 0, most_error: float = 0.2, reverse: bool = False) -> DataFrame:
    """primer, error, p_start, p_end, gaps and valid: the primer that fits best at a fixed place, the first one of ties.

    reverse: primers, as given, are sought `start` letters before the read's end.  Primers are a parameter of the plan: one
    expression for each, over the same substring, with no join.
    """
    seq = F.upper("seq")
    scored = []
    for order, (name, primer) in enumerate(primers.items()):
        n = len(primer)
        at = F.greatest(F.length("seq") - start - n, F.lit(0)) if reverse else F.lit(start)
        error = 1 - S.matches(F.substring(seq, at + 1, n), primer) / F.lit(n)
        scored.append(F.struct(error.alias("error"), F.lit(order).alias("ord"), F.lit(name).alias("primer"), at.alias("p_start"), (at + n).alias("p_end")))
    best = F.array_min(F.array(*scored))
    out = reads.select(*reads.columns, F.inline(F.array(best)).alias("_error", "_ord", "_primer", "p_start", "p_end"))  # scored once, however often it is used
    hit = F.col("_error") < 1
    return out.select(
        *reads.columns, F.when(hit, F.col("_primer")).alias("primer"), F.col("_error").alias("error"), "p_start", "p_end", F.lit(0).alias("gaps"), (hit & (F.col("_error") <= most_error)).alias("valid"),
    )


def extract_region(reads: DataFrame, start: int, length: int, reverse: bool = False) -> DataFrame:
    """The letters at a fixed place as the primer; every read is valid."""
    at = F.greatest(F.length("seq") - start - length, F.lit(0)) if reverse else F.lit(start)
    end = F.least(at + length, F.length("seq"))
    return reads.withColumns({"p_start": at, "p_end": end, "gaps": F.lit(0), "error": F.lit(0.0), "primer": F.substring(F.upper("seq"), at + 1, length), "valid": F.lit(True)})


def mask(matched: DataFrame, mode: str = "mask", barcode: bool = False, barcode_length: int | None = None, reverse: bool = False, barcode_field: str = "BARCODE", primer_field: str = "PRIMER", orientation: bool = False) -> DataFrame:
    """seq, qual and ann after a match: cut drops the primer and what is before it, trim what is before it, mask puts N (quality 0) for it, tag changes nothing.

    The barcode is what is before the primer, or the last barcode_length letters of that.  reverse: mirrored, for primers at
    the read's end.  Reads without a match stay as they are; a read of which nothing is left isn't valid.
    """
    seq, qual, n = F.upper("seq"), F.col("qual"), F.length("seq")
    start, end = F.col("p_start"), F.col("p_end")

    def part(x: Column, fill: str) -> Column:
        blank = F.repeat(F.lit(fill), end - start + F.col("gaps"))
        if reverse:
            return {"cut": F.substring(x, F.lit(1), start), "trim": F.substring(x, F.lit(1), end), "mask": F.concat(F.substring(x, F.lit(1), start), blank), "tag": x}[mode]
        return {"cut": F.substring(x, end + 1, n), "trim": F.substring(x, start + 1, n), "mask": F.concat(blank, F.substring(x, end + 1, n)), "tag": x}[mode]

    outside = F.substring(seq, end + 1, n) if reverse else F.substring(seq, F.lit(1), start)
    if barcode_length:
        outside = F.substring(outside, 1, barcode_length) if reverse else F.right(outside, F.least(F.lit(barcode_length), F.length(outside)))
    fields: dict[str, Column] = {"SEQORIENT": F.col("orient")} if orientation else {}
    fields[primer_field] = F.col("primer")
    if barcode:
        fields[barcode_field] = outside
    hit = F.col("primer").isNotNull()
    new_seq, new_qual = F.when(hit, part(seq, "N")).otherwise(F.col("seq")), F.when(hit, part(qual, "!")).otherwise(qual)
    ann = F.when(hit, A.add(F.col("ann"), fields)).otherwise(F.col("ann"))
    return matched.withColumns({"seq": new_seq, "qual": new_qual, "ann": ann}).withColumn("valid", F.col("valid") & (F.length("seq") > 0))


def pattern_of(primer: str) -> str:
    """Regular expression of an IUPAC sequence; N in a read matches no letter."""
    codes = {c: "".join(sorted(k for k, v in IUPAC.items() if set(v) <= set(b) and k != "N")) for c, b in IUPAC.items()}
    return "".join(c if len(IUPAC[c]) == 1 and c not in "TU" else f"[{codes[c]}]" for c in primer.upper())


def _codes(reads: list[str]) -> np.ndarray:
    """A row of letter codes a read, filled up with 0, which matches nothing."""
    width = max(map(len, reads), default=0)
    flat = np.frombuffer("".join(r.ljust(width, "\0") for r in reads).encode("ascii", "replace"), np.uint8).reshape(len(reads), width)
    return np.where(flat < 128, flat, 0)


def local_tables(codes: np.ndarray, primer: str, gap_open: float, gap_extend: float) -> tuple[np.ndarray, np.ndarray]:
    """(tables of best local scores (primer places, reads, read places), matches) of many reads at once: match 1, mismatch 0, gaps cost.

    A step goes over a primer letter for all reads and places: a gap along the read is a running maximum.
    """
    table = np.zeros((len(primer), 128), np.float32)
    for i, p in enumerate(primer):
        table[i, [ord(c) for c in S.PRIMER_MATCH[p]]] = 1
    (count, n), m = codes.shape, len(primer)
    hits, h = table[:, codes], np.zeros((m + 1, count, n + 1), np.float32)
    up = np.full((count, n + 1), -np.inf, np.float32)  # best ending in a gap that skips primer letters
    steps, first = np.arange(n + 1, dtype=np.float32) * gap_extend, np.zeros((count, 1), np.float32)
    for i in range(1, m + 1):
        up = np.maximum(up - gap_extend, h[i - 1] - gap_open)
        row = np.maximum(0, np.maximum(up, np.concatenate([first, h[i - 1, :, :-1] + hits[i - 1]], axis=1)))
        # a gap that skips read letters: the best of row[j'] - open - extend * (j - j' - 1)
        along = np.maximum.accumulate(row + steps, axis=1)[:, :-1] - gap_open + gap_extend - steps[1:]
        h[i] = np.maximum(row, np.concatenate([first, along], axis=1))
    return h, hits


def traced(h: np.ndarray, hits: np.ndarray, gap_open: float, gap_extend: float) -> tuple[float, int, int, int]:
    """(score, start, end, gaps) of the best alignment in one read's table; of ties the smallest end, then the longest."""
    best = float(h.max(initial=0))
    if best <= 0:
        return 0.0, 0, 0, 0
    j = int(np.flatnonzero((h == best).any(axis=0))[0])
    i = int(np.flatnonzero(h[:, j] == best)[-1])
    end, gaps, eps = j, 0, 1e-4
    h, hits = h.tolist(), hits.tolist()
    while i > 0 and j > 0 and h[i][j] > eps:
        if abs(h[i][j] - h[i - 1][j - 1] - hits[i - 1][j - 1]) < eps:
            i, j = i - 1, j - 1
            continue
        for k in range(1, max(i, j) + 1):
            cost = gap_open + gap_extend * (k - 1)
            if k <= i and abs(h[i - k][j] - cost - h[i][j]) < eps:
                i, gaps = i - k, gaps + k
                break
            if k <= j and abs(h[i][j - k] - cost - h[i][j]) < eps:
                j -= k
                break
        else:
            break
    while i > 0 and j > 0 and h[i][j] <= eps and hits[i - 1][j - 1] == 0 and h[i - 1][j - 1] <= eps:
        i, j = i - 1, j - 1
    return best, j, end, gaps


def local_align(read: str, primer: str, gap_open: float = 1, gap_extend: float = 1) -> tuple[float, int, int, int]:
    """(score, start, end, gaps) of the best local alignment of one read."""
    h, hits = local_tables(_codes([read]), primer, gap_open, gap_extend)
    return traced(h[:, 0], hits[:, 0], gap_open, gap_extend)


def _reverse_complement(seq: str) -> str:
    return seq.translate(str.maketrans(*COMPLEMENT))[::-1]


#: Cells of the score tables that are held at a time.
CELLS = 4_000_000


def best_local(regions: list[str], primers: dict[str, str], gap: tuple[float, float]) -> list[tuple[str | None, float, int, int, int]]:
    """(primer, error, start, end, gaps) of each region: the first primer of the smallest error, None if nothing matches."""
    out: list[tuple[str | None, float, int, int, int]] = []
    step = max(1, CELLS // ((max(map(len, regions), default=0) + 1) * (max(map(len, primers.values())) + 1)))
    for at in range(0, len(regions), step):
        codes = _codes(regions[at : at + step])
        best = [(None, 1.0, 0, 0, 0)] * len(codes)
        error = np.ones(len(codes))
        for name, primer in primers.items():
            h, hits = local_tables(codes, primer, *gap)
            new = 1 - h.max(axis=(0, 2)).astype(float) / len(primer)
            for r in np.flatnonzero(new < error).tolist():
                _, start, end, gaps = traced(h[:, r], hits[:, r], *gap)
                best[r] = (name, float(new[r]), start, end, gaps)
            error = np.minimum(error, new)
        out += best
    return out


def align_primers(reads: DataFrame, primers: dict[str, str], most_error: float = 0.2, most_length: int = 50, reverse: bool = False, skip_rc: bool = False, gap: tuple[float, float] = (1, 1)) -> DataFrame:
    """primer, error, p_start, p_end, gaps, orient (F or RC) and valid: the best local alignment near a read's beginning (reverse: its end).

    Reads that a primer fits exactly, as a pattern, are found natively; only the others go to a batched alignment, first as
    they are and, if that fits too badly, reverse complemented, in which case seq and qual are turned as well.
    """
    patterns = {k: pattern_of(v) for k, v in primers.items()}
    cols = reads.columns
    forward, turned = F.upper("seq"), S.reverse_complement(F.upper("seq"))

    def region(x: Column) -> Column:
        return F.right(x, F.least(F.length(x), F.lit(most_length))) if reverse else F.substring(x, 1, most_length)

    tries = []
    for orient, x in (("F", forward), ("RC", turned))[: 1 if skip_rc else 2]:
        for name, p in patterns.items():
            where = region(x)
            at = (F.regexp_instr(where, F.lit(p)) - 1 + (F.length(x) - F.length(where) if reverse else F.lit(0))).cast("int")
            tries.append(F.when(where.rlike(p), F.struct(F.lit(name).alias("primer"), F.lit(0.0).alias("error"), at.alias("p_start"), (at + len(primers[name])).alias("p_end"), F.lit(0).alias("gaps"), F.lit(orient).alias("orient"))))
    tried = reads.select(*cols, F.explode(F.array(F.coalesce(*tries))).alias("_exact"))  # sought once, however often it is used
    kind = "struct<primer:string,error:double,p_start:int,p_end:int,gaps:int,orient:string>"

    @F.pandas_udf(kind)
    def aligned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for seqs in batches:
            out: list[tuple | None] = [None] * len(seqs)
            left = [i for i, s in enumerate(seqs) if s is not None]
            for orient in "F" if skip_rc else ("F", "RC"):
                texts = [seqs.iloc[i] if orient == "F" else _reverse_complement(seqs.iloc[i]) for i in left]
                offsets = [max(0, len(s) - most_length) if reverse else 0 for s in texts]
                found = best_local([s[o:] if reverse else s[:most_length] for s, o in zip(texts, offsets, strict=True)], primers, gap)
                for i, o, (name, error, start, end, gaps) in zip(left, offsets, found, strict=True):
                    if out[i] is None or error < out[i][1]:
                        out[i] = (name, error, start + o, end + o, gaps, orient)
                left = [i for i in left if out[i][1] > most_error]
            yield pd.DataFrame([x or (None,) * 6 for x in out], columns=["primer", "error", "p_start", "p_end", "gaps", "orient"])

    both = tried.withColumn("_near", aligned(F.when(F.col("_exact").isNull(), F.upper("seq")))).withColumn("_hit", F.coalesce("_exact", "_near"))
    both = both.select(*cols, "_hit.*").withColumn("valid", (F.col("error") <= most_error) & F.col("primer").isNotNull())
    rc = F.col("orient") == "RC"
    return both.withColumns({"seq": F.when(rc, S.reverse_complement(F.upper("seq"))).otherwise(F.upper("seq")), "qual": F.when(rc, F.reverse("qual")).otherwise(F.col("qual"))})
