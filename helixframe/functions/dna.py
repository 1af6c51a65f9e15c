"""Column functions on DNA strings and position weight matrices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _letters(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def gc_fraction(seq: Column) -> Column:
    """The share of G and C among A, C, G and T; 0 if there are none. Case does not matter."""
    upper = F.upper(seq)
    known = _letters(upper, "ACGT")
    return F.when(known == 0, 0.0).otherwise(_letters(upper, "GC") / F.greatest(known, F.lit(1)))


def n_fraction(seq: Column) -> Column:
    """The share of letters other than A, C, G and T; 1 for an empty sequence."""
    size = F.length(seq)
    return F.when(size == 0, 1.0).otherwise((size - _letters(F.upper(seq), "ACGT")) / F.greatest(size, F.lit(1)))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def kmers(seq: Column, k: int) -> Column:
    """All words of k letters in order, ambiguous ones included; empty for shorter sequences."""
    last = F.length(seq) - (k - 1)
    words = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: seq.substr(i, F.lit(k)))
    return F.when(last >= 1, words).otherwise(F.array().cast("array<string>"))


def flipped_matrix(pwm: Column) -> Column:
    """The matrix of the reverse complement: rows from last to first, T G C A in place of A C G T."""
    return F.transform(F.reverse(pwm), lambda r: F.reverse(r))


def with_pseudocount(pwm: Column, sites: Column, pseudocount: float) -> Column:
    """(p * sites + c) / (sites + 4 c) for every entry; fails unless sites is positive."""
    n = F.when(sites > 0, sites.cast("double")).otherwise(F.raise_error(F.lit("the motif site count must be positive")).cast("double"))
    return F.transform(pwm, lambda r: F.transform(r, lambda p: (p * n + pseudocount) / (n + 4 * pseudocount)))


def log_or_minus_infinity(p: Column) -> Column:
    return F.when(p > 0, F.log(p)).otherwise(F.lit(float("-inf")))
