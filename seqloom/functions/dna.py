"""Column functions over DNA strings: complements, 1-based slices, letter counts.

Coordinates are 1-based and closed.  A base of a probe matches a base of a genome if they
are equal, or if the probe has ``c`` and the genome ``t``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "acgt"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_dna(text: Column | str) -> Column:
    """The letters ``acgt`` of a text, lower-cased; all other characters go."""
    return F.regexp_replace(F.lower(_col(text)), "[^acgt]", "")


def complement(dna: Column | str) -> Column:
    """Complement of each lower-case base; other characters are dropped."""
    return F.translate(F.regexp_replace(_col(dna), "[^acgt]", ""), "acgt", "tgca")


def reverse_complement(dna: Column | str) -> Column:
    return F.reverse(complement(dna))


def subsequence(dna: Column | str, left: Column | str, right: Column | str) -> Column:
    """Bases ``left`` to ``right``, clipped to the sequence; empty if right is before left."""
    a, b = F.greatest(_col(left), F.lit(1)), _col(right)
    return F.substring(_col(dna), a.cast("int"), F.greatest(b - a + 1, F.lit(0)).cast("int"))


def strand_of(start: Column | str, end: Column | str, equal: str = "-") -> Column:
    """``+`` where start is before end, ``-`` where after, ``equal`` where they are equal."""
    a, b = _col(start), _col(end)
    return F.when(a < b, "+").when(a > b, "-").otherwise(equal)


def oriented(dna: Column | str, start: Column | str, end: Column | str) -> Column:
    """Bases between two positions; reverse complement where start is after end."""
    a, b = _col(start), _col(end)
    forward = subsequence(dna, F.least(a, b), F.greatest(a, b))
    return F.when(a <= b, forward).otherwise(reverse_complement(forward))


def letter_count(dna: Column | str, letter: str) -> Column:
    c = _col(dna)
    return F.length(c) - F.length(F.replace(c, F.lit(letter), F.lit("")))


def composition_overlap(a: Column | str, b: Column | str) -> Column:
    """Size of the multiset intersection of the letters acgt of two sequences."""
    parts = [F.least(letter_count(a, x), letter_count(b, x)) for x in LETTERS]
    return sum(parts[1:], parts[0])


def can_skip(probe: Column | str, window: Column | str, least: int, pattern: str | None = None) -> Column:
    """True where a window need not be scored: too few common letters, or no match of ``pattern``.

    Safe for symmetric matching only: ``c`` matching ``t`` isn't counted.
    """
    few = composition_overlap(F.lower(_col(probe)), F.lower(_col(window))) < least
    if pattern is None:
        return few
    return few | ~_col(window).rlike(f"^(?:{pattern})")


def odd_letters(seq: Column | str, alphabet: str = "AUCG") -> Column:
    """Distinct letters of a sequence (upper-cased) outside an alphabet, sorted."""
    letters = F.split(F.regexp_replace(F.upper(F.trim(_col(seq))), f"[{alphabet}]", ""), "")
    return F.array_sort(F.array_distinct(F.filter(letters, lambda x: x != "")))


def is_strict(seq: Column | str, alphabet: str = "AUCG") -> Column:
    return F.upper(F.trim(_col(seq))).rlike(f"^[{alphabet}]*$")
