"""Nucleotide sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 3-mers that become columns of the site feature table.
TRACKED_3MERS = (
    "ATG", "TAA", "TGA", "TAG", "GCC", "CGC", "GCG", "AAA",
    "TTT", "AAT", "GTG", "CAG", "GAG", "CCC", "GGG", "CCG",
)
BASES = ("A", "C", "G", "T")


def count_of(seq: Column, letters: str) -> Column:
    """Number of characters of ``seq`` that belong to ``letters``."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def longest_run(seq: Column, base: str) -> Column:
    """Length of the longest run of ``base``; 0 when absent."""
    runs = F.regexp_extract_all(seq, F.lit(f"({base}+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def kmers(seq: Column, k: int) -> Column:
    """The k-mers of ``seq`` made of A, T, G and C only, as an array.

    A look-ahead match consumes nothing, so overlapping words are found in one pass
    over the text.
    """
    return F.regexp_extract_all(seq, F.lit(f"(?=([ATGC]{{{k}}}))"), F.lit(1))


def reverse_complement(seq: Column) -> Column:
    """Reverse complement; every letter other than A, C, G, T becomes N."""
    known = F.regexp_replace(seq, "[^ACGT]", "N")
    return F.translate(F.reverse(known), "ACGT", "TGCA")
