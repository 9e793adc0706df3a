"""Contig names: normalising, autosome numbers and the train/validation split."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# The pattern of a plain number or a numbered replicon accession, which no scaffold
# accession (NT_, NW_, GL000 and the like) matches.
NUMBER_PATTERN = "(?i)^(?:chr)?(?:NC_0*(?=[0-9]+(?:[.][0-9]+)?$)|(?=[0-9]+$))([0-9]+)"
LAST_AUTOSOME = 22


def normalize_chrom(chrom: Column) -> Column:
    """Give a contig name the ``chr`` prefix, folding the case of an existing one."""
    name = F.trim(chrom)
    prefixed = (F.length(name) > 3) & (F.lower(F.substring(name, 1, 3)) == "chr")
    return (
        F.when(name == "", name)
        .when(prefixed, F.concat(F.lit("chr"), F.substring(name, 4, 2**31 - 1)))
        .otherwise(F.concat(F.lit("chr"), name))
    )


def strip_chrom(chrom: Column) -> Column:
    """Remove a ``chr`` prefix of any case."""
    return F.regexp_replace(F.trim(chrom), "(?i)^chr", "")


def _number(chrom: Column) -> Column:
    """Number of a contig, NULL without one; one regular expression, as it runs on every row of a table."""
    return F.regexp_extract(F.trim(chrom), NUMBER_PATTERN, 1).try_cast("int")


def autosome_number(chrom: Column) -> Column:
    """Autosome index 1..22 of a contig name, NULL for anything else."""
    number = _number(chrom)
    return F.when(number.isin(*range(1, LAST_AUTOSOME + 1)), number)


def in_train_split(chrom: Column, train_range: tuple[int, int]) -> Column:
    """True when the contig is an autosome inside ``train_range``; never NULL."""
    low, high = sorted(train_range)
    # a list, as a range of two comparisons would search the name twice
    wanted = range(max(low, 1), min(high, LAST_AUTOSOME) + 1)
    return F.coalesce(_number(chrom).isin(*wanted), F.lit(False))
