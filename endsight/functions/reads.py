"""Alignment records: strand, CIGAR and soft clips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# CIGAR letters in operation-code order, and the codes that consume the reference.
CIGAR_LETTERS = "MIDNSHP=X"
REFERENCE_OPS = (0, 2, 3, 7, 8)
SPLICE_OP = 3
SOFT_CLIP_OP = 4


def parse_cigar(text: Column) -> Column:
    """CIGAR text as ``array<struct<op int, len int>>``; NULL for ``*`` or empty text."""
    lengths = F.regexp_extract_all(text, F.lit(f"([0-9]+)([{CIGAR_LETTERS}])"), F.lit(1))
    letters = F.regexp_extract_all(text, F.lit(f"([0-9]+)([{CIGAR_LETTERS}])"), F.lit(2))
    ops = F.zip_with(
        letters,
        lengths,
        lambda o, n: F.struct(
            (F.instr(F.lit(CIGAR_LETTERS), o) - 1).cast("int").alias("op"),
            n.cast("int").alias("len"),
        ),
    )
    return F.when(F.size(ops) > 0, ops)


def reference_span(cigar: Column) -> Column:
    """Reference bases covered by a parsed CIGAR."""
    return F.aggregate(
        cigar,
        F.lit(0).cast("bigint"),
        lambda acc, c: acc + F.when(c["op"].isin(*REFERENCE_OPS), c["len"]).otherwise(0),
    )


def read_strand(ts: Column, is_reverse: Column) -> Column:
    """Transcription strand: the ``ts`` tag flipped by orientation, or orientation alone."""
    flipped = F.when((ts == "+") == is_reverse, F.lit("-")).otherwise(F.lit("+"))
    return (
        F.when(ts.isNull(), F.when(is_reverse, F.lit("-")).otherwise(F.lit("+")))
        .when(ts.isin("+", "-"), flipped)
        .otherwise(F.lit("."))
    )


def _clip(cigar: Column, at: int) -> Column:
    op = F.try_element_at(cigar, F.lit(at))
    return F.when(op["op"] == SOFT_CLIP_OP, op["len"]).otherwise(0)


def left_clip_length(cigar: Column) -> Column:
    return _clip(cigar, 1)


def right_clip_length(cigar: Column) -> Column:
    return _clip(cigar, -1)


def left_clip_text(cigar: Column) -> Column:
    """Left clip length straight from CIGAR text."""
    return F.regexp_extract(cigar, "^([0-9]+)S", 1).try_cast("int")


def right_clip_text(cigar: Column) -> Column:
    """Right clip length straight from CIGAR text."""
    return F.regexp_extract(cigar, "([0-9]+)S$", 1).try_cast("int")


def splice_boundaries(cigar: Column, ref_start: Column) -> Column:
    """Positions where introns start and end.

    The running position advances by the length of every operation, clips and
    insertions included.
    """
    walked = F.aggregate(
        cigar,
        F.struct(
            ref_start.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("found")
        ),
        lambda acc, c: F.struct(
            (acc["at"] + c["len"]).alias("at"),
            F.when(
                c["op"] == SPLICE_OP,
                F.concat(acc["found"], F.array(acc["at"], acc["at"] + c["len"])),
            )
            .otherwise(acc["found"])
            .alias("found"),
        ),
    )
    return F.coalesce(walked["found"], F.array().cast("array<bigint>"))
