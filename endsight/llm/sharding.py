"""Reproducible shuffle into shards: a Feistel permutation of the global row number.

Rows are numbered 0..N-1 by (identifier, hash of the text).  The number is written as a pair of digits
(left, right) in the mixed radix a x b, with a the ceiling of the square root of N and
b = ceil(N / a); each round adds a keyed hash (MD5, so that any engine can repeat it) of one digit to the other, so every round
can be undone and the whole is a permutation of 0..a*b-1.  Numbers that land beyond N
walk on along their cycle until they fall below it; fewer than a of them start there.
The place p so found gives shard p % shards and slot p // shards: shard sizes differ by
at most one row, slots have no gaps, and anyone with the row number can compute both.

Defined cases: a null text has size 1 and the checksum of no bytes; null identifiers come
first; rows equal in identifier and text are interchangeable.  Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from endsight.llm.common import keyed, numbered

ROUNDS = 6
#: Steps of a cycle that are tried; a walk is longer with a chance of under N ** -16.
WALK = 32


def feistel(value: str, left: str, right: str, *, seed: int = 0, rounds: int = ROUNDS) -> str:
    """SQL for one application of the permutation of 0..left*right-1 to ``value``."""
    pair = f"named_struct('l', {value} div {right}, 'r', {value} % {right})"

    def keyed_hash(digit: str) -> str:
        return f"bigint(conv(substr(md5(concat_ws(':', {seed}, i, {digit})), 1, 12), 16, 10))"

    step = (
        f"if(i % 2 = 0, named_struct('l', (s.l + {keyed_hash('s.r')}) % {left}, 'r', s.r), "
        f"named_struct('l', s.l, 'r', (s.r + {keyed_hash('s.l')}) % {right}))"
    )
    return f"aggregate(sequence(0, {rounds - 1}), {pair}, (s, i) -> {step}, s -> s.l * {right} + s.r)"


def permuted(row: str, rows: str, *, seed: int = 0) -> Column:
    """Place of row number ``row`` among ``rows`` rows; both are SQL over bigint columns."""
    left = f"bigint(greatest(1, ceil(sqrt({rows}))))"
    right = f"bigint(greatest(1, ceil({rows} / {left})))"
    walk = feistel("x", left, right, seed=seed)
    return F.expr(
        f"aggregate(sequence(0, {WALK}), {row}, (x, k) -> if(k > 0 and x < {rows}, x, {walk}), "
        f"x -> if(x < {rows}, x, bigint(raise_error('cycle walk too long'))))"
    )


def assign_shards(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, shards: int = 8, seed: int = 0
) -> DataFrame:
    """``_id, _size, _crc, _row, _rows`` and the computed ``_shard`` and ``_slot`` of every row."""
    narrow = keyed(docs, doc_id, text).selectExpr(
        "_id",
        "coalesce(octet_length(_text), 0) + 1L as _size",
        "crc32(coalesce(_text, '')) as _crc",
        "xxhash64(_text) as _hash",
    )
    rows = numbered(narrow, [F.col("_id").asc_nulls_first(), F.col("_hash"), F.col("_size"), F.col("_crc")])
    placed = rows.withColumn("_spot", permuted("_row", "_rows", seed=seed))
    return placed.selectExpr(
        "_id", "_size", "_crc", "_row", "_rows", f"int(_spot % {shards}) as _shard", f"_spot div {shards} as _slot"
    )
