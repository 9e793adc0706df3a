"""Mixing sources to target weights by Pfair scheduling.

A source's rows, in a fixed pseudo-random order, form blocks of ``block_rows``.  Block j of a source of
weight w may run from slot floor(j / w) and must have run by slot ceil((j + 1) / w);
earliest deadline first over the released blocks meets every deadline, so at each slot each
source is less than one block away from its share.  Weights are whole numbers of 1 / ``SCALE``, so the error of
rounding stays below a hundredth of a block over ten billion slots.

A phase ends at the slot where a source would have to give a block that it lacks.  The next phase goes on
with the targets of the sources that have blocks left, renormalised, and counts from its own
first slot; there is at most one phase per source.  What sources without a target have comes last, in
proportion to what is left, so that no row is dropped or repeated.  ``phase`` tells them apart.

The driver walks the schedule once, a step per block, and keeps where each stretch of ``period`` slots starts;
tasks walk the stretches again and write the slots, so the driver never holds the schedule.

Defined cases: a null source is a source of its own; a source without a target, or of
target 0, only appears in the last phase; null identifiers are ordered first and repeated rows
are separate rows; an empty table gives an empty result.  Other columns are carried,
whatever their names.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from endsight.llm.common import numbered, rows_out
from endsight.operators.scale import cut_lineage

#: Rows of a block, slots of a stretch, and the power of a source's size that is its default weight.
BLOCK_ROWS, PERIOD, FLATTEN = 16, 4096, 0.7
#: Weights are multiples of 1 over this.
SCALE = 1 << 40


def quotas(weights: list[float], period: int) -> list[int]:
    """Whole slots per period for each weight: largest remainders, at least 1 for a positive weight."""
    total = sum(weights)
    if total <= 0:
        return [0] * len(weights)
    exact = [w * period / total for w in weights]
    slots = [max(int(x), 1 if x > 0 else 0) for x in exact]
    by_rest = sorted(range(len(exact)), key=lambda i: (int(exact[i]) - exact[i], i))
    spare = period - sum(slots)
    for i in by_rest[: max(0, spare)]:
        slots[i] += exact[i] > 0
    while sum(slots) > period:  # many sources below one slot: the largest give way
        slots[max(range(len(slots)), key=lambda i: (slots[i], -i))] -= 1
    return slots


def walk(scale: int, sources: Iterable[tuple[int, int, int]], slot: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(slot, source, block, release, deadline) from ``slot`` on, by earliest deadline first, without end.

    ``sources`` has (source, weight, next block); a weight counts as its part of ``scale``.
    """

    def block(source: int, weight: int, j: int) -> tuple[int, int, int, int, int]:
        return j * scale // weight, -(-(j + 1) * scale // weight), source, j, weight

    waiting = [block(*x) for x in sources]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int, int]] = []
    for t in itertools.count(slot):
        while waiting and waiting[0][0] <= t:
            release, deadline, s, j, weight = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, j, release, weight))
        deadline, s, j, release, weight = heapq.heappop(ready)
        yield t, s, j, release, deadline
        heapq.heappush(waiting, block(s, weight, j + 1))


def one_period(slots: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(slot, source, block, release, deadline) of one period, by earliest deadline first."""
    period = sum(slots)
    return list(itertools.islice(walk(period, [(s, q, 0) for s, q in enumerate(slots) if q], 0), period))


_STRETCH = (
    "_phase int, _start bigint, _scale bigint, _from bigint, _to bigint, _sources array<int>, "
    "_weights array<bigint>, _next array<bigint>, _base array<bigint>"
)


def stretches(target: list[float], blocks: list[int], period: int) -> Iterator[tuple]:
    """Rows of ``_STRETCH``: where the walk stands at the first of every ``period`` slots of a phase.

    A stretch names only the sources that run in it: the others are never chosen there.
    """
    base, left, start = [0] * len(blocks), list(blocks), 0
    for phase in itertools.count(1):
        if not any(left):
            return
        wanted = [w if n else 0.0 for w, n in zip(target, left, strict=True)]
        weights, scale = (quotas(wanted, SCALE), SCALE) if sum(wanted) > 0 else (left, sum(left))
        used, first, since = [0] * len(blocks), {}, 0

        def stretch(until: int) -> tuple:
            names = sorted(first)
            columns = [[weights[s] for s in names], [first[s] for s in names], [base[s] for s in names]]
            return phase, start, scale, since, until, names, *columns

        for t, s, j, _, _ in walk(scale, [(s, w, 0) for s, w in enumerate(weights) if w], 0):
            if t - since == period or j == left[s]:
                if first:
                    yield stretch(t)
                first, since = {}, t
            if j == left[s]:
                break
            first.setdefault(s, j)
            used[s] = j + 1
        base = [b + u for b, u in zip(base, used, strict=True)]
        left = [n - u for n, u in zip(left, used, strict=True)]
        start += t


_PLACES = pa.schema(
    [("_place", pa.int32()), ("_number", pa.int64()), ("_phase", pa.int32())]
    + [(c, pa.int64()) for c in ("_release", "_deadline", "_slot")]
)


def places(row: dict) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(source, block, phase, release, deadline, slot) of every slot of a stretch."""
    base = dict(zip(row["_sources"], row["_base"], strict=True))
    sources = zip(row["_sources"], row["_weights"], row["_next"], strict=True)
    steps = itertools.islice(walk(row["_scale"], sources, row["_from"]), row["_to"] - row["_from"])
    start = row["_start"]
    for t, s, j, release, deadline in steps:
        yield s, base[s] + j, row["_phase"], start + release, start + deadline, start + t


def _place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from rows_out((x for batch in batches for row in batch.to_pylist() for x in places(row)), _PLACES)


def schedule(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
    *,
    block_rows: int = BLOCK_ROWS,
    period: int = PERIOD,
    seed: int = 0,
) -> DataFrame:
    """``_id, _source, _block, _phase, _release, _deadline, _slot`` of every row.

    The driver sees one count per source and walks one step per block; it holds no rows.
    """
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(source).cast("string").alias("_source"))
    shuffled = narrow.withColumn("_key", F.xxhash64(F.lit(seed), "_id"))
    rows = numbered(shuffled, [F.col("_key"), F.col("_id").asc_nulls_first()], ["_source"]).selectExpr(
        "_id", "_source", f"_row div {block_rows} as _block", "_rows"
    )
    sizes = rows.where("_block = 0").groupBy("_source").agg(F.max("_rows").alias("n")).collect()
    sizes = sorted(((r[0], r[1]) for r in sizes), key=lambda x: (x[0] is not None, x[0] or ""))
    spark = docs.sparkSession
    blocks = [-(-n // block_rows) for _, n in sizes]
    target = [float((weights or {}).get(s, 0.0)) if weights else n**FLATTEN for s, n in sizes]
    walked = spark.createDataFrame(list(stretches(target, blocks, period)), _STRETCH)
    planned = walked.mapInArrow(
        _place, "_place int, _number bigint, _phase int, _release bigint, _deadline bigint, _slot bigint"
    )
    names = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(sizes)], "_i int, _name string")
    named = rows.join(F.broadcast(names), F.expr("_source <=> _name"))
    placed = named.join(planned, F.expr("_i = _place and _block = _number"))
    return placed.select("_id", "_source", "_block", "_phase", "_release", "_deadline", "_slot")


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
    **options,
) -> DataFrame:
    """The rows of ``docs`` in the order of their slots: files and rows written from it follow it.

    Rows without an identifier, and rows equal in identifier and source, are numbered and take one of their slots each.
    """
    slots = cut_lineage(schedule(docs, weights, doc_id, source, **options).select("_id", "_source", "_slot"))
    first = (
        slots.where("_id is not null")
        .groupBy("_id", "_source")
        .agg(F.min("_slot").alias("_slot"), F.count(F.lit(1)).alias("_copies"))
    )
    rows = docs.alias("d").select(
        F.struct("d.*").alias("_doc"),
        F.col(f"d.{doc_id}").cast("bigint").alias("_own"),
        F.col(f"d.{source}").cast("string").alias("_own_source"),
    )
    joined = rows.where("_own is not null").join(first, F.expr("_own = _id and _own_source <=> _source"))
    several = joined.where("_copies > 1").select(*rows.columns).unionByName(rows.where("_own is null"))
    repeated = first.where("_copies > 1").select(F.col("_id").alias("_own"), F.col("_source").alias("_own_source"))
    theirs = (
        slots.where("_id is not null")
        .join(repeated, F.expr("_id = _own and _source <=> _own_source"), "left_semi")
        .unionByName(slots.where("_id is null"))
    )
    left = numbered(several, [F.col("_own")], ["_own", "_own_source"]).withColumnRenamed("_row", "_at")
    right = numbered(theirs, [F.col("_slot")], ["_id", "_source"]).drop("_rows")
    paired = left.join(right, F.expr("_at = _row and _own <=> _id and _own_source <=> _source"))
    placed = joined.where("_copies = 1").select("_doc", "_slot", "_own").unionByName(paired.select("_doc", "_slot", "_own"))
    return placed.repartitionByRange("_slot", "_own").sortWithinPartitions("_slot", "_own").select("_doc.*")
