"""Helpers that keep joins and ordered scans distributed whatever the key distribution.

``skew_join``       equi-join in which one key may dominate the larger side
``salt_hot_keys``   explicit splitting of such keys
``overlap_join``    points against intervals, bounded replication on both sides
``crowded_join``    the same for intervals that hold very many points
``ordered_scan``    running sums and neighbours over a global order, no single-task window
``cut_lineage``     reliable checkpoint in the cluster's shared folder
``written``         Parquet in that folder, for tables that several readers prune
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows of one join key that a single task may receive before the key is split.
ROWS_PER_SLICE = 2_000_000
# Interval levels: bits of the finest bin, bits added per level, number of levels.
BASE_BITS = 10
LEVEL_BITS = 2
LEVELS = 8
# Intervals narrower than WIDE meet lists of the points of bins of 2^CROWD_BITS places.
CROWD_BITS = 8
WIDE = 1 << 12


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named by ``spark.checkpoint.dir``, or the session's own."""
    context = spark.sparkContext
    shared = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return shared.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint and return the materialised rows."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, so that several readers prune columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _engine_splits_skew(df: DataFrame) -> bool:
    conf = df.sparkSession.conf
    return all(
        conf.get(name, "true").lower() == "true"
        for name in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    )


def salt_hot_keys(
    big: DataFrame, small: DataFrame, keys: Sequence[str], *, rows_per_slice: int = ROWS_PER_SLICE
) -> tuple[DataFrame, DataFrame]:
    """Add a ``_slice`` column so that both sides can be joined on ``keys + [_slice]``.

    Rows of ``big`` under a hot key are spread over ``n`` slices by a hash of the
    row; rows of ``small`` under that key are repeated ``n`` times.  All other rows
    keep slice 0.  The list of hot keys has at most ``rows(big) / rows_per_slice`` entries,
    because every entry stands for more than ``rows_per_slice`` rows; the planner decides
    by its size whether to broadcast it.
    """
    hot = (
        big.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(f"_rows > {rows_per_slice}")
        .selectExpr(*keys, f"int(ceil(_rows / {rows_per_slice})) as _slices")
    )
    hashed = F.xxhash64(*big.columns)
    salted = (
        big.join(hot, list(keys), "left")
        .withColumn("_hash", hashed)
        .selectExpr(*big.columns, "int(coalesce(pmod(_hash, _slices), 0)) as _slice")
    )
    repeated = small.join(hot, list(keys), "left").selectExpr(
        *small.columns, "explode(sequence(0, coalesce(_slices, 1) - 1)) as _slice"
    )
    return salted, repeated


def skew_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join in which one key may hold a large share of ``big``.

    With adaptive skew-join handling on (Spark's default) the engine cuts oversized
    partitions of ``big`` and repeats the matching ones of ``small`` at run time, at no
    cost when nothing is skewed.  Where that is switched off, hot keys are salted.
    ``how`` is ``inner`` or ``left``; ``small`` must fit the key's share in one task.
    """
    if _engine_splits_skew(big):
        return big.join(small, list(keys), how)
    salted, repeated = salt_hot_keys(big, small, keys)
    return salted.join(repeated, [*keys, "_slice"], how).drop("_slice")


def overlap_join(
    points: DataFrame,
    spans: DataFrame,
    *,
    on: Sequence[str],
    point: str,
    low: str,
    high: str,
) -> DataFrame:
    """Inner join of ``points`` with ``spans`` where ``low <= point <= high``.

    ``low`` and ``high`` are SQL expressions over ``spans``.  A span lives on the
    finest level whose bins are at least as wide as itself, so it touches at most two
    bins; only spans wider than the last level's bins touch more, and they are
    repeated exactly as often as needed.  A point is placed once per level.  The
    equi-join key is (``on``, level, bin); the residual range test makes the result
    exact, and as a point has one bin per level, every pair appears once.
    """
    # bins are powers of two: level i has width 2^(BASE_BITS + LEVEL_BITS * i)
    steps = " ".join(
        f"when _high - _low < {1 << (BASE_BITS + LEVEL_BITS * i)} then {i}" for i in range(LEVELS - 1)
    )
    shift = f"{BASE_BITS} + {LEVEL_BITS} * _level"
    placed_spans = (
        spans.selectExpr("*", f"{low} as _low", f"{high} as _high")
        .selectExpr("*", f"case {steps} else {LEVELS - 1} end as _level")
        .selectExpr(
            "*",
            f"explode(sequence(shiftright(_low, {shift}), shiftright(_high, {shift}))) as _bin",
        )
    )
    levels = ", ".join(str(i) for i in range(LEVELS))
    placed_points = points.selectExpr("*", f"explode(array({levels})) as _level").selectExpr(
        "*", f"shiftright({point}, {shift}) as _bin"
    )
    keys = [*on, "_level", "_bin"]
    joined = skew_join(placed_spans, placed_points, keys, "inner")
    return joined.where(f"{point} between _low and _high").drop("_level", "_bin", "_low", "_high")


def crowded_join(points: DataFrame, spans: DataFrame, *, on: Sequence[str], point: str, low: str, high: str) -> DataFrame:
    """:func:`overlap_join` where nearly all work is in the pairs themselves; ``points`` are distinct rows.

    A narrow span meets the points of the few fine bins it touches as one list each, which is
    unfolded and tested at once, so spans are not sorted and at most about two candidates are looked at per pair.
    The list of a bin is bounded by its width times the rows of one place.  Wider spans take :func:`overlap_join`.
    """
    others = [c for c in points.columns if c not in on]
    lists = points.groupBy(*on, F.expr(f"shiftright({point}, {CROWD_BITS})").alias("_bin")).agg(
        F.collect_list(F.struct(*others)).alias("_points")
    )
    narrow = spans.where(f"({high}) - ({low}) < {WIDE}").selectExpr(
        "*", f"explode(sequence(shiftright({low}, {CROWD_BITS}), shiftright({high}, {CROWD_BITS}))) as _bin"
    )
    unfolded = skew_join(narrow, lists.hint("shuffle_hash"), [*on, "_bin"], "inner").selectExpr(
        *spans.columns, "inline(_points)"
    )
    pairs = unfolded.where(f"{point} between ({low}) and ({high})")
    wide = spans.where(f"({high}) - ({low}) >= {WIDE}")
    return pairs.unionByName(overlap_join(points, wide, on=on, point=point, low=low, high=high))


def ordered_scan(
    df: DataFrame,
    *,
    group: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Running values over ``order`` within ``group`` without one task per group.

    For each entry of ``sums`` the result gains ``run_<name>`` (sum of all rows up to
    and including this one) and ``all_<name>`` (sum over the group); for each entry of
    ``previous`` it gains ``prev_<name>`` (value of the row before, NULL for the first).
    ``order`` must be total within a group.

    The rows are range-partitioned by (group, order) into blocks, materialised once so
    that both uses below see the same blocks, scanned block by block, and corrected by
    the totals of the preceding blocks (one row per block and group).
    """
    sums, previous = dict(sums or {}), dict(previous or {})
    keys = list(group)
    valued = df.withColumns(
        {f"_v_{n}": e for n, e in sums.items()} | {f"_p_{n}": e for n, e in previous.items()}
    )
    blocks = cut_lineage(
        valued.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(
            "_block", F.spark_partition_id()
        )
    )
    in_block = Window.partitionBy("_block", *keys).orderBy(*order)
    up_to_here = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = blocks.withColumns(
        {"_rn": F.row_number().over(in_block)}
        | {f"_r_{n}": F.sum(f"_v_{n}").over(up_to_here) for n in sums}
        | {f"_l_{n}": F.lag(f"_p_{n}").over(in_block) for n in previous}
    )
    ends = local.groupBy("_block", *keys).agg(
        F.max("_rn").alias("_n"),
        *[F.max_by(f"_r_{n}", "_rn").alias(f"_t_{n}") for n in sums],
        *[F.max_by(F.struct(f"_p_{n}"), "_rn").alias(f"_e_{n}") for n in previous],
    )
    over_blocks = Window.partitionBy(*keys).orderBy("_block")
    before = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = ends.select(
        "_block",
        *keys,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(whole).alias(f"all_{n}") for n in sums],
        *[F.lag(f"_e_{n}").over(over_blocks)[f"_p_{n}"].alias(f"_b_{n}") for n in previous],
    )
    # null-safe, for rows whose group is NULL
    other = carried.select(
        F.col("_block").alias("_k"), *[F.col(k).alias(f"_k_{k}") for k in keys], *carried.columns[1 + len(keys) :]
    )
    same = F.col("_block") == F.col("_k")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(other, same, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_r_{n}") + F.col(f"_c_{n}")).alias(f"run_{n}") for n in sums],
        *[F.col(f"all_{n}") for n in sums],
        *[
            F.when(F.col("_rn") == 1, F.col(f"_b_{n}")).otherwise(F.col(f"_l_{n}")).alias(f"prev_{n}")
            for n in previous
        ],
    )
