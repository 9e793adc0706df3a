"""Candidate start/end sites and their labels against a reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from endsight.functions.contigs import normalize_chrom
from endsight.operators.scale import skew_join

# Default label tolerance and the id prefix of transcripts added to a reference.
LABEL_TOLERANCE = 50
NOVEL_PREFIX = "NOVEL_TX_"
SITE_TYPES = ("TSS", "TES")
BIN = 1_024
# Bins that one task scans for the nearest position outside a bin.
BLOCK = 1_024


def oriented_strands(strand: Column) -> Column:
    """Strands a row stands for: itself, both for ``.``, none for anything else."""
    return (
        F.when(strand.isin("+", "-"), F.array(strand))
        .when(strand == ".", F.array(F.lit("+"), F.lit("-")))
        .otherwise(F.array().cast("array<string>"))
    )


def end_positions(strand: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """(start site, end site) of a transcript: ``start+1`` and ``end`` in strand order."""
    forward = strand == "+"
    return F.when(forward, start + 1).otherwise(end), F.when(forward, end).otherwise(start + 1)


def candidate_sites(
    transcripts: DataFrame, *, start: str = "start", end: str = "end", keep: Sequence[str] = ()
) -> DataFrame:
    """One row per transcript end; transcripts of unknown strand give both readings."""
    oriented = transcripts.withColumn("_s", F.explode(oriented_strands(F.col("strand"))))
    tss, tes = end_positions(F.col("_s"), F.col(start), F.col(end))
    site = F.explode(
        F.array(
            F.struct(F.lit("TSS").alias("site_type"), tss.alias("position")),
            F.struct(F.lit("TES").alias("site_type"), tes.alias("position")),
        )
    )
    return oriented.select(*keep, "transcript_id", "chrom", F.col("_s").alias("strand"), site.alias("_e")).select(
        *keep, "transcript_id", "_e.site_type", "chrom", "_e.position", "strand"
    )


def site_counts(transcripts: DataFrame, *, start: str = "start", end: str = "end") -> DataFrame:
    """Transcripts per strand at each end coordinate; unknown strands are left out."""
    known = transcripts.where(F.col("strand").isin("+", "-"))
    return (
        candidate_sites(known, start=start, end=end)
        .groupBy("site_type", "chrom", "position")
        .agg(
            F.count_if(F.col("strand") == "+").alias("plus"),
            F.count_if(F.col("strand") == "-").alias("minus"),
        )
    )


def strand_by_majority(counts: DataFrame, *, tie: str = "both") -> DataFrame:
    """Sites with the majority strand; a tie gives two rows, or ``-`` with ``tie='-'``."""
    if tie not in ("both", "-"):
        raise ValueError("tie must be 'both' or '-'")
    if tie == "-":
        strand = F.when(F.col("plus") > F.col("minus"), F.lit("+")).otherwise(F.lit("-"))
    else:
        strand = F.explode(
            F.when(F.col("plus") > F.col("minus"), F.array(F.lit("+")))
            .when(F.col("plus") < F.col("minus"), F.array(F.lit("-")))
            .otherwise(F.array(F.lit("+"), F.lit("-")))
        )
    return counts.select("site_type", "chrom", "position", strand.alias("strand"))


def site_id(chrom: str = "chrom", position: str = "position") -> Column:
    """``chrom:position:strand:type``."""
    return F.concat_ws(":", chrom, F.col(position).cast("string"), "strand", "site_type")


def is_novel(identifier: Column) -> Column:
    return F.coalesce(identifier.startswith(NOVEL_PREFIX), F.lit(False))


def _binned_reference(reference: DataFrame, tolerance: int) -> DataFrame:
    """Distinct reference positions gathered per bin, each also in the bins it can reach.

    An array holds distinct integers of one bin and its margins, so it never exceeds
    ``BIN + 2 * tolerance`` values whatever the size of the reference.
    """
    return (
        reference.select(
            F.upper("site_type").alias("_type"),
            normalize_chrom(F.col("chrom")).alias("_chrom"),
            F.col("strand").alias("_strand"),
            F.col("position").cast("bigint").alias("_ref"),
        )
        .withColumn(
            "_bin",
            F.explode(
                F.sequence(
                    F.floor((F.col("_ref") - tolerance) / BIN), F.floor((F.col("_ref") + tolerance) / BIN)
                )
            ),
        )
        .groupBy("_type", "_chrom", "_strand", "_bin")
        .agg(F.collect_set("_ref").alias("_refs"))
    )


_LABEL_KEYS = ("_type", "_chrom", "_strand", "_bin")


def _with_label_keys(sites: DataFrame) -> DataFrame:
    return sites.withColumns(
        {
            "_type": F.upper("site_type"),
            "_chrom": normalize_chrom(F.col("chrom")),
            "_strand": F.col("strand"),
            "_bin": F.floor(F.col("position") / BIN),
        }
    )


def proximity_label(
    sites: DataFrame,
    reference: DataFrame,
    *,
    tolerance: int = LABEL_TOLERANCE,
    label: str = "label",
) -> DataFrame:
    """``label`` = 1 when a reference site of the same type, contig and strand is within ``tolerance``.

    A site row meets at most one reference row (the array of its bin), so the join
    never multiplies rows; bins with very many sites are split.
    """
    keyed = _with_label_keys(sites)
    joined = skew_join(keyed, _binned_reference(reference, tolerance), _LABEL_KEYS)
    near = F.exists("_refs", lambda r: F.abs(r - F.col("position")) <= tolerance)
    return joined.select(*sites.columns, F.coalesce(near, F.lit(False)).cast("int").alias(label))


def novel_reference(reference: DataFrame) -> DataFrame:
    """Reference sites of transcripts that were added as novel."""
    return reference.where(is_novel(F.col("transcript_id")))


def novel_label(sites: DataFrame, reference: DataFrame, *, tolerance: int = LABEL_TOLERANCE) -> DataFrame:
    """Proximity label against the novel part of the reference only."""
    return proximity_label(
        sites, novel_reference(reference), tolerance=tolerance, label="novel_label"
    )


def _bin_edges(bins: DataFrame, filled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For every row of ``bins`` (keys, _bin) the last position of the filled bins before it and the first of those after it.

    Blocks of ``BLOCK`` bins are scanned each by itself; what a block hands to the others is one row with its first
    and last position, so the scan along a contig has one row per block (a million positions), not per bin.
    """
    block = F.floor(F.col("_bin") / BLOCK).alias("_block")
    rows = bins.join(filled, [*keys, "_bin"], "full").select(*keys, "_bin", block, "_first", "_last")
    totals = rows.groupBy(*keys, "_block").agg(F.min("_first").alias("_low"), F.max("_last").alias("_high"))
    along = Window.partitionBy(*keys).orderBy("_block")
    carried = totals.select(
        *keys,
        "_block",
        F.max("_high").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.min("_low").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("_bin")
    return skew_join(rows, carried, [*keys, "_block"]).select(
        *keys,
        "_bin",
        F.coalesce(F.max("_last").over(inside.rowsBetween(Window.unboundedPreceding, -1)), "_before").alias("_below"),
        F.coalesce(F.min("_first").over(inside.rowsBetween(1, Window.unboundedFollowing)), "_after").alias("_above"),
    )


def nearest_reference(
    sites: DataFrame,
    reference: DataFrame,
    *,
    tolerance: int = LABEL_TOLERANCE,
    order: str | None = None,
) -> DataFrame:
    """Closest reference position of the same type, contig and strand, and the tolerance label.

    Of two equally close positions the one with the smaller ``order`` value wins, or
    the lower position when no order column is given.  Without any reference the
    position and the label are 0.

    Positions are grouped per bin (at most ``BIN`` distinct values each); the nearest
    position outside the bin comes from the first and last position of each bin (see ``_bin_edges``).
    """
    keys = ["_type", "_chrom", "_strand"]
    rank = F.col(order) if order else F.col("position")
    ref = reference.select(
        F.upper("site_type").alias("_type"),
        normalize_chrom(F.col("chrom")).alias("_chrom"),
        F.col("strand").alias("_strand"),
        F.col("position").cast("bigint").alias("pos"),
        rank.cast("bigint").alias("ord"),
    )
    distinct = ref.groupBy(*keys, "pos").agg(F.min("ord").alias("ord"))
    per_bin = (
        distinct.withColumns({"_bin": F.floor(F.col("pos") / BIN), "_ref": F.struct("pos", "ord")})
        .groupBy(*keys, "_bin")
        .agg(
            F.collect_list("_ref").alias("_refs"),
            F.min("_ref").alias("_first"),
            F.max("_ref").alias("_last"),
        )
    )
    keyed = _with_label_keys(sites)
    edges = _bin_edges(keyed.select(*keys, "_bin").distinct(), per_bin.select(*keys, "_bin", "_first", "_last"), keys)
    near = skew_join(keyed, edges, [*keys, "_bin"])
    joined = skew_join(near, per_bin.select(*keys, "_bin", "_refs"), [*keys, "_bin"])
    choices = F.concat(
        F.coalesce("_refs", F.array().cast("array<struct<pos:bigint,ord:bigint>>")),
        F.array("_below", "_above"),
    )
    best = F.array_min(
        F.transform(
            F.filter(choices, lambda c: c.isNotNull()),
            lambda c: F.struct(
                F.abs(c["pos"] - F.col("position")).alias("gap"),
                c["ord"].alias("ord"),
                c["pos"].alias("pos"),
            ),
        )
    )
    return joined.withColumn("_best", best).select(
        *sites.columns,
        F.coalesce("_best.pos", F.lit(0)).cast("bigint").alias("closest_ref_position"),
        F.coalesce(F.col("_best.gap") <= tolerance, F.lit(False)).cast("int").alias("label"),
    )


def set_overlap(
    first: DataFrame,
    second: DataFrame,
    *,
    by: Sequence[str] = ("site_type",),
    tolerance: int = LABEL_TOLERANCE,
    symmetric: bool = False,
) -> DataFrame:
    """Sites of two sets found in one or both, as counts and shares per ``by`` key.

    ``both`` counts sites of ``first`` near a site of ``second``.  The sites only in
    ``second`` are those whose exact coordinate is absent from ``first``; with
    ``symmetric`` they are those with no neighbour in ``first``.
    """
    cols = list(dict.fromkeys([*by, "site_type", "chrom", "position", "strand"]))
    a, b = first.select(*cols).distinct(), second.select(*cols).distinct()
    near_a = proximity_label(a, b, tolerance=tolerance, label="hit")
    if symmetric:
        near_b = proximity_label(b, a, tolerance=tolerance, label="hit")
    else:
        near_b = b.join(a.withColumn("hit", F.lit(1)), cols, "left").withColumn(
            "hit", F.coalesce("hit", F.lit(0))
        )
    marked = near_a.withColumn("side", F.lit(1)).unionByName(near_b.withColumn("side", F.lit(2)))
    counts = marked.groupBy(*by).agg(
        F.count_if((F.col("side") == 1) & (F.col("hit") == 0)).alias("only_first"),
        F.count_if((F.col("side") == 2) & (F.col("hit") == 0)).alias("only_second"),
        F.count_if((F.col("side") == 1) & (F.col("hit") == 1)).alias("both"),
    )
    total = F.col("only_first") + F.col("only_second") + F.col("both")

    def share(name: str) -> Column:
        return F.coalesce(F.round(F.try_divide(F.col(name) * 100.0, total), 6), F.lit(0.0)).alias(
            f"{name}_pct"
        )

    return counts.select(
        *by,
        "only_first",
        "only_second",
        "both",
        share("only_first"),
        share("only_second"),
        share("both"),
        total.alias("total"),
    )


def label_stats(labeled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and percentages of true and false sites per key."""
    counts = labeled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_candidates"),
        F.count_if(F.col("label") == 1).alias("true_sites"),
        F.count_if(F.col("label") == 0).alias("false_sites"),
    )
    return _with_shares(counts)


def label_stats_rollup(stats: DataFrame, keys: Sequence[str], tool: str = "assembler") -> DataFrame:
    """Roll tool-level counts up to ``keys`` with the sorted list of distinct tools."""
    rolled = stats.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set(tool)), ", ").alias("assemblers"),
        F.sum("total_candidates").alias("total_candidates"),
        F.sum("true_sites").alias("true_sites"),
        F.sum("false_sites").alias("false_sites"),
    )
    return _with_shares(rolled)


def _with_shares(counts: DataFrame) -> DataFrame:
    def share(name: str) -> Column:
        ratio = F.try_divide(F.col(name) * 100.0, F.col("total_candidates"))
        return F.coalesce(F.round(ratio, 2), F.lit(0.0))

    return counts.withColumns(
        {"true_percentage": share("true_sites"), "false_percentage": share("false_sites")}
    )
