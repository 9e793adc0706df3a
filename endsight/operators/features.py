"""Numeric features of candidate sites from the reads around them.

Plan
----
1. Reads are reduced to *spans*: one row per distinct (contig, start, end, strand)
   with the sums of qualities, clips and introns.  A locus sequenced a million times
   deeper adds to the sums, not to the number of joined rows.
2. Distinct site coordinates are joined with the spans that overlap their window
   (:func:`~endsight.operators.scale.crowded_join`).
3. All features are sums, extremes or small histograms, so Spark combines them
   map-side before the shuffle on the site; no task ever holds the reads of a site.
4. Clip sequences are summed per clip position first (at most 4^k counts each) and
   then added up over the few positions near a site.

The whole table (:func:`coordinate_features`) parses the reads once into a narrow written
table and joins them with the sites once: every site keeps small histograms of starts,
ends and clip lengths (:func:`site_histograms`), from which all its features follow.

Expressions with many terms are written as SQL text; they plan faster than the same
tree built column by column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from endsight.functions import reads as R
from endsight.functions import sequences as Q
from endsight.operators.clip_profile import clip_profile
from endsight.operators.profile import PARTS, columns_of, site_profile
from endsight.operators.scale import crowded_join, overlap_join, skew_join, written

SITE = ("chrom", "position", "strand")
SPAN = ("chrom", "ref_start", "ref_end", "read_strand")


@dataclass(frozen=True)
class FeatureConfig:
    """Windows in bp, quality cut and k-mer sizes."""

    window_size: int = 100
    density_window: int = 100
    coverage_window: int = 100
    soft_clip_window: int = 10
    min_mapq: int = 10
    splice_site_window: int = 300
    gradient_analysis_range: int = 100
    extended_window: int = 1000
    k_values: tuple[int, ...] = (3,)
    legacy_columns: bool = False

    def __post_init__(self) -> None:
        if self.soft_clip_window >= self.window_size:
            raise ValueError("soft_clip_window must be smaller than window_size")

    @property
    def reach(self) -> int:
        """Half width of the window in which reads can contribute."""
        fetch = max(self.extended_window, self.window_size)
        return max(self.window_size, min(self.coverage_window, fetch))


# The step of the coverage grid, the near distance, the start bins of the
# degradation slope and the column order of the feature table.
GRID_STEP = 10
NEAR = 5
SLOPE_REACH = 50
BASIC_COLUMNS = (
    "total_reads", "read_start_density", "read_end_density",
    "start_soft_clip_mean", "end_soft_clip_mean", "start_soft_clip_max", "end_soft_clip_max",
    "start_soft_clip_median", "end_soft_clip_median", "start_soft_clip_count", "end_soft_clip_count",
    "mean_mapq", "std_mapq", "strand_ratio", "coverage_before", "coverage_after", "delta_coverage",
    "nearest_splice_dist", "softclip_bias", "start_entropy", "end_entropy",
    "coverage_gradient_sharpness", "max_coverage_gradient", "local_avg_coverage",
    "avg_clip_length", "max_clip_length", "num_clips",
)


def usable_reads(reads: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Mapped reads of sufficient quality with strand, clips and introns resolved.

    ``reads`` has ``chrom, ref_start, ref_end, mapq, is_reverse, ts, cigar, seq`` and
    optionally ``is_unmapped``; ``cigar`` may be text or parsed.  Text is searched for
    its end clips and only parsed in full when it contains an intron.
    """
    kept = reads.where(f"ref_end is not null and mapq >= {cfg.min_mapq}")
    if "is_unmapped" in reads.columns:
        kept = kept.where("not coalesce(is_unmapped, false)")
    cigar = F.col("cigar")
    none = F.array().cast("array<bigint>")
    if dict(reads.dtypes)["cigar"] == "string":
        left, right = R.left_clip_text(cigar), R.right_clip_text(cigar)
        has_cigar = F.coalesce(cigar.rlike("^[0-9]+[A-Z=]"), F.lit(False))
        introns = F.when(
            cigar.contains("N"), R.splice_boundaries(R.parse_cigar(cigar), F.col("ref_start"))
        ).otherwise(none)
    else:
        left, right = R.left_clip_length(cigar), R.right_clip_length(cigar)
        has_cigar = F.coalesce(F.size(cigar) > 0, F.lit(False))
        introns = F.when(
            F.exists("cigar", lambda c: c["op"] == R.SPLICE_OP),
            R.splice_boundaries(cigar, F.col("ref_start")),
        ).otherwise(none)
    return kept.select(
        "chrom",
        F.col("ref_start").cast("bigint").alias("ref_start"),
        F.col("ref_end").cast("bigint").alias("ref_end"),
        F.col("mapq").cast("bigint").alias("mapq"),
        R.read_strand(F.col("ts"), F.col("is_reverse")).alias("read_strand"),
        has_cigar.alias("has_cigar"),
        F.coalesce(left, F.lit(0)).alias("left_op"),
        F.coalesce(right, F.lit(0)).alias("right_op"),
        F.coalesce("seq", F.lit("")).alias("seq"),
        introns.alias("introns"),
    ).selectExpr(
        "*",
        "if(left_op > 0, left(seq, left_op), '') as left_seq",
        "if(right_op > 0, right(seq, right_op), '') as right_seq",
    )


def read_spans(reads: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """One row per distinct read span and strand, with the sums of its reads.

    Everything a site needs from its reads, apart from where they lie, is additive or
    an extreme.  So reads with the same (contig, start, end, strand) are summed before
    they are shuffled or joined, and a deep locus costs no more than a shallow one.
    """
    shaped = usable_reads(reads, cfg).selectExpr(
        *SPAN,
        "mapq",
        "has_cigar",
        "left_op > 0 as clipped_left",
        "right_op > 0 as clipped_right",
        "bigint(length(if(read_strand = '+', left_seq, right_seq))) as clip_s",
        "bigint(length(if(read_strand = '+', right_seq, left_seq))) as clip_e",
    )
    sums = {
        "n": "count(1)",
        "q1": "sum(mapq)",
        "q2": "sum(double(mapq * mapq))",
        "cs1": "sum(clip_s)",
        "ce1": "sum(clip_e)",
        "clip2": "sum(double(clip_s * clip_s + clip_e * clip_e))",
        "clip3": "sum(double(clip_s * clip_s * clip_s + clip_e * clip_e * clip_e))",
        "cs_max": "max(clip_s)",
        "ce_max": "max(clip_e)",
        "clip_min": "min(least(clip_s, clip_e))",
        "clip_max": "max(greatest(clip_s, clip_e))",
        "long_clips": "sum(int(clip_s > 20) + int(clip_e > 20))",
        "short_clips": "sum(int(clip_s <= 10) + int(clip_e <= 10))",
        "n_cigar": "count_if(has_cigar)",
        "n_left": "count_if(clipped_left)",
        "n_right": "count_if(clipped_right)",
        "n_either": "count_if(clipped_left or clipped_right)",
    }
    return shaped.groupBy(*SPAN).agg(*[F.expr(f"{e} as {c}") for c, e in sums.items()])


def clip_length_spans(reads: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Clip lengths per read span with their counts; ``kind`` is ``cs`` or ``ce``."""
    return (
        usable_reads(reads, cfg)
        .selectExpr(
            "chrom",
            "ref_start",
            "ref_end",
            "stack(2, 'cs', length(if(read_strand = '+', left_seq, right_seq)),"
            " 'ce', length(if(read_strand = '+', right_seq, left_seq))) as (kind, value)",
        )
        .groupBy("chrom", "ref_start", "ref_end", "kind", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def site_read_overlap(sites: DataFrame, spans: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Pairs of distinct site coordinate and read span overlapping its window.

    Windows are half-open: ``ref_end > max(0, pos - w)`` and ``ref_start < pos + w``.
    Adds ``inside``, true within the narrow window, and for spans with a strand the
    oriented offsets ``ds``, ``de`` of read start and end from the site.
    """
    where = sites.select(*SITE).distinct()
    w, narrow = cfg.reach, cfg.window_size
    pairs = crowded_join(
        where,
        spans.where("ref_end > 0"),
        on=["chrom"],
        point="position",
        low=f"ref_start - {w - 1}",
        high=f"ref_end + {w - 1}",
    )
    inside = (
        "true"
        if w == narrow
        else f"ref_end > position - {narrow} and ref_start < position + {narrow}"
    )
    offsets = [
        "if(read_strand = '+', ref_start, ref_end) - position as ds",
        "if(read_strand = '+', ref_end, ref_start) - position as de",
    ]
    return pairs.selectExpr(
        "*", f"({inside}) as inside", *(offsets if "read_strand" in spans.columns else [])
    )


def _grid(cfg: FeatureConfig) -> range:
    return range(-cfg.gradient_analysis_range, cfg.gradient_analysis_range + 1, GRID_STEP)


def read_sums(pairs: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Weighted sums and extremes per site; input of :func:`read_features`.

    Counts stay integers; squares and cubes are doubles, exact up to 2^53.
    """
    cw = cfg.coverage_window

    def flank(low: str, high: str) -> str:
        """Overlap with ``[low, high)`` of reads that have an end inside it."""
        return (
            f"coalesce(sum(if((ref_start >= {low} and ref_start < {high})"
            f" or (ref_end > {low} and ref_end <= {high}),"
            f" n * greatest(least(ref_end, {high}) - greatest(ref_start, {low}), 0), 0)), 0)"
        )

    def covered(offset: int) -> str:
        low, high = f"(position + {offset})", f"(position + {offset + GRID_STEP})"
        return f"greatest(least(ref_end, {high}) - greatest(ref_start, {low}), 0)"

    same = "read_strand = strand"
    near_left = f"abs(ref_start - position) <= {NEAR}"
    near_right = f"abs(ref_end - position) <= {NEAR}"
    clipped = (
        f"case when {near_left} and {near_right} then n_either"
        f" when {near_left} then n_left when {near_right} then n_right else 0 end"
    )
    in_slope = f"ds >= {-SLOPE_REACH} and ds < {SLOPE_REACH + GRID_STEP}"
    counted = {
        "reads": "true",
        "start_in_window": f"abs(ds) <= {cfg.density_window}",
        "end_in_window": f"abs(de) <= {cfg.density_window}",
        "same_strand": same,
        "start_near": f"abs(ds) <= {NEAR}",
        "upstream": "ds < 0",
        "downstream": "ds > 0",
        "slope_c": in_slope,
    }
    summed = {
        **{c: c for c in ("cs1", "ce1", "clip2", "clip3", "long_clips", "short_clips", "q1", "q2")},
        "bias_all": f"if({same}, n_cigar, 0)",
        "bias_clipped": f"if({same}, {clipped}, 0)",
        "ds1": "n * ds",
        "ds2": "n * double(ds * ds)",
        "inverse_distance": "n / double(greatest(abs(ds), 1))",
        "slope_ic": f"if({in_slope}, n * floor((ds + {SLOPE_REACH}) / {GRID_STEP}), 0)",
        **{f"grid_{i}": f"n * {covered(offset)}" for i, offset in enumerate(_grid(cfg))},
    }
    extremes = {
        "cs_max": "max(if(inside, cs_max, null))",
        "ce_max": "max(if(inside, ce_max, null))",
        "clip_min": "min(if(inside, clip_min, null))",
        "clip_max": "max(if(inside, clip_max, null))",
        "cov_left": flank(f"(position - {cw})", "position"),
        "cov_right": flank("position", f"(position + {cw})"),
    }
    texts = (
        {c: f"coalesce(sum(if(inside and {e}, n, 0)), 0)" for c, e in counted.items()}
        | {c: f"coalesce(sum(if(inside, {e}, 0)), 0)" for c, e in summed.items()}
        | extremes
    )
    return pairs.groupBy(*SITE).agg(*[F.expr(text).alias(c) for c, text in texts.items()])


def read_features(sums: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Named features from the per-site sums."""
    points = len(_grid(cfg))
    steps = [f"grid_{i + 1} - grid_{i}" for i in range(points - 1)]
    helpers = {
        "nd": "double(greatest(reads, 1))",
        "cb": "double(if(strand = '+', cov_left, cov_right))",
        "ca": "double(if(strand = '+', cov_right, cov_left))",
        "max_step": f"greatest({', '.join(f'abs({d})' for d in steps)}) / {GRID_STEP}",
        "max_fall": f"greatest({', '.join(f'-({d})' for d in steps)}) / {GRID_STEP}",
        "local": f"({' + '.join(f'grid_{i}' for i in range(points))}) / {float(GRID_STEP * points)}D",
        "clip_mean": "(cs1 + ce1) / double(greatest(2 * reads, 1))",
        "clip_m2": "clip2 / double(greatest(2 * reads, 1))",
        "clip_m3": "clip3 / double(greatest(2 * reads, 1))",
        "start_mean": "ds1 / double(greatest(reads, 1))",
    }
    if points < 3:
        helpers |= {"max_step": "0D", "max_fall": "0D", "local": "0D"}
    columns = {
        "total_reads": "reads",
        "read_start_density": "start_in_window",
        "read_end_density": "end_in_window",
        "start_soft_clip_mean": "cs1 / nd",
        "end_soft_clip_mean": "ce1 / nd",
        "start_soft_clip_max": "double(coalesce(cs_max, 0))",
        "end_soft_clip_max": "double(coalesce(ce_max, 0))",
        "start_soft_clip_count": "reads",
        "end_soft_clip_count": "reads",
        "mean_mapq": "q1 / nd",
        "std_mapq": "sqrt(greatest(q2 / nd - (q1 / nd) * (q1 / nd), 0D))",
        "strand_ratio": "same_strand / double(greatest(reads - same_strand, 1))",
        "coverage_before": "cb",
        "coverage_after": "ca",
        "delta_coverage": "ca - cb",
        "softclip_bias": "coalesce(try_divide(double(bias_clipped), bias_all), 0D)",
        "coverage_gradient_sharpness": (
            "if(strand = '-' and max_fall > 0, max_fall, max_step) / greatest(local, 1D)"
        ),
        "max_coverage_gradient": "max_step",
        "local_avg_coverage": "local",
        "coverage_ratio": "ca / greatest(cb, 1D)",
        "coverage_log_ratio": "if(cb > 0, log2(greatest(ca, 1D) / greatest(cb, 1D)), 0D)",
        "normalized_delta_coverage": "(ca - cb) / greatest(ca + cb, 1D)",
        "read_start_variance": "greatest(ds2 / nd - start_mean * start_mean, 0D)",
        "read_start_coefficient_variation": (
            "greatest(ds2 / nd - start_mean * start_mean, 0D) / greatest(position + start_mean, 1D)"
        ),
        "weighted_read_start_density": "double(inverse_distance)",
        "read_start_clustering": "start_near / nd",
        "up_down_stream_ratio": "upstream / double(greatest(downstream, 1))",
        "five_prime_degradation_score": "(55 * slope_c - 11 * slope_ic) / 1210D",
        "softclip_sparsity": "2 * reads / nd",
        "softclip_length_variance": "greatest(clip_m2 - clip_mean * clip_mean, 0D)",
        "softclip_length_skewness": (
            "if(reads < 2 or clip_min = clip_max, 0D, coalesce(try_divide("
            "clip_m3 - 3 * clip_mean * clip_m2 + 2 * clip_mean * clip_mean * clip_mean,"
            " power(clip_m2 - clip_mean * clip_mean, 1.5D)), 0D))"
        ),
        "norm_read_density": "reads / greatest(ca, 1D)",
        "coverage_efficiency": "reads / greatest(cb + ca, 1D)",
    }
    if cfg.legacy_columns:
        columns["long_to_short_clip_ratio"] = "long_clips / double(greatest(short_clips, 1))"
        columns["normalized_read_density"] = columns["norm_read_density"]
    columns |= {c: c for c in FROM_HISTOGRAMS if c in sums.columns}
    prepared = sums.selectExpr("*", *[f"{e} as {c}" for c, e in helpers.items()])
    return prepared.selectExpr(*SITE, *[f"{e} as {c}" for c, e in columns.items()])


def read_shapes(parsed: DataFrame) -> DataFrame:
    """One row per distinct read span, strand, pair of clip lengths and introns.

    ``parsed`` is :func:`usable_reads`.  Reads of one shape are summed before the join
    with the sites; only their numbers and qualities differ.
    """
    sums = {
        "n": "count(1)",
        "q1": "sum(mapq)",
        "q2": "sum(double(mapq * mapq))",
        "n_cigar": "count_if(has_cigar)",
        "n_left": "count_if(left_op > 0)",
        "n_right": "count_if(right_op > 0)",
        "n_either": "count_if(left_op > 0 or right_op > 0)",
    }
    shaped = parsed.where("ref_end > 0").selectExpr(
        *SPAN,
        "introns",
        "bigint(length(if(read_strand = '+', left_seq, right_seq))) as clip_s",
        "bigint(length(if(read_strand = '+', right_seq, left_seq))) as clip_e",
        "mapq", "has_cigar", "left_op", "right_op",
    )
    return shaped.groupBy(*SPAN, "clip_s", "clip_e", "introns").agg(
        *[F.expr(f"{e} as {c}") for c, e in sums.items()]
    )


# Kinds of histogram: oriented read start and end relative to the site, clip lengths.
STARTS, ENDS, START_CLIPS, END_CLIPS = range(4)


def site_histograms(sites: DataFrame, shapes: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Histograms per site: one row per (site, kind, value) with ``c`` reads.

    ``span`` is signed so that the sum of ``span * max(x - value, 0)`` over starts and
    ends is the number of bases that the reads of the site cover below ``x``.  What
    depends on a read as a whole (quality, strand, flanks, introns) is summed on the
    rows of its start.
    """
    cw = cfg.coverage_window
    cap = cfg.splice_site_window

    def flank(low: str, high: str) -> str:
        return (
            f"if((ref_start >= {low} and ref_start < {high}) or (ref_end > {low} and ref_end <= {high}),"
            f" n * greatest(least(ref_end, {high}) - greatest(ref_start, {low}), 0), 0)"
        )

    near_left = f"abs(ref_start - position) <= {NEAR}"
    near_right = f"abs(ref_end - position) <= {NEAR}"
    clipped = (
        f"case when {near_left} and {near_right} then n_either"
        f" when {near_left} then n_left when {near_right} then n_right else 0 end"
    )
    same = "inside and read_strand = strand"
    of_start = {
        "q1": "if(inside, q1, 0)",
        "q2": "if(inside, q2, 0)",
        "same_strand": f"if({same}, n, 0)",
        "bias_all": f"if({same}, n_cigar, 0)",
        "bias_clipped": f"if({same}, {clipped}, 0)",
        "cov_left": flank(f"(position - {cw})", "position"),
        "cov_right": flank("position", f"(position + {cw})"),
    }
    forward = "if(inside and ref_end > ref_start, if(read_strand = '+', n, -n), 0)"
    pairs = site_read_overlap(sites, shapes, cfg).selectExpr(
        *SITE,
        "if(inside, n, 0) as n",
        f"{forward} as span",
        "ds", "de", "clip_s", "clip_e",
        *[f"{e} as {c}" for c, e in of_start.items()],
        f"if(inside and size(introns) > 0,"
        f" least(array_min(transform(introns, b -> abs(b - position))), {cap}), {cap}) as splice",
    )
    rows = pairs.selectExpr(
        *SITE,
        f"stack(4, {STARTS}, ds, span, {ENDS}, de, -span,"
        f" {START_CLIPS}, clip_s, 0L, {END_CLIPS}, clip_e, 0L) as (kind, value, span)",
        "n", "splice", *of_start,
    )
    return rows.groupBy(*SITE, "kind", "value").agg(
        F.sum("n").alias("c"),
        F.sum("span").alias("span"),
        F.min("splice").alias("splice"),
        *[F.expr(f"sum(if(kind = {STARTS}, {c}, 0)) as {c}") for c in of_start],
    )


def histogram_sums(histograms: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """The columns of :func:`read_sums`, entropies, medians and splice distance per site."""

    def total(kind: int, expr: str = "c") -> str:
        return f"coalesce(sum(if(kind = {kind}, {expr}, 0)), 0)"

    def entropy(kind: int) -> str:
        c = f"if(kind = {kind} and c > 0, c, null)"
        return f"log2(sum({c})) - sum({c} * log2({c})) / sum({c})"

    def clips(expr: str) -> str:
        return f"coalesce(sum(if(kind in ({START_CLIPS}, {END_CLIPS}), {expr}, 0)), 0)"

    def seen(kinds: str) -> str:
        return f"if(kind in ({kinds}) and c > 0, value, null)"

    def covered_below(offset: int) -> str:
        return f"sum(if(kind in ({STARTS}, {ENDS}), span * greatest({offset} - value, 0), 0))"

    both = f"{START_CLIPS}, {END_CLIPS}"
    in_slope = f"value >= {-SLOPE_REACH} and value < {SLOPE_REACH + GRID_STEP}"
    columns = {
        "reads": total(STARTS),
        "start_in_window": total(STARTS, f"if(abs(value) <= {cfg.density_window}, c, 0)"),
        "end_in_window": total(ENDS, f"if(abs(value) <= {cfg.density_window}, c, 0)"),
        "start_near": total(STARTS, f"if(abs(value) <= {NEAR}, c, 0)"),
        "upstream": total(STARTS, "if(value < 0, c, 0)"),
        "downstream": total(STARTS, "if(value > 0, c, 0)"),
        "slope_c": total(STARTS, f"if({in_slope}, c, 0)"),
        "slope_ic": total(STARTS, f"if({in_slope}, c * floor((value + {SLOPE_REACH}) / {GRID_STEP}), 0)"),
        "ds1": total(STARTS, "c * value"),
        "ds2": total(STARTS, "c * double(value * value)"),
        "inverse_distance": total(STARTS, "c / double(greatest(abs(value), 1))"),
        "cs1": total(START_CLIPS, "c * value"),
        "ce1": total(END_CLIPS, "c * value"),
        "clip2": clips("double(value * value) * c"),
        "clip3": clips("double(value * value * value) * c"),
        "long_clips": clips("if(value > 20, c, 0)"),
        "short_clips": clips("if(value <= 10, c, 0)"),
        "cs_max": f"max({seen(str(START_CLIPS))})",
        "ce_max": f"max({seen(str(END_CLIPS))})",
        "clip_min": f"min({seen(both)})",
        "clip_max": f"max({seen(both)})",
        **{c: f"sum({c})" for c in ("q1", "q2", "same_strand", "bias_all", "bias_clipped", "cov_left", "cov_right")},
        "nearest_splice_dist": "min(splice)",
        "start_entropy": entropy(STARTS),
        "end_entropy": entropy(ENDS),
        "start_soft_clip_median": f"percentile({seen(str(START_CLIPS))}, 0.5, c)",
        "end_soft_clip_median": f"percentile({seen(str(END_CLIPS))}, 0.5, c)",
    }
    edges = [*_grid(cfg), _grid(cfg)[-1] + GRID_STEP]
    below = {f"below_{i}": covered_below(offset) for i, offset in enumerate(edges)}
    summed = histograms.groupBy(*SITE).agg(*[F.expr(e).alias(c) for c, e in (columns | below).items()])
    return summed.selectExpr(
        *SITE, *columns, *[f"below_{i + 1} - below_{i} as grid_{i}" for i in range(len(edges) - 1)]
    )


# Features that histogram_sums gives under their final names.
FROM_HISTOGRAMS = (
    "nearest_splice_dist", "start_entropy", "end_entropy", "start_soft_clip_median", "end_soft_clip_median",
)


def nearest_splice(sites: DataFrame, reads: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Distance to the closest intron boundary of the reads of a site, below the cap.

    Distinct boundaries are joined with the sites within the cap; sites without one
    are absent and take the cap as their default.
    """
    reach = cfg.splice_site_window - 1
    bounds = (
        usable_reads(reads, cfg)
        .where("size(introns) > 0 and ref_end > 0")
        .selectExpr("chrom", "ref_start", "ref_end", "explode(introns) as bound")
        .distinct()
    )
    pairs = overlap_join(
        sites.select("chrom", "position").distinct(),
        bounds,
        on=["chrom"],
        point="position",
        low=f"bound - {reach}",
        high=f"bound + {reach}",
    )
    w = cfg.window_size
    return (
        pairs.where(f"ref_end > position - {w} and ref_start < position + {w}")
        .groupBy("chrom", "position")
        .agg(F.expr("min(abs(bound - position)) as nearest_splice_dist"))
    )


def position_entropy(pairs: DataFrame) -> DataFrame:
    """Base-2 entropy of the start and of the end positions of the reads of a site."""
    histogram = (
        pairs.where("inside")
        .selectExpr(*SITE, "n", "stack(2, 's', ds, 'e', de) as (kind, value)")
        .groupBy(*SITE, "kind", "value")
        .agg(F.sum("n").alias("c"))
    )

    def entropy(kind: str, name: str) -> Column:
        c = f"if(kind = '{kind}', c, null)"
        return F.expr(f"log2(sum({c})) - sum({c} * log2({c})) / sum({c}) as {name}")

    return histogram.groupBy(*SITE).agg(entropy("s", "start_entropy"), entropy("e", "end_entropy"))


def clip_length_medians(sites: DataFrame, reads: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Median start and end clip length per site, from histograms of lengths."""
    pairs = site_read_overlap(sites, clip_length_spans(reads, cfg), cfg)
    histogram = pairs.where("inside").groupBy(*SITE, "kind", "value").agg(F.sum("n").alias("c"))

    def median(kind: str, name: str) -> Column:
        return F.expr(f"percentile(if(kind = '{kind}', value, null), 0.5, c) as {name}")

    return histogram.groupBy(*SITE).agg(
        median("cs", "start_soft_clip_median"), median("ce", "end_soft_clip_median")
    )


def clip_sequences(reads: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Distinct clipped sequences per clip position with multiplicity ``n``."""
    return parsed_clips(usable_reads(reads, cfg))


def parsed_clips(usable: DataFrame) -> DataFrame:
    """As :func:`clip_sequences`, from parsed reads."""
    end = F.explode(
        F.array(
            F.struct(F.col("ref_start").alias("clip_pos"), F.col("left_seq").alias("seq")),
            F.struct(F.col("ref_end").alias("clip_pos"), F.col("right_seq").alias("seq")),
        )
    )
    return (
        usable.select("chrom", end.alias("_c"))
        .where(F.length("_c.seq") > 0)
        .groupBy("chrom", F.col("_c.clip_pos").alias("clip_pos"), F.upper("_c.seq").alias("seq"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _near_positions(sites: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Distinct (chrom, position) repeated for every clip position in reach."""
    w = cfg.soft_clip_window
    return (
        sites.select("chrom", "position")
        .distinct()
        .withColumn(
            "clip_pos", F.explode(F.sequence(F.col("position") - w, F.col("position") + w))
        )
    )


def clip_composition(sites: DataFrame, clips: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Length, base composition and longest homopolymers of the clips near each site."""
    length = "length(seq)"

    def letters(which: str) -> str:
        return f"sum(n * ({length} - length(translate(seq, '{which}', ''))))"

    def run(base: str) -> str:
        return f"max(array_max(transform(regexp_extract_all(seq, '({base}+)', 1), r -> length(r))))"

    totals = {
        "clips": "sum(n)",
        "bases": f"sum(n * {length})",
        "gc": letters("GC"),
        "ag": letters("AG"),
        "at": letters("AT"),
    }
    maxima = {"longest": f"max({length})", **{f"run_{b}": run(b) for b in Q.BASES}}
    per_position = clips.groupBy("chrom", "clip_pos").agg(
        *[F.expr(e).alias(c) for c, e in (totals | maxima).items()]
    )
    summed = (
        _near_positions(sites, cfg)
        .join(per_position, ["chrom", "clip_pos"])
        .groupBy("chrom", "position")
        .agg(*[F.sum(c).alias(c) for c in totals], *[F.max(c).alias(c) for c in maxima])
    )
    columns = {
        "avg_clip_length": "bases / clips",
        "max_clip_length": "double(longest)",
        "num_clips": "double(clips)",
        "gc_content": "gc / bases",
        "purine_ratio": "ag / bases",
        **{f"max_poly{b}": f"double(coalesce(run_{b}, 0))" for b in Q.BASES},
    }
    if cfg.legacy_columns:
        columns["total_clip_length"] = "double(bases)"
        columns["gc_content_basic"] = "gc / bases"
        columns["at_content_basic"] = "at / bases"
    return summed.selectExpr("chrom", "position", *[f"{e} as {c}" for c, e in columns.items()])


def kmer_statistics(sites: DataFrame, clips: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """k-mer counts, diversity, entropy and composition classes of the clips near each site."""
    exploded = [
        clips.select(
            "chrom", "clip_pos", F.lit(k).alias("k"), F.explode(Q.kmers(F.col("seq"), k)).alias("kmer"), "n"
        )
        for k in cfg.k_values
    ]
    stacked = exploded[0]
    for more in exploded[1:]:
        stacked = stacked.unionByName(more)
    per_position = stacked.groupBy("chrom", "clip_pos", "k", "kmer").agg(F.sum("n").alias("c"))
    per_site = (
        _near_positions(sites, cfg)
        .join(per_position, ["chrom", "clip_pos"])
        .groupBy("chrom", "position", "k", "kmer")
        .agg(F.sum("c").alias("c"))
    )
    return per_site.groupBy("chrom", "position").agg(
        *[c for k in cfg.k_values for c in _kmer_columns(k, cfg)]
    )


def _kmer_columns(k: int, cfg: FeatureConfig) -> list[Column]:
    c = f"if(k = {k}, c, null)"

    def letters(which: str) -> str:
        return f"({k} - length(translate(kmer, '{which}', '')))"

    gc, purine = f"({letters('GC')} / {k}D)", f"({letters('AG')} / {k}D)"
    repeat = "(" + " or ".join(f"kmer = '{b * k}'" for b in Q.BASES) + ")"

    def count(when: str) -> str:
        return f"double(sum(if(k = {k} and {when}, c, 0)))"

    columns = {
        f"k{k}_gc_kmers_ratio": f"{count(f'{gc} >= 0.5D')} / sum({c})",
        f"k{k}_kmer_diversity": f"count({c}) / sum({c})",
        f"k{k}_kmer_entropy": f"log2(sum({c})) - sum({c} * log2({c})) / sum({c})",
        f"k{k}_most_frequent_kmer_ratio": f"max({c}) / sum({c})",
        f"k{k}_unique_kmers": f"double(count({c}))",
        f"k{k}_at_rich_kmers": count(f"not {repeat} and {gc} < 0.4D"),
        f"k{k}_gc_rich_kmers": count(f"not {repeat} and {gc} > 0.6D"),
        f"k{k}_purine_rich_kmers": count(f"{purine} > 0.6D"),
        f"k{k}_repeat_kmers": count(repeat),
    }
    if cfg.legacy_columns:
        columns[f"k{k}_balanced_kmers"] = count(f"not {repeat} and {gc} between 0.4D and 0.6D")
    if k == 3:
        columns |= {f"kmer_{m}": count(f"kmer = '{m}'") for m in Q.TRACKED_3MERS}
    return [F.expr(f"coalesce({text}, 0D)").alias(name) for name, text in columns.items()]


def feature_columns(columns: Sequence[str]) -> list[str]:
    """Stable output order: the basic columns, then the rest by name."""
    basic = [c for c in BASIC_COLUMNS if c in columns]
    return basic + sorted(c for c in columns if c not in basic)


def site_sums(sites: DataFrame, parsed: DataFrame, cfg: FeatureConfig, parts: Sequence[str] = PARTS) -> DataFrame:
    """The columns of :func:`histogram_sums` from running sums over blocks (see ``profile``), one row per distinct site.

    ``parsed`` is :func:`usable_reads`.  Sites and reads are not paired, so a site costs the same however many
    reads lie around it.  Columns of parts that are not asked for are 0.
    """
    grid = list(_grid(cfg))
    sums = site_profile(
        sites.select(*SITE).distinct(), parsed, cfg, parts, grid=grid, step=GRID_STEP, near=NEAR, slope_reach=SLOPE_REACH
    )
    absent = [c for c in columns_of(PARTS, grid) if c not in sums.columns and c not in FROM_HISTOGRAMS]
    return sums.selectExpr("*", *[f"0L as {c}" for c in absent])


def coordinate_features(sites: DataFrame, reads: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """The whole feature table, one row per distinct site coordinate.

    ``reads`` is scanned and parsed once, into a table in the shared folder without the
    read sequences; one pass over blocks feeds all features but those of clip sequences.
    """
    where = sites.select(*SITE).distinct()
    parsed = written(usable_reads(reads, cfg).drop("seq"))
    clips = parsed_clips(parsed)
    table = (
        where.join(read_features(site_sums(where, parsed, cfg), cfg), list(SITE), "left")
        .join(clip_profile(where, clips, cfg), ["chrom", "position"], "left")
    )
    names = feature_columns([c for c in table.columns if c not in SITE])
    filled = table.fillna(cfg.splice_site_window, ["nearest_splice_dist"]).fillna(
        0, [c for c in names if c != "nearest_splice_dist"]
    )
    return filled.select(*SITE, *names)


def site_features(sites: DataFrame, reads: DataFrame, cfg: FeatureConfig | None = None) -> DataFrame:
    """Feature row for every candidate site; sites without reads get the empty defaults.

    Features depend on coordinate and strand only, so they are computed once per
    coordinate and attached to the sites that share it.
    """
    return attach_features(sites, coordinate_features(sites, reads, cfg or FeatureConfig()))


def attach_features(sites: DataFrame, features: DataFrame) -> DataFrame:
    """``features``, one row per coordinate, for every site; further columns of ``sites`` stay."""
    ids = [c for c in sites.columns if c not in SITE]
    joined = skew_join(sites, features, SITE)
    names = [c for c in features.columns if c not in SITE]
    order = [c for c in ("transcript_id", "site_type") if c in ids]
    return joined.select(*order, *SITE, *[c for c in ids if c not in order], *names)
