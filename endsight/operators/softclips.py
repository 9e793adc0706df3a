"""Soft-clipped read ends as rows, and k-mer profiles of sites from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from endsight.functions import sequences as Q
from endsight.operators.end_profile import end_sums
from endsight.operators.features import SITE, FeatureConfig, usable_reads
from endsight.operators.scale import ordered_scan, overlap_join, skew_join
from endsight.operators.sites import LABEL_TOLERANCE, proximity_label

# Shortest clip kept as a row, shortest clip of a training site, k-mer sizes,
# letters of a sequence, counted dinucleotides, size of the balanced training set.
MIN_CLIP = 2
MIN_TRAIN_CLIP = 5
PROFILE_K = (3, 4, 5)
LETTERS = "ACGTNRYSWKMBDHV"
DINUCLEOTIDES = ("AA", "AT", "GC", "CG")
MAX_TRAIN_SITES = 5_000


def _ends(reads: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """One row per clipped end of at least two bases."""
    return usable_reads(reads, cfg).selectExpr(
        "chrom",
        "ref_start",
        "ref_end",
        "read_strand",
        "mapq as mapping_quality",
        "stack(2, 'left', left_seq, ref_start, 'right', right_seq, ref_end) as (side, sequence, read_position)",
    ).where(f"length(sequence) >= {MIN_CLIP} and ref_end > 0")


def softclip_rows(sites: DataFrame, reads: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """One row per site and clipped end of at least two bases of the reads around it."""
    return _around(sites, _ends(reads, cfg), cfg)


def softclip_counts(sites: DataFrame, reads: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """The rows of :func:`softclip_rows` with equal ones of one read end as one row that counts ``n``.

    Equal clipped ends collapse before the join with the sites, so a deep locus adds to
    counts and the join's input is bounded by distinct ends.
    """
    ends = _ends(reads, cfg)
    return _around(sites, ends.groupBy(*ends.columns).agg(F.count(F.lit(1)).alias("n")), cfg)


def _around(sites: DataFrame, ends: DataFrame, cfg: FeatureConfig) -> DataFrame:
    w = cfg.window_size
    pairs = overlap_join(
        sites.select(*SITE).distinct(),
        ends,
        on=["chrom"],
        point="position",
        low=f"ref_start - {w - 1}",
        high=f"ref_end + {w - 1}",
    )
    return pairs.selectExpr(
        *SITE,
        "sequence",
        "if((side = 'left') = (read_strand = '+'), 'start', 'end') as clip_type",
        "read_strand",
        "read_position",
        "abs(read_position - position) as distance_to_site",
        "length(sequence) as sequence_length",
        "mapping_quality",
        *(["n"] if "n" in ends.columns else []),
    )


def softclip_sums(
    sites: DataFrame, reads: DataFrame, cfg: FeatureConfig, *, min_length: int = MIN_CLIP, counts_only: bool = False
) -> DataFrame:
    """The rows of :func:`softclip_rows` summed per site and clip type, without building them.

    ``n`` rows, sums of ``distance`` and ``bases``, and ``last_sequence``, the greatest text.  Every clipped end adds to
    the running sums of its block (see ``profile``), so the work grows with ends plus sites.  Only ends whose
    trimmed text has ``min_length`` letters count.  ``counts_only`` gives ``n`` alone.
    """
    ends = _ends(reads, cfg)
    if min_length > MIN_CLIP:
        ends = ends.where(f"length(trim(sequence)) >= {min_length}")
    return end_sums(sites, ends, cfg.window_size, counts_only=counts_only)


def label_softclips(clips: DataFrame, reference: DataFrame, site_type: str, *, tolerance: int = LABEL_TOLERANCE) -> DataFrame:
    """Proximity label of the site of every clip."""
    typed = clips.withColumn("site_type", F.lit(site_type.upper()))
    return proximity_label(typed, reference, tolerance=tolerance).drop("site_type")


def label_clips_by_site(
    clips: DataFrame, sites: DataFrame, reference: DataFrame, *, tolerance: int = LABEL_TOLERANCE
) -> DataFrame:
    """Clips with ``site_type`` and the label of their site under each type.

    Every distinct site of ``sites`` is labelled once, however many clips it has.
    """
    where = sites.select(*SITE).distinct().selectExpr("*", "explode(array('TSS', 'TES')) as site_type")
    return skew_join(clips, proximity_label(where, reference, tolerance=tolerance), SITE, "inner")


def reconcile_counts(features: DataFrame, clips: DataFrame) -> DataFrame:
    """Sites whose clip count in the feature table agrees with the clip rows, however deep the site.

    ``clips`` are clip rows, or their sums with a count ``n``.
    """
    rows = F.sum("n") if "n" in clips.columns else F.count(F.lit(1))
    counted = clips.where("clip_type = 'start'").groupBy(*SITE).agg(rows.alias("rows"))
    joined = counted.join(features, list(SITE))
    return joined.agg(
        F.expr("count_if(abs(start_soft_clip_count - rows) < 1) as matching"),
        F.expr("count_if(abs(start_soft_clip_count - rows) >= 1) as differing"),
    )


def kmer_profile(clips: DataFrame, keys: Sequence[str], sizes: Sequence[int] = PROFILE_K) -> DataFrame:
    """Mean and maximum k-mer frequency per site, in long form (``kmer, mean, max``).

    Every k-mer counts together with its reverse complement.  Frequencies are relative
    to the k-mers of one sequence; the mean runs over all sequences of the site.
    Repeated sequences of a site are summed first.
    """
    seqs = (
        clips.select(*keys, F.regexp_replace(F.upper(F.trim("sequence")), "N", "").alias("seq"))
        .groupBy(*keys, "seq")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    words = F.concat(*[Q.kmers(F.col("seq"), k) for k in sizes])
    both = F.flatten(
        F.transform(
            words,
            lambda w: F.when(Q.reverse_complement(w) == w, F.array(w)).otherwise(F.array(w, Q.reverse_complement(w))),
        )
    )
    counted = seqs.withColumn("_w", both).selectExpr(*keys, "seq", "n", "size(_w) as total", "explode(_w) as kmer")
    per_seq = counted.groupBy(*keys, "seq", "n", "total", "kmer").agg(F.count(F.lit(1)).alias("c"))
    sums = per_seq.groupBy(*keys, "kmer").agg(
        F.expr("sum(n * c / double(total)) as weight"), F.expr("max(c / double(total)) as max")
    )
    sizes_of = seqs.groupBy(*keys).agg(F.sum("n").alias("sequences"))
    return skew_join(sums, sizes_of, keys, "inner").selectExpr(
        *keys, "kmer", "weight / sequences as mean", "max"
    )


def letter_counts(clips: DataFrame) -> DataFrame:
    """Clips with letters as ``length``, ``n_<letter>`` and ``d_<dinucleotide>`` in place of their ``sequence``."""
    seqs = clips.withColumn("seq", F.upper(F.trim("sequence"))).drop("sequence").where("seq <> ''")
    return seqs.selectExpr(
        *[c for c in seqs.columns if c != "seq"],
        "length(seq) as length",
        *[f"length(seq) - length(replace(seq, '{x}', '')) as n_{x}" for x in LETTERS],
        *[f"(length(seq) - length(replace(seq, '{d}', ''))) / 2 as d_{d}" for d in DINUCLEOTIDES],
    )


def sequence_statistics(clips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Length moments, composition, letter entropy and dinucleotide rates per site.

    ``clips`` have a ``sequence``, or are :func:`letter_counts`.
    """
    counted = letter_counts(clips.select(*keys, "sequence")) if "sequence" in clips.columns else clips
    sums = counted.groupBy(*keys).agg(
        F.expr("avg(length) as mean_length"),
        F.expr("stddev_pop(length) as std_length"),
        F.expr("min(length) as min_length"),
        F.expr("max(length) as max_length"),
        F.expr("count(1) as num_sequences"),
        F.expr("sum(length) as bases"),
        *[F.expr(f"sum(n_{x}) as n_{x}") for x in LETTERS],
        *[F.expr(f"sum(d_{d}) as d_{d}") for d in DINUCLEOTIDES],
    )
    entropy = " + ".join(f"if(n_{x} > 0, n_{x} / bases * log2(n_{x} / bases + 1e-10D), 0D)" for x in LETTERS)
    return sums.selectExpr(
        *keys, "mean_length", "std_length", "min_length", "max_length",
        "(n_G + n_C) / bases as gc_content", "(n_A + n_T) / bases as at_content", "n_N / bases as n_content",
        f"-({entropy}) as entropy", "num_sequences",
        *[f"d_{d} / greatest(bases - num_sequences, 1) as dinuc_{d}_freq" for d in DINUCLEOTIDES],
    )


def sampled_statistics(sample: DataFrame, reads: DataFrame, cfg: FeatureConfig, clip_type: str) -> DataFrame:
    """:func:`sequence_statistics` of the rows of :func:`softclip_rows` around a sample of sites.

    The sample is broadcast, so it must be bounded as that of :func:`balanced_sites` is.  The letters of an end
    are counted before it meets sites, ends are not shuffled, and what travels is a row per site and task.
    """
    ends = letter_counts(
        _ends(reads, cfg)
        .where(f"if((side = 'left') = (read_strand = '+'), 'start', 'end') = '{clip_type}'")
        .select("chrom", "ref_start", "ref_end", "sequence")
    )
    w = cfg.window_size
    pairs = overlap_join(
        F.broadcast(sample.select(*SITE).distinct()), ends,
        on=["chrom"], point="position", low=f"ref_start - {w - 1}", high=f"ref_end + {w - 1}",
    )
    return sequence_statistics(pairs, SITE)


def site_clip_dataset(labeled: DataFrame, clip_type: str, *, max_sites: int = MAX_TRAIN_SITES) -> DataFrame:
    """Class-balanced sample of labelled sites with clips of at least five bases, for fitting a model.

    The label of a site is the majority of its rows; rows without a label do not count.  The
    sample takes, per class, the sites with the smallest SHA-1, as many as the smaller
    class and ``max_sites`` allow; that bound is on the labelled rows of the fit.  With one class
    only there is nothing to balance, and up to half of ``max_sites`` of it are taken.  The train split
    is the caller's: pass the rows that may be learned from.
    """
    rows = labeled.where("label is not null").where((F.col("clip_type") == clip_type) & (F.length(F.trim("sequence")) >= MIN_TRAIN_CLIP))
    return balanced_sites(
        rows.groupBy(*SITE).agg(F.expr("int(avg(label) > 0.5) as label"), F.count(F.lit(1)).alias("sequences")), max_sites=max_sites
    )


def balanced_sites(sites: DataFrame, *, max_sites: int = MAX_TRAIN_SITES) -> DataFrame:
    """The sample of :func:`site_clip_dataset` from one row per site with ``label`` and ``sequences``."""
    sites = sites.withColumn("_h", F.sha1(F.concat_ws("|", *SITE)))
    order: list[Column] = [F.col("_h"), *[F.col(c) for c in SITE]]
    scanned = ordered_scan(sites, group=["label"], order=order, sums={"row": F.lit(1)})
    # one row: the smaller class
    least = scanned.groupBy("label").agg(F.max("all_row").alias("n")).agg(F.min("n").alias("_least"))
    return (
        scanned.join(F.broadcast(least), F.expr(f"run_row <= least(_least, {max_sites // 2})"))
        .select(*SITE, "label", "sequences")
    )
