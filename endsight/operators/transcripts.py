"""Transcript-level tables: exon statistics, joins of coverage with site scores, features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from endsight.functions.contigs import normalize_chrom
from endsight.operators.scale import skew_join
from endsight.operators.sites import end_positions, oriented_strands

# Probability of a site that no model scored, and the default columns of a row.
DEFAULT_PROBABILITY = 0.5
EXON_COLUMNS = (
    "first_exon_length", "last_exon_length", "max_exon_length", "min_exon_length",
    "mean_exon_length", "total_exon_length", "exon_count",
)


def exon_lengths(exons: DataFrame, *, start: str = "start", end: str = "end") -> DataFrame:
    """Count, extremes, mean and total of exon lengths, and the two terminal lengths by position."""
    length = f"greatest({end} - {start} + 1, 0)"
    return exons.groupBy("transcript_id").agg(
        F.expr(f"min_by({length}, struct({start}, {end})) as leftmost_length"),
        F.expr(f"max_by({length}, struct({start}, {end})) as rightmost_length"),
        F.expr(f"max({length}) as max_exon_length"),
        F.expr(f"min({length}) as min_exon_length"),
        F.expr(f"sum({length}) as total_exon_length"),
        F.expr("count(1) as exon_count"),
    )


def coverage_table(
    transcripts: DataFrame,
    exons: DataFrame,
    *,
    start: str = "start",
    end: str = "end",
    exon_start: str = "start",
    exon_end: str = "end",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per transcript and strand reading: ends, coverage, exon statistics and the columns ``keep`` of ``transcripts``."""
    oriented = transcripts.withColumn("_s", F.explode(oriented_strands(F.col("strand"))))
    tss, tes = end_positions(F.col("_s"), F.col(start), F.col(end))
    rows = oriented.select(
        "transcript_id",
        F.col("_s").alias("strand"),
        F.col("chrom").alias("tss_chrom"),
        F.col("chrom").alias("tes_chrom"),
        tss.alias("tss_pos"),
        tes.alias("tes_pos"),
        "coverage",
        *keep,
    )
    stats = exon_lengths(exons, start=exon_start, end=exon_end)
    return rows.join(stats, "transcript_id", "left").selectExpr(
        *rows.columns,
        "bigint(coalesce(if(strand = '+', leftmost_length, rightmost_length), 0)) as first_exon_length",
        "bigint(coalesce(if(strand = '+', rightmost_length, leftmost_length), 0)) as last_exon_length",
        "bigint(coalesce(max_exon_length, 0)) as max_exon_length",
        "bigint(coalesce(min_exon_length, 0)) as min_exon_length",
        "coalesce(total_exon_length / double(exon_count), 0D) as mean_exon_length",
        "bigint(coalesce(total_exon_length, 0)) as total_exon_length",
        "bigint(coalesce(exon_count, 0)) as exon_count",
    )


def multi_exon_count(exons: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of transcripts with more than one exon row."""
    per_tx = exons.where("transcript_id is not null").groupBy(*by, "transcript_id").count()
    return per_tx.groupBy(*by).agg(F.count_if(F.col("count") > 1).alias("multi_exon_transcripts"))


def known_score(column: str) -> Column:
    """The score, NULL where it is NaN: Spark would order NaN above every number."""
    return F.when(~F.isnan(column), F.col(column))


def site_probabilities(
    sites: DataFrame, scores: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Left join of score columns, 0.5 where a site has none.

    Repeated score rows of one key are reduced first so that the join keeps the row
    count of ``sites``; the highest value of each column is kept, and NaN counts as none.
    """
    best = scores.groupBy(*keys).agg(*[F.max(known_score(c)).alias(c) for c in columns])
    return skew_join(sites, best, keys).fillna(DEFAULT_PROBABILITY, list(columns))


def best_row_per_site(sites: DataFrame, probability: str = "probability") -> DataFrame:
    """Highest-probability row of every (chrom, position, strand, site type).

    The minimum of a struct combines map-side, so a coordinate shared by very many transcripts never
    reaches one task as rows; equal probabilities go to the smallest transcript id.
    """
    keys = ["chrom", "position", "strand", "site_type"]
    rest = [c for c in sites.columns if c not in keys]
    order = [F.coalesce(-known_score(probability), F.lit(float("inf"))).alias("_p")]
    if "transcript_id" in rest:
        order.append(F.col("transcript_id").alias("_t"))
    lowest = F.min(F.struct(*order, F.struct(*rest).alias("row")))
    picked = sites.groupBy(*keys).agg(lowest.alias("_best"))
    return picked.select(*keys, *[F.col(f"_best.row.{c}").alias(c) for c in rest])


def best_row_per_transcript(
    rows: DataFrame, score: str, *, keys: Sequence[str] = ("transcript_id",)
) -> DataFrame:
    """Row with the highest ``score`` per transcript; NaN and NULL come last."""
    rest = [c for c in rows.columns if c not in keys]
    ordered = [known_score(score).alias("_score"), *[c for c in rest if c != score], score]
    picked = rows.groupBy(*keys).agg(F.max(F.struct(*ordered)).alias("_best"))
    return picked.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def first_row_per_transcript(
    rows: DataFrame, order: Sequence[str], *, keys: Sequence[str] = ("transcript_id",)
) -> DataFrame:
    """First row in file order per transcript."""
    rest = [c for c in rows.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    picked = rows.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("_first"))
    return picked.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def merge_cov_sites(
    cov: DataFrame, tss: DataFrame, tes: DataFrame, *, by_strand: bool = True
) -> DataFrame:
    """Coverage rows joined with the start-site and the end-site row of their coordinates.

    Columns that both site tables share get the suffixes ``_tss`` and ``_tes``.  With
    ``by_strand=False`` the strand is not part of the key and rows may multiply.
    """
    keys = {"chrom", "position", "strand"}
    names = [c for c in tss.columns if c not in keys | {"transcript_id"}]
    shared = {c for c in names if c in tes.columns}

    def side(sites: DataFrame, end: str) -> DataFrame:
        values = [c for c in sites.columns if c not in keys | {"transcript_id"}]
        strand = [F.col("strand")] if by_strand else []
        return sites.select(
            normalize_chrom(F.col("chrom")).alias(f"{end}_chrom"),
            F.col("position").alias(f"{end}_pos"),
            *strand,
            *[F.col(c).alias(f"{c}_{end}" if c in shared else c) for c in values],
        )

    on = ["strand"] if by_strand else []
    named = cov.withColumns(
        {c: normalize_chrom(F.col(c)) for c in ("tss_chrom", "tes_chrom")}
    )
    with_start = skew_join(named, side(tss, "tss"), ["tss_chrom", "tss_pos", *on], "inner")
    return skew_join(with_start, side(tes, "tes"), ["tes_chrom", "tes_pos", *on], "inner")


def derived_features(rows: DataFrame) -> DataFrame:
    """The transcript features computed from coverage, exons and end probabilities."""
    def at_least_one(name: str) -> str:
        return f"greatest({name}, 1)"

    stage_one = {
        "transcript_length": "abs(tes_pos - tss_pos)",
        "tss_confidence": "coalesce(probability_tss, 0.5D)",
        "tes_confidence": "coalesce(probability_tes, 0.5D)",
    }
    columns = {
        "log_transcript_length": "log1p(transcript_length)",
        "min_confidence": "least(tss_confidence, tes_confidence)",
        "confidence_product": "tss_confidence * tes_confidence",
        "exon_density": f"exon_count / double({at_least_one('transcript_length')})",
        "confidence_exon_interaction": "tss_confidence * tes_confidence * exon_count",
        "coverage_per_exon": f"coverage / double({at_least_one('exon_count')})",
        "avg_exon_length": f"total_exon_length / double({at_least_one('exon_count')})",
        "exon_length_ratio": f"max_exon_length / double({at_least_one('min_exon_length')})",
        "coverage_length_ratio": f"coverage / double({at_least_one('transcript_length')})",
        "confidence_coverage_interaction": "tss_confidence * tes_confidence * coverage",
        "confidence_sum": "tss_confidence + tes_confidence",
        "confidence_diff": "abs(tss_confidence - tes_confidence)",
        "terminal_exon_ratio": f"first_exon_length / double({at_least_one('last_exon_length')})",
        "exon_efficiency": f"mean_exon_length / double({at_least_one('transcript_length')})",
        "log_coverage": "log1p(coverage)",
        "exon_length_entropy": (
            "log1p((max_exon_length - min_exon_length) / greatest(mean_exon_length, 1D))"
        ),
        "exon_length_std": "0D",
        "exon_length_skewness": "double(max_exon_length - mean_exon_length)",
    }
    if "total_reads" in rows.columns:
        columns["log_total_reads"] = "log1p(total_reads)"
    first = rows.selectExpr("*", *[f"{e} as {c}" for c, e in stage_one.items()])
    return first.selectExpr("*", *[f"{e} as {c}" for c, e in columns.items()])


def label_join(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Keep the rows of transcripts that have a label."""
    return rows.join(labels, "transcript_id", "inner")


def ranked_cov_labels(
    ranked: DataFrame, cov: DataFrame, labels: DataFrame, *, by: Sequence[str] = (), score: str = "pred_prob", abundance: str = "coverage"
) -> DataFrame:
    """Model score, baseline abundance and label on the same transcripts of each test (``by``)."""
    keys = [*by, "transcript_id"]
    best_score = ranked.groupBy(*keys).agg(F.max(known_score(score)).alias(score))
    best_cov = cov.groupBy(*keys).agg(F.max(known_score(abundance)).alias(abundance))
    return best_score.join(best_cov, keys).join(labels, keys)


def end_coverage(cov: DataFrame) -> DataFrame:
    """Mean coverage of the transcripts ending at each site, one row per site."""
    def side(end: str) -> DataFrame:
        return cov.select(
            F.lit(end.upper()).alias("site_type"),
            normalize_chrom(F.col(f"{end}_chrom")).alias("chrom"),
            F.col(f"{end}_pos").alias("position"),
            "strand",
            "coverage",
        )

    return (
        side("tss")
        .unionByName(side("tes"))
        .groupBy("site_type", "chrom", "position", "strand")
        .agg(F.avg("coverage").alias("coverage"))
    )


def join_sites(scored: DataFrame, known: DataFrame) -> DataFrame:
    """Scored sites joined with what is ``known`` per site, such as :func:`end_coverage`."""
    named = scored.withColumns(
        {"chrom": normalize_chrom(F.col("chrom")), "site_type": F.upper("site_type")}
    )
    return skew_join(named, known, ["site_type", "chrom", "position", "strand"], "inner")


def site_mean_coverage(scored: DataFrame, cov: DataFrame) -> DataFrame:
    """Scored sites joined with the mean coverage of the transcripts ending there."""
    return join_sites(scored, end_coverage(cov))


def intron_chains(transcripts: DataFrame, exons: DataFrame, *, start: str = "start", end: str = "end") -> DataFrame:
    """Sorted intron list of every transcript with more than one exon.

    The list is as long as one transcript has exons.
    """
    ordered = exons.groupBy("transcript_id").agg(
        F.array_sort(F.collect_set(F.struct(F.col(start).alias("s"), F.col(end).alias("e")))).alias("x")
    )
    chains = ordered.where("size(x) > 1").selectExpr(
        "transcript_id",
        "array_join(transform(sequence(1, size(x) - 1),"
        " i -> concat(x[i - 1].e, '-', x[i].s)), ',') as chain",
    )
    return transcripts.select("transcript_id", "chrom", "strand").join(chains, "transcript_id")


def exact_structure_match(
    query: DataFrame, reference: DataFrame
) -> DataFrame:
    """Mark query transcripts whose contig, strand and intron chain equal a reference chain."""
    keys = ["chrom", "strand", "chain"]
    known = reference.groupBy(*keys).agg(F.min("transcript_id").alias("ref_id"))
    return skew_join(query, known, keys).select(
        "transcript_id",
        "ref_id",
        F.when(F.col("ref_id").isNotNull(), F.lit("=")).otherwise(F.lit("u")).alias("class_code"),
    )


def bed12(exons: DataFrame, *, order: Column, start: str = "start", end: str = "end") -> DataFrame:
    """Twelve-column block records, one per transcript.

    Distinct exons with start < end on a known strand; the contig and strand of the
    first exon in file order win, exons elsewhere are ignored.
    """
    usable = exons.where(
        (F.col(start) < F.col(end)) & F.col("strand").isin("+", "-") & F.col("transcript_id").isNotNull()
    ).withColumn("_order", order)
    place = F.struct("chrom", "strand")
    exon = F.struct(F.col(start).alias("s"), F.col(end).alias("e"))
    # an exon repeated elsewhere counts at its first place only
    distinct = usable.groupBy("transcript_id", exon.alias("x")).agg(
        F.min(F.struct("_order", place.alias("place"))).alias("first")
    )
    gathered = distinct.groupBy("transcript_id").agg(
        F.min("first").getField("place").alias("place"),
        F.array_sort(F.collect_list(F.struct("x.s", "x.e", "first.place"))).alias("all"),
    )
    blocks = gathered.selectExpr(
        "transcript_id", "place.chrom", "place.strand", "filter(all, b -> b.place = place) as blocks"
    )
    return blocks.selectExpr(
        "chrom",
        "blocks[0].s - 1 as chrom_start",
        "array_max(transform(blocks, b -> b.e)) as chrom_end",
        "transcript_id as name",
        "0 as score",
        "strand",
        "blocks[0].s - 1 as thick_start",
        "array_max(transform(blocks, b -> b.e)) as thick_end",
        "'0,0,0' as rgb",
        "size(blocks) as block_count",
        "array_join(transform(blocks, b -> string(b.e - b.s + 1)), ',') as block_sizes",
        "array_join(transform(blocks, b -> string(b.s - blocks[0].s)), ',') as block_starts",
    )


def prediction_truth(
    predictions: DataFrame, labels: DataFrame, *, threshold: float = 0.5, keys: Sequence[str] = ("chrom", "position")
) -> DataFrame:
    """Predictions with true labels on ``keys`` and their TP/FP/TN/FN class (p > threshold)."""
    joined = predictions.join(labels.select(*keys, "label"), list(keys))
    return joined.withColumn(
        "outcome",
        F.expr(
            f"case when label = 1 and probability > {threshold}D then 'TP' when label = 0 and"
            f" probability > {threshold}D then 'FP' when label = 0 then 'TN' else 'FN' end"
        ),
    )


def false_negatives(
    labeled: DataFrame,
    predictions: DataFrame,
    *,
    threshold: float = 0.5,
    confidence: float = 0.9,
    keys: Sequence[str] = ("chrom", "position"),
) -> DataFrame:
    """True sites the model missed, ``high_confidence`` where the probability is below 1 - confidence.

    With ``site_type`` among ``keys`` both types of site go through one join.
    """
    joined = labeled.where("label = 1").join(predictions.select(*keys, "probability"), list(keys))
    return joined.where(F.col("probability") < threshold).withColumn(
        "high_confidence", F.col("probability") < (1 - confidence)
    )


def bed_window(site_type: Column, strand: Column, position: Column, width: int = 100) -> tuple[Column, Column]:
    """Window downstream of a start site or upstream of an end site; (-1, -1) for unknown strands."""
    ahead = (F.upper(site_type) == "TSS") == (strand == "+")
    known = strand.isin("+", "-")
    low = F.when(~known, F.lit(-1)).when(ahead, position).otherwise(position - width)
    high = F.when(~known, F.lit(-1)).when(ahead, position + width).otherwise(position)
    return low, high


def label_disagreement(site_labels: DataFrame, transcript_labels: DataFrame) -> DataFrame:
    """Transcripts whose site label differs from their own label."""
    return site_labels.join(transcript_labels, "transcript_id").where("site_label <> transcript_label")


def join_cardinality(parts: dict[str, DataFrame]) -> DataFrame:
    """Row counts of the named frames as one table."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("step"), "rows")
        for name, df in parts.items()
    ]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out
