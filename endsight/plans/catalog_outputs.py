"""Queries on output tables: sorted, ordered and formatted rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from endsight.operators import sites as S
from endsight.operators import transcripts as T
from endsight.plans.catalog import query
from endsight.plans.catalog_annotation import gtf_lines, lines_sql
from endsight.plans.catalog_sites import SITES_SQL, tx_sites
from endsight.plans.catalog_transcripts import LABELED_SCORES_SQL, TYPED, site_labels, site_predictions
from endsight.plans.views import view, with_views
from endsight.sources.tables import bed_lines


@query(
    "snk_01_candidates_table",
    with_views(
        f"with {SITES_SQL} select concat_ws(chr(9), transcript_id, site_type, chrom, position::varchar, strand) as value from site", "v_tx"
    ),
)
def snk_01(spark, sf_dir):
    return bed_lines(tx_sites(spark, sf_dir).select("transcript_id", "site_type", "chrom", "position", "strand"))


@query(
    "snk_03_scored_sites",
    with_views(
        f"""with {SITES_SQL} select chrom || ':' || position || ':' || strand || ':' || site_type as site_id, transcript_id, site_type, chrom, position, strand, p_site_rf, p_site_xgb
            from site join v_score using (transcript_id)""",
        "v_tx", "v_score",
    ),
)
def snk_03(spark, sf_dir):
    scores = view(spark, sf_dir, "v_score")
    rows = T.site_probabilities(tx_sites(spark, sf_dir), scores, ["transcript_id"], ["p_site_rf", "p_site_xgb"])
    return rows.select(S.site_id().alias("site_id"), "transcript_id", "site_type", "chrom", "position", "strand", "p_site_rf", "p_site_xgb")


@query(
    "snk_04_ranked_transcripts",
    with_views("select transcript_id, pred_prob, (pred_prob >= 0.5)::int as pred_label from v_score order by pred_prob desc, transcript_id", "v_score"),
)
def snk_04(spark, sf_dir):
    rows = view(spark, sf_dir, "v_score").selectExpr("transcript_id", "pred_prob", "int(pred_prob >= 0.5) as pred_label")
    return rows.orderBy(F.desc("pred_prob"), "transcript_id")


@query("snk_05_gtf_lines", lines_sql("select line_no, value from p order by line_no"))
def snk_05(spark, sf_dir):
    return gtf_lines(spark, sf_dir).select("line_no", "value").orderBy("line_no")


@query(
    "snk_07_bed_error_export",
    with_views(
        f"""with {LABELED_SCORES_SQL} select concat_ws(chr(9), chrom, (case when (site_type = 'TSS') = (strand = '+') then position else position - 100 end)::varchar,
              (case when (site_type = 'TSS') = (strand = '+') then position + 100 else position end)::varchar, site_type || '_FN_' || position, trunc(probability * 1000)::int::varchar, strand) as value
            from lab join pred using (chrom, position, site_type) where label = 1 and probability < 0.5 and probability < 1 - 0.9""",
        "v_tx", "v_ref_site", "v_score",
    ),
)
def snk_07(spark, sf_dir):
    missed = T.false_negatives(site_labels(spark, sf_dir), site_predictions(spark, sf_dir), keys=TYPED)
    missed = missed.where("high_confidence")
    low, high = T.bed_window(F.col("site_type"), F.col("strand"), F.col("position"))
    return bed_lines(
        missed.select(
            "chrom", low.alias("s"), high.alias("e"), F.concat("site_type", F.lit("_FN_"), "position").alias("name"),
            (F.col("probability") * 1000).cast("int").alias("score"), "strand",
        )
    )


@query(
    "srt_01_multi_key_sort",
    with_views("select chrom, pred_prob, transcript_id from v_tx join v_score using (transcript_id) order by pred_prob desc, chrom, transcript_id", "v_tx", "v_score"),
)
def srt_01(spark, sf_dir):
    rows = view(spark, sf_dir, "v_tx").join(view(spark, sf_dir, "v_score"), "transcript_id")
    return rows.select("chrom", "pred_prob", "transcript_id").orderBy(F.desc("pred_prob"), "chrom", "transcript_id")


@query("srt_02_top_n", with_views("select transcript_id, pred_prob from v_score order by pred_prob desc, transcript_id limit 40", "v_score"))
def srt_02(spark, sf_dir):
    return view(spark, sf_dir, "v_score").select("transcript_id", "pred_prob").orderBy(F.desc("pred_prob"), "transcript_id").limit(40)


@query(
    "set_02_training_union",
    with_views(
        f"""with {SITES_SQL} select 'tx' as source, site_type, chrom, strand, position from site union all select assembler_id, 'TSS', chrom, strand, tss from v_assembly
        union all select assembler_id, 'TES', chrom, strand, tes from v_assembly""",
        "v_tx", "v_assembly",
    ),
)
def set_02(spark, sf_dir):
    """Sites of both types, of the transcripts and of every assembly, one frame to train on."""
    tx = tx_sites(spark, sf_dir).select(F.lit("tx").alias("source"), "site_type", "chrom", "strand", "position")
    asm = view(spark, sf_dir, "v_assembly").selectExpr(
        "assembler_id as source", "stack(2, 'TSS', tss, 'TES', tes) as (site_type, position)", "chrom", "strand"
    )
    return tx.unionByName(asm)
