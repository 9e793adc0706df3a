"""Queries on transcripts: coverage tables, joins with scores and labels, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from endsight.operators import ranking as K
from endsight.operators import transcripts as T
from endsight.plans.catalog import query, r6
from endsight.plans.catalog_sites import LABELED_SQL, SITES_SQL, labeled_sites, tx_sites
from endsight.plans.views import table, view, with_views


def rnd(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def coverage(spark, sf_dir):
    return T.coverage_table(
        view(spark, sf_dir, "v_tx"), view(spark, sf_dir, "v_exon"),
        start="tx_start", end="tx_end", exon_start="exon_start", exon_end="exon_end",
    )


COV_SQL = """
ex as (select transcript_id, greatest(exon_end - exon_start + 1, 0) as len,
         row_number() over (partition by transcript_id order by exon_start, exon_end) as a,
         row_number() over (partition by transcript_id order by exon_start desc, exon_end desc) as d from v_exon),
st as (select transcript_id, count(*) as exon_count, sum(len)::bigint as total_exon_length, max(len) as max_exon_length,
         min(len) as min_exon_length, max(len) filter (a = 1) as lm, max(len) filter (d = 1) as rm from ex group by 1),
cov as (
  select t.transcript_id, s as strand, chrom as tss_chrom, chrom as tes_chrom,
    case when s = '+' then tx_start + 1 else tx_end end as tss_pos,
    case when s = '+' then tx_end else tx_start + 1 end as tes_pos, coverage,
    coalesce(case when s = '+' then lm else rm end, 0) as first_exon_length,
    coalesce(case when s = '+' then rm else lm end, 0) as last_exon_length,
    coalesce(max_exon_length, 0) as max_exon_length, coalesce(min_exon_length, 0) as min_exon_length,
    coalesce(total_exon_length::double / exon_count, 0) as mean_exon_length,
    coalesce(total_exon_length, 0) as total_exon_length, coalesce(exon_count, 0) as exon_count
  from (select *, unnest(case strand when '.' then ['+','-'] else [strand] end) as s from v_tx) t
  left join st using (transcript_id))"""


@query(
    "agg_01_exon_stats",
    with_views(
        f"with {COV_SQL} select * exclude (mean_exon_length, coverage), {rnd('mean_exon_length')} as mean_exon_length, {rnd('coverage')} as coverage from cov",
        "v_tx", "v_exon",
    ),
)
def agg_01(spark, sf_dir):
    return coverage(spark, sf_dir).withColumns(
        {"mean_exon_length": r6("mean_exon_length"), "coverage": r6("coverage")}
    )


@query(
    "agg_03_multi_exon_count",
    with_views(
        "select count(*) filter (n > 1) as multi_exon_transcripts from (select transcript_id, count(*) as n from v_exon group by 1)",
        "v_exon",
    ),
)
def agg_03(spark, sf_dir):
    return T.multi_exon_count(view(spark, sf_dir, "v_exon"))


SCORED_SQL = (
    SITES_SQL
    + """,
scored as (select s.*, coalesce(p.p_site_rf, 0.5) as probability
           from site s left join (select * from v_score where p_site_rf >= 0.2) p using (transcript_id)),
best as (select * from (select *, row_number() over (partition by chrom, position, strand, site_type
           order by probability desc, transcript_id) as rn from scored) where rn = 1)"""
)


def scored_sites(spark, sf_dir):
    scores = view(spark, sf_dir, "v_score").where("p_site_rf >= 0.2")
    joined = T.site_probabilities(tx_sites(spark, sf_dir), scores, ["transcript_id"], ["p_site_rf"])
    return joined.withColumnRenamed("p_site_rf", "probability")


@query(
    "jon_05_score_left_join",
    with_views(f"with {SCORED_SQL} select * from scored", "v_tx", "v_score"),
)
def jon_05(spark, sf_dir):
    return scored_sites(spark, sf_dir)


@query(
    "win_01_best_row_per_site",
    with_views(f"with {SCORED_SQL} select * exclude (rn) from best", "v_tx", "v_score"),
)
def win_01(spark, sf_dir):
    return T.best_row_per_site(scored_sites(spark, sf_dir))


def merged(spark, sf_dir, by_strand=True):
    best = T.best_row_per_site(scored_sites(spark, sf_dir)).select(
        "chrom", "position", "strand", "site_type", "probability"
    )
    tss = best.where("site_type = 'TSS'").drop("site_type")
    tes = best.where("site_type = 'TES'").drop("site_type")
    return T.merge_cov_sites(coverage(spark, sf_dir), tss, tes, by_strand=by_strand)


MERGED_SQL = f"""{SCORED_SQL}, {COV_SQL},
merged as (select c.*, a.probability as probability_tss, b.probability as probability_tes from cov c
  join best a on a.site_type = 'TSS' and a.chrom = c.tss_chrom and a.position = c.tss_pos and a.strand = c.strand
  join best b on b.site_type = 'TES' and b.chrom = c.tes_chrom and b.position = c.tes_pos and b.strand = c.strand)"""


@query(
    "jon_06_cov_tss_tes",
    with_views(
        f"""with {MERGED_SQL} select transcript_id, strand, tss_pos, tes_pos,
            case when tss_chrom like 'chr%' then tss_chrom else 'chr' || tss_chrom end as tss_chrom,
            case when tes_chrom like 'chr%' then tes_chrom else 'chr' || tes_chrom end as tes_chrom,
            probability_tss, probability_tes, exon_count from merged""",
        "v_tx", "v_exon", "v_score",
    ),
)
def jon_06(spark, sf_dir):
    return merged(spark, sf_dir).select(
        "transcript_id", "strand", "tss_chrom", "tss_pos", "tes_chrom", "tes_pos",
        "probability_tss", "probability_tes", "exon_count",
    )


@query(
    "jon_07_cov_tss_tes_legacy",
    with_views(
        f"""with {SCORED_SQL}, {COV_SQL}
        select c.transcript_id, c.strand, c.tss_pos, c.tes_pos, a.probability as probability_tss, b.probability as probability_tes
        from cov c join best a on a.site_type = 'TSS' and a.chrom = c.tss_chrom and a.position = c.tss_pos
        join best b on b.site_type = 'TES' and b.chrom = c.tes_chrom and b.position = c.tes_pos""",
        "v_tx", "v_exon", "v_score",
    ),
)
def jon_07(spark, sf_dir):
    return merged(spark, sf_dir, by_strand=False).select(
        "transcript_id", "strand", "tss_pos", "tes_pos", "probability_tss", "probability_tes"
    )


DERIVED = {
    "transcript_length": "abs(tes_pos - tss_pos)",
    "log_transcript_length": "ln(1 + abs(tes_pos - tss_pos))",
    "tss_confidence": "probability_tss",
    "tes_confidence": "probability_tes",
    "min_confidence": "least(probability_tss, probability_tes)",
    "confidence_product": "probability_tss * probability_tes",
    "exon_density": "exon_count::double / greatest(abs(tes_pos - tss_pos), 1)",
    "confidence_exon_interaction": "probability_tss * probability_tes * exon_count",
    "coverage_per_exon": "coverage / greatest(exon_count, 1)",
    "avg_exon_length": "total_exon_length::double / greatest(exon_count, 1)",
    "exon_length_ratio": "max_exon_length::double / greatest(min_exon_length, 1)",
    "coverage_length_ratio": "coverage / greatest(abs(tes_pos - tss_pos), 1)",
    "confidence_coverage_interaction": "probability_tss * probability_tes * coverage",
    "confidence_sum": "probability_tss + probability_tes",
    "confidence_diff": "abs(probability_tss - probability_tes)",
    "terminal_exon_ratio": "first_exon_length::double / greatest(last_exon_length, 1)",
    "exon_efficiency": "mean_exon_length / greatest(abs(tes_pos - tss_pos), 1)",
    "log_coverage": "ln(1 + coverage)",
    "exon_length_entropy": "ln(1 + (max_exon_length - min_exon_length) / greatest(mean_exon_length, 1.0))",
    "exon_length_std": "0.0::double",
    "exon_length_skewness": "max_exon_length - mean_exon_length",
}


# Decimal places per column: quotients of decimal prices end in ties at six places.
PLACES = {"coverage_per_exon": 9, "coverage_length_ratio": 10, "confidence_coverage_interaction": 11}


@query(
    "prj_23_stage2_derived",
    with_views(
        f"with {MERGED_SQL} select transcript_id, strand, tss_pos, tes_pos, "
        + ", ".join(
            f"{e} as {c}" if c == "transcript_length" else f"round({e}, {PLACES.get(c, 6)}) + 0.0 as {c}"
            for c, e in DERIVED.items()
        )
        + " from merged",
        "v_tx", "v_exon", "v_score",
    ),
)
def prj_23(spark, sf_dir):
    rows = T.derived_features(merged(spark, sf_dir))
    return rows.select(
        "transcript_id", "strand", "tss_pos", "tes_pos", "transcript_length",
        *[F.round(c, PLACES.get(c, 6)).alias(c) for c in DERIVED if c != "transcript_length"],
    )


def labels(spark, sf_dir):
    return view(spark, sf_dir, "v_tmap").selectExpr(
        "qry_id as transcript_id", "int(class_code = '=') as label", "ref_id"
    )


@query(
    "jon_08_tmap_label_join",
    with_views(
        f"""with {COV_SQL} select c.transcript_id, c.strand, c.exon_count, (m.class_code = '=')::int as label
            from cov c join v_tmap m on m.qry_id = c.transcript_id""",
        "v_tx", "v_exon", "v_tmap",
    ),
)
def jon_08(spark, sf_dir):
    return T.label_join(coverage(spark, sf_dir), labels(spark, sf_dir)).select(
        "transcript_id", "strand", "exon_count", "label"
    )


def joined_scores(spark, sf_dir):
    ranked = view(spark, sf_dir, "v_score").select("transcript_id", "pred_prob")
    cov = view(spark, sf_dir, "v_tx").select("transcript_id", "coverage")
    return T.ranked_cov_labels(ranked, cov, labels(spark, sf_dir))


JOINED_SQL = """
joined as (select transcript_id, pred_prob, coverage, (class_code = '=')::int as label, ref_id
  from (select transcript_id, max(pred_prob) as pred_prob from v_score group by 1)
  join (select transcript_id, max(coverage) as coverage from v_tx group by 1) using (transcript_id)
  join (select qry_id as transcript_id, class_code, ref_id from v_tmap) using (transcript_id))"""


def ap_sql(source: str, by: str, label: str, score: str) -> str:
    """CTEs computing average precision and ROC AUC per group from raw rows."""
    return f"""
tie as (select {by}, {score} as s, sum({label})::bigint as pos, count(*) as n from {source} where {score} is not null group by all),
run as (select *, sum(pos) over w as cp, sum(n) over w as cn, sum(pos) over g as p, sum(n) over g as t from tie
        window w as (partition by {by} order by s desc rows unbounded preceding), g as (partition by {by})),
ap as (select {by}, max(t)::bigint as n_items, max(p)::bigint as n_positive,
        case when max(p) > 0 and max(p) < max(t) then round(sum(pos::double / p * (cp::double / cn)), 6) end as aupr,
        case when max(p) > 0 and max(p) < max(t)
             then round(sum((n - pos)::double * (cp - pos / 2.0::double) / (p::double * (t - p))), 6) end as roc_auc
       from run group by {by})"""


@query(
    "jon_09_ranked_cov_tmap",
    with_views(
        f"with {JOINED_SQL} select transcript_id, pred_prob, {rnd('coverage')} as coverage, label, ref_id from joined",
        "v_score", "v_tx", "v_tmap",
    ),
)
def jon_09(spark, sf_dir):
    return joined_scores(spark, sf_dir).withColumn("coverage", r6("coverage"))


@query(
    "jon_10_site_mean_coverage",
    with_views(
        f"""with {SCORED_SQL}, {COV_SQL},
        m as (select 'TSS' as site_type, tss_chrom as chrom, tss_pos as position, strand, avg(coverage) as c from cov group by all
              union all select 'TES', tes_chrom, tes_pos, strand, avg(coverage) from cov group by all)
        select s.transcript_id, s.site_type, case when s.chrom like 'chr%' then s.chrom else 'chr' || s.chrom end as chrom,
               s.position, s.strand, s.probability, round(m.c, 9) as coverage
        from scored s join m using (site_type, chrom, position, strand)""",
        "v_tx", "v_exon", "v_score",
    ),
)
def jon_10(spark, sf_dir):
    joined = T.site_mean_coverage(scored_sites(spark, sf_dir), coverage(spark, sf_dir))
    return joined.select(
        "transcript_id", "site_type", "chrom", "position", "strand", "probability", F.round("coverage", 9).alias("coverage")
    )


@query(
    "agg_19_mean_cov_by_coord",
    with_views(
        f"""with {COV_SQL} select tss_chrom, tss_pos, strand, round(avg(coverage), 9) as mean_coverage,
            {rnd('max(coverage)')} as max_coverage from cov group by all""",
        "v_tx", "v_exon",
    ),
)
def agg_19(spark, sf_dir):
    return coverage(spark, sf_dir).groupBy("tss_chrom", "tss_pos", "strand").agg(
        F.round(F.avg("coverage"), 9).alias("mean_coverage"), r6(F.max("coverage")).alias("max_coverage")
    )


@query(
    "win_02_best_row_per_tx",
    with_views(
        """select transcript_id, site_type, probability from (
             select ref_id as transcript_id, qry_id as site_type, round(cov, 6) as probability,
               row_number() over (partition by ref_id order by cov desc, qry_id desc) as rn from v_tmap) where rn = 1""",
        "v_tmap",
    ),
)
def win_02(spark, sf_dir):
    rows = view(spark, sf_dir, "v_tmap").selectExpr(
        "ref_id as transcript_id", "qry_id as site_type", "cov as probability"
    )
    return T.best_row_per_transcript(rows, "probability").withColumn("probability", r6("probability"))


@query(
    "jon_26_exact_structure_match",
    with_views(
        """with ex as (select distinct transcript_id, exon_start, exon_end from v_exon),
        g as (select transcript_id, list(struct_pack(s := exon_start, e := exon_end) order by exon_start, exon_end) as x from ex group by 1),
        ch as (select transcript_id, list_aggregate([concat(x[i].e, '-', x[i + 1].s) for i in range(1, len(x))], 'string_agg', ',') as chain
               from g where len(x) > 1),
        q as (select t.transcript_id, t.chrom, t.strand, ch.chain, t.oid from (select transcript_id, chrom, strand, substr(transcript_id, 4)::bigint as oid from v_tx) t join ch using (transcript_id)),
        r as (select chrom, strand, chain, min(transcript_id) as ref_id from q where oid % 3 = 0 group by all)
        select q.transcript_id, r.ref_id, case when r.ref_id is not null then '=' else 'u' end as class_code
        from q left join r using (chrom, strand, chain)""",
        "v_tx", "v_exon",
    ),
)
def jon_26(spark, sf_dir):
    chains = T.intron_chains(
        view(spark, sf_dir, "v_tx"), view(spark, sf_dir, "v_exon"), start="exon_start", end="exon_end"
    )
    annotated = chains.where("bigint(substring(transcript_id, 4)) % 3 = 0")
    return T.exact_structure_match(chains, annotated)


BED_SQL = """with ex as (select distinct e.transcript_id, t.chrom, t.strand, exon_start as s, exon_end as e
             from v_exon e join v_tx t using (transcript_id) where exon_start < exon_end and t.strand in ('+', '-')),
        g as (select transcript_id, any_value(chrom) as chrom, any_value(strand) as strand, min(s) as lo, max(e) as hi, count(*) as n,
                string_agg((e - s + 1)::varchar, ',' order by s, e) as block_sizes from ex group by 1)
        select chrom, lo - 1 as chrom_start, hi as chrom_end, transcript_id as name, 0 as score, strand, lo - 1 as thick_start, hi as thick_end,
          '0,0,0' as rgb, n::int as block_count, block_sizes,
          (select string_agg((ex.s - g.lo)::varchar, ',' order by ex.s, ex.e) from ex where ex.transcript_id = g.transcript_id) as block_starts
        from g"""


@query("agg_42_bed12_blocks", with_views(BED_SQL, "v_tx", "v_exon"))
def agg_42(spark, sf_dir):
    tx = view(spark, sf_dir, "v_tx").select("transcript_id", "chrom", "strand")
    exons = view(spark, sf_dir, "v_exon").join(tx, "transcript_id")
    return T.bed12(exons, order=F.col("exon_start"), start="exon_start", end="exon_end")


LABELED_SCORES_SQL = f"""{LABELED_SQL},
pred as (select chrom, position, site_type, max(p_site_rf) as probability from site join v_score using (transcript_id) group by all),
lab as (select chrom, position, strand, site_type, max(label) as label from labeled group by all)"""


# Sites of both types go through one join.
TYPED = ("chrom", "position", "site_type")


def site_predictions(spark, sf_dir):
    joined = tx_sites(spark, sf_dir).join(view(spark, sf_dir, "v_score"), "transcript_id")
    return joined.groupBy("chrom", "position", "site_type").agg(F.max("p_site_rf").alias("probability"))


def site_labels(spark, sf_dir):
    return labeled_sites(spark, sf_dir).groupBy("chrom", "position", "strand", "site_type").agg(F.max("label").alias("label"))


@query(
    "jon_15_false_negatives",
    with_views(
        f"""with {LABELED_SCORES_SQL} select chrom, position, strand, site_type, label, probability, probability < 1 - 0.9 as high_confidence
            from lab join pred using (chrom, position, site_type) where label = 1 and probability < 0.5""",
        "v_tx", "v_ref_site", "v_score",
    ),
)
def jon_15(spark, sf_dir):
    return T.false_negatives(site_labels(spark, sf_dir), site_predictions(spark, sf_dir), keys=TYPED)


@query(
    "jon_25_prediction_truth_join",
    with_views(
        f"""with {LABELED_SCORES_SQL}
            select chrom, position, site_type, probability, label, case when label = 1 and probability > 0.5 then 'TP' when label = 0 and probability > 0.5 then 'FP'
              when label = 0 then 'TN' else 'FN' end as outcome
            from pred join lab using (chrom, position, site_type)""",
        "v_tx", "v_ref_site", "v_score",
    ),
)
def jon_25(spark, sf_dir):
    return T.prediction_truth(site_predictions(spark, sf_dir), site_labels(spark, sf_dir), keys=TYPED)


@query(
    "jon_24_label_agreement",
    with_views(
        f"""with {LABELED_SQL} select transcript_id, site_type, strand, label as site_label, (class_code = '=')::int as transcript_label
            from labeled join v_tmap on qry_id = transcript_id where label <> (class_code = '=')::int""",
        "v_tx", "v_ref_site", "v_tmap",
    ),
)
def jon_24(spark, sf_dir):
    sites = labeled_sites(spark, sf_dir).selectExpr("transcript_id", "site_type", "strand", "label as site_label")
    return T.label_disagreement(sites, labels(spark, sf_dir).selectExpr("transcript_id", "label as transcript_label"))


@query(
    "prj_30_bed_window",
    with_views(
        f"""with {SITES_SQL} select transcript_id, site_type, chrom, position, strand,
            case when (site_type = 'TSS') = (strand = '+') then position else position - 100 end as win_start,
            case when (site_type = 'TSS') = (strand = '+') then position + 100 else position end as win_end from site""",
        "v_tx",
    ),
)
def prj_30(spark, sf_dir):
    low, high = T.bed_window(F.col("site_type"), F.col("strand"), F.col("position"))
    return tx_sites(spark, sf_dir).withColumns({"win_start": low, "win_end": high})


@query(
    "agg_45_merge_cardinality",
    with_views(
        f"""with {MERGED_SQL} select 'cov' as step, count(*) as rows from cov union all select 'after_sites', count(*) from merged
            union all select 'after_labels', count(*) from merged join v_tmap on qry_id = transcript_id""",
        "v_tx", "v_exon", "v_score", "v_tmap",
    ),
)
def agg_45(spark, sf_dir):
    rows = merged(spark, sf_dir)
    return T.join_cardinality(
        {"cov": coverage(spark, sf_dir), "after_sites": rows, "after_labels": T.label_join(rows, labels(spark, sf_dir))}
    )


# ---- rankings on labelled documents and on the match table ----

DOC_SQL = "doc as (select d.doc_id, d.lang, d.source, d.n_chars, l.quality as y from labels l join documents d using (doc_id))"


def labelled_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf_dir, "labels").selectExpr("doc_id", "quality as y").join(docs, "doc_id")


@query(
    "agg_23_average_precision",
    f"with {DOC_SQL}, {ap_sql('doc', 'lang', 'y', 'n_chars')} select lang, n_items, n_positive, aupr from ap",
)
def agg_23(spark, sf_dir):
    ap = K.average_precision(labelled_docs(spark, sf_dir), by=["lang"], label="y", score="n_chars")
    return ap.select("lang", "n_items", "n_positive", r6("aupr").alias("aupr"))


@query(
    "agg_22_roc_auc",
    f"with {DOC_SQL}, {ap_sql('doc', 'source', 'y', 'n_chars')} select source, n_items, n_positive, roc_auc from ap",
)
def agg_22(spark, sf_dir):
    ap = K.average_precision(labelled_docs(spark, sf_dir), by=["source"], label="y", score="n_chars")
    return ap.select("source", "n_items", "n_positive", r6("roc_auc").alias("roc_auc"))


@query(
    "win_03_pr_curve",
    f"""with {DOC_SQL}, {ap_sql('doc', 'lang', 'y', 'n_chars')}
    select lang, s::double as threshold, {rnd('cp::double / cn')} as precision, {rnd('coalesce(cp::double / nullif(p, 0), 1.0)')} as recall from run
    union all select distinct lang, null::double, 1.0::double, 0.0::double from doc""",
)
def win_03(spark, sf_dir):
    curve = K.pr_curve(labelled_docs(spark, sf_dir), by=["lang"], label="y", score="n_chars")
    return curve.withColumns({"precision": r6("precision"), "recall": r6("recall")})


TOPK_SQL = f"""{DOC_SQL},
o as (select lang, y, row_number() over w as k, sum(y) over w as tp, sum(y) over (partition by lang) as p from doc
      window w as (partition by lang order by n_chars desc, doc_id rows unbounded preceding)),
c as (select lang, k, tp::double / k as precision, coalesce(tp::double / nullif(p, 0), 0.0) as recall from o)"""


@query(
    "win_04_topk_coverage_curve",
    f"with {TOPK_SQL} select lang, k, {rnd('precision')} as precision, {rnd('recall')} as recall from c where (k - 1) % 10 = 0",
)
def win_04(spark, sf_dir):
    curve = K.topk_curve(
        labelled_docs(spark, sf_dir), by=["lang"], label="y", score="n_chars", tie=[F.col("doc_id")], step=10
    )
    return curve.withColumns({"precision": r6("precision"), "recall": r6("recall")})


@query(
    "win_04_topk_curve_area",
    f"""with {TOPK_SQL}, s as (select *, lag(precision) over w as pp, lag(recall) over w as pr from c window w as (partition by lang order by k))
    select lang, {rnd('coalesce(sum((recall - pr) * (precision + pp) / 2), 0)')} as area from s group by lang""",
)
def win_04_area(spark, sf_dir):
    curve = K.topk_curve(labelled_docs(spark, sf_dir), by=["lang"], label="y", score="n_chars", tie=[F.col("doc_id")])
    return K.trapezoid_area(curve, by=["lang"]).withColumn("area", r6("area"))


PRED_SQL = f"{DOC_SQL}, pd as (select lang, y, (n_chars >= 1500)::int as pred from doc)"
CONFUSION_SQL = """cm as (select lang, count(*) filter (y = 0 and pred = 0) as tn, count(*) filter (y = 0 and pred = 1) as fp,
  count(*) filter (y = 1 and pred = 0) as fn, count(*) filter (y = 1 and pred = 1) as tp from pd group by 1)"""


def predicted_docs(spark, sf_dir):
    return labelled_docs(spark, sf_dir).selectExpr("lang", "y", "int(n_chars >= 1500) as pred")


@query(
    "agg_20_class_metrics",
    f"""with {PRED_SQL}, {CONFUSION_SQL} select lang, tn, fp, fn, tp, {rnd('(tp + tn)::double / (tn + fp + fn + tp)')} as accuracy,
      {rnd('coalesce(tp::double / nullif(tp + fp, 0), 0)')} as precision, {rnd('coalesce(tp::double / nullif(tp + fn, 0), 0)')} as recall,
      {rnd('coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0)')} as f1, {rnd('(tp + fn)::double / (tn + fp + fn + tp)')} as positive_rate from cm""",
)
def agg_20(spark, sf_dir):
    m = K.classification_metrics(predicted_docs(spark, sf_dir), by=["lang"], label="y", prediction="pred")
    return m.withColumns({c: r6(c) for c in ("accuracy", "precision", "recall", "f1", "positive_rate")})


@query(
    "agg_21_macro_metrics",
    f"""with {PRED_SQL}, {CONFUSION_SQL} select lang, {rnd('(tp + tn)::double / (tn + fp + fn + tp)')} as accuracy,
      {rnd('(coalesce(tp::double / nullif(tp + fp, 0), 0) + coalesce(tn::double / nullif(tn + fn, 0), 0)) / 2')} as macro_precision,
      {rnd('(coalesce(tp::double / nullif(tp + fn, 0), 0) + coalesce(tn::double / nullif(tn + fp, 0), 0)) / 2')} as macro_recall,
      {rnd('(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0::double * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2')} as macro_f1,
      tp + fn as support_1, tn + fp as support_0 from cm""",
)
def agg_21(spark, sf_dir):
    m = K.macro_metrics(predicted_docs(spark, sf_dir), by=["lang"], label="y", prediction="pred")
    return m.withColumns({c: r6(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")})


@query(
    "agg_46_prediction_accuracy",
    f"with {PRED_SQL} select lang, {rnd('avg((y = pred)::int)')} as accuracy, count(*) filter (y <> pred) as mismatches from pd group by lang",
)
def agg_46(spark, sf_dir):
    return predicted_docs(spark, sf_dir).groupBy("lang").agg(
        r6(F.expr("avg(int(y = pred))")).alias("accuracy"), F.expr("count_if(y <> pred) as mismatches")
    )


def matches(spark, sf_dir):
    """v_tmap with a file order and a grouping key (the reference catalogue)."""
    return view(spark, sf_dir, "v_tmap").selectExpr(
        "bigint(substring(qry_id, 4)) % 4 as test_id", "ref_id", "class_code", "cov", "tpm", "fpkm",
        "bigint(substring(qry_id, 4)) as row_no",
    )


MATCH_SQL = """m as (select substr(qry_id, 4)::bigint % 4 as test_id, substr(qry_id, 4)::bigint as row_no, ref_id, class_code, cov, tpm, fpkm from v_tmap)"""


def roc_sql(measure: str) -> str:
    return with_views(
        f"""with {MATCH_SQL},
        o as (select *, row_number() over (partition by test_id order by {measure}, row_no) - 1 as i, count(*) over (partition by test_id) as n,
                lag(class_code) over (partition by test_id order by {measure}, row_no) as prev from m),
        f as (select *, (class_code = '=' and i = max(case when class_code = '=' then i end) over (partition by test_id, ref_id))::int as lastm from o),
        r as (select *, sum(lastm) over (partition by test_id order by i rows between current row and unbounded following) as found,
                sum(lastm) over (partition by test_id) as total from f)
        select test_id, i as idx, round(found / 300.0::double, 6) as recall, round(found / (n - i)::double, 6) as precision
        from r where (total - found) % 10 = 0 and (i = 0 or prev = '=')""",
        "v_tmap",
    )


@query("win_05_roc_sweep", roc_sql("cov"))
def win_05(spark, sf_dir):
    return K.roc_sweep(matches(spark, sf_dir), F.lit(300), by=["test_id"])


@query("win_07_measure_switch", roc_sql("tpm"))
def win_07(spark, sf_dir):
    return K.roc_sweep(matches(spark, sf_dir), F.lit(300), by=["test_id"], measure="TPM")


@query(
    "win_06_sweep_auc",
    with_views(
        f"""with {MATCH_SQL},
        o as (select test_id, row_number() over w - 1 as i, count(*) over (partition by test_id) as n,
                sum((class_code = '=')::int) over (partition by test_id order by cov, row_no rows between current row and unbounded following) as q
              from m window w as (partition by test_id order by cov, row_no)),
        p as (select test_id, i, q * 100.0::double / 300 as s, q * 100.0::double / (n - i) as p from o),
        l as (select *, lag(s) over w as s0, lag(p) over w as p0 from p window w as (partition by test_id order by i))
        select test_id, round(sum(case when i = 0 then s * p else (s + s0) * 0.5::double * (p - p0) end), 4) + 0.0 as auc from l group by test_id""",
        "v_tmap",
    ),
)
def win_06(spark, sf_dir):
    auc = K.sweep_auc(matches(spark, sf_dir), F.lit(300), by=["test_id"])
    return auc.withColumn("auc", F.round("auc", 4))


@query(
    "agg_24_tmap_counts",
    with_views(
        f"with {MATCH_SQL} select test_id, count(*) filter (length(class_code) = 1) as n_total, count(*) filter (class_code = '=') as n_positive from m group by 1",
        "v_tmap",
    ),
)
def agg_24(spark, sf_dir):
    return K.match_counts(matches(spark, sf_dir), by=["test_id"])


@query(
    "prj_32_prob_threshold_filter",
    with_views("select transcript_id, pred_prob from v_score where pred_prob >= 0.5", "v_score"),
)
def prj_32(spark, sf_dir):
    return view(spark, sf_dir, "v_score").where("pred_prob >= 0.5").select("transcript_id", "pred_prob")


@query(
    "snk_08_pr_summary",
    with_views(
        f"""with {JOINED_SQL}, curves as (select 'model' as curve, label, pred_prob as s0 from joined union all select 'baseline', label, coverage from joined),
        {ap_sql('curves', 'curve', 'label', 's0')}
        select curve, aupr, n_items, n_positive, 'coverage' as abundance_column from ap""",
        "v_score", "v_tx", "v_tmap",
    ),
)
def snk_08(spark, sf_dir):
    rows = joined_scores(spark, sf_dir).selectExpr(
        "label", "stack(2, 'model', pred_prob, 'baseline', coverage) as (curve, score)"
    )
    ap = K.average_precision(rows, by=["curve"], label="label", score="score")
    return ap.select("curve", r6("aupr").alias("aupr"), "n_items", "n_positive", F.lit("coverage").alias("abundance_column"))
