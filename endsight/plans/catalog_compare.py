"""Queries on run comparisons and cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from endsight.operators import cohorts as H
from endsight.operators import compare as C
from endsight.operators import ranking as K
from endsight.plans.catalog import query, r6
from endsight.plans.views import table, view, with_views


def rnd(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


RUNS = """select concat(data_type, '__train_', train_annotation, '__test_', test_annotation,
  case when test_id like '%5' then '__v2' else '' end) as run_id, v_run.* from {v_run} v_run"""
RUNS_SQL = "runs as (" + RUNS.format(v_run="v_run") + ")"


def runs(spark, sf_dir):
    return spark.sql(RUNS, v_run=view(spark, sf_dir, "v_run"))


LONG_SQL = f"""{RUNS_SQL},
cmp as (select run_id, test_id, data_type, train_annotation, test_annotation, '' as run_variant, assembler_id, 'stage1_tss' as metric_group, model, mv as model_value,
   stage1_test_aupr_tss_baseline as baseline_value, mv - stage1_test_aupr_tss_baseline as delta_vs_baseline,
   (mv - stage1_test_aupr_tss_baseline) / (abs(stage1_test_aupr_tss_baseline) + 1e-12) as relative_gain, mv - stage1_test_aupr_tss_baseline > 0 as win_vs_baseline
  from (select *, 'rf' as model, stage1_test_aupr_tss_rf as mv from runs union all select *, 'xgb', stage1_test_aupr_tss_xgb from runs) where mv is not null)"""


def comparison(spark, sf_dir):
    return C.comparison_table(runs(spark, sf_dir))


# gains relative to a zero baseline reach 1e12, so they are compared at fewer places
@query(
    "set_06_unpivot_metrics",
    with_views(
        f"""with {LONG_SQL} select run_id, test_id, data_type, train_annotation, test_annotation, run_variant, assembler_id, metric_group, model, model_value,
        baseline_value, {rnd('delta_vs_baseline')} as delta_vs_baseline, case when baseline_value <> 0 then {rnd('relative_gain')} end as relative_gain, win_vs_baseline from cmp""",
        "v_run",
    ),
)
def set_06(spark, sf_dir):
    return comparison(spark, sf_dir).select(
        "run_id", "test_id", "data_type", "train_annotation", "test_annotation", "run_variant", "assembler_id", "metric_group",
        "model", "model_value", "baseline_value", r6("delta_vs_baseline").alias("delta_vs_baseline"),
        F.when(F.col("baseline_value") != 0, r6("relative_gain")).alias("relative_gain"), "win_vs_baseline",
    )


def rates_sql(keys: str) -> str:
    return with_views(
        f"""with {LONG_SQL} select {keys}, count(*) as n, {rnd('avg(win_vs_baseline::int)')} as win_rate, {rnd('median(delta_vs_baseline)')} as delta_median,
        {rnd('avg(delta_vs_baseline)')} as delta_mean, {rnd('median(relative_gain)')} as rel_median from cmp group by all""",
        "v_run",
    )


CASE = ["metric_group", "data_type", "assembler_id", "model"]


def rates(spark, sf_dir, keys):
    out = C.win_rates(comparison(spark, sf_dir), keys)
    return out.select(*keys, "n", *[r6(c).alias(c) for c in ("win_rate", "delta_median", "delta_mean", "rel_median")])


@query("agg_26_win_rate_summary", rates_sql(", ".join(CASE)))
def agg_26(spark, sf_dir):
    return rates(spark, sf_dir, CASE)


@query("agg_27_by_case_summary", rates_sql(", ".join([*CASE, "train_annotation", "test_annotation"])))
def agg_27(spark, sf_dir):
    return rates(spark, sf_dir, [*CASE, "train_annotation", "test_annotation"])


@query(
    "agg_28_heatmap_matrix",
    with_views(
        f"""with {LONG_SQL} select assembler_id, data_type, model, train_annotation, round(avg(win_vs_baseline::int) filter (test_annotation = 'ensembl'), 6) as ensembl,
        round(avg(win_vs_baseline::int) filter (test_annotation = 'gencode'), 6) as gencode, round(avg(win_vs_baseline::int) filter (test_annotation = 'refseq'), 6) as refseq from cmp group by all""",
        "v_run",
    ),
)
def agg_28(spark, sf_dir):
    return C.heatmap(
        comparison(spark, sf_dir), ["assembler_id", "data_type", "model"], "round(avg(double(win_vs_baseline)), 6)",
        ["ensembl", "gencode", "refseq"],
    )


@query(
    "prj_17_run_id_parse",
    with_views(
        f"""with {RUNS_SQL} select test_id, run_id, split_part(run_id, '__', 1) as data_type, substr(split_part(run_id, '__', 2), 7) as train_annotation,
        substr(split_part(run_id, '__', 3), 6) as test_annotation, split_part(run_id, '__', 4) as run_variant from runs""",
        "v_run",
    ),
)
def prj_17(spark, sf_dir):
    return runs(spark, sf_dir).select("test_id", "run_id", *[c.alias(n) for n, c in C.parse_run_id(F.col("run_id")).items()])


DATA_SQL = """ds as (select test_id, assembler_id as tool, case s % 5 when 0 then 'pacbio_ENC' || s when 1 then 'cDNA-K' || s when 2 then 'dRNA-N' || s when 3 then 'SRR' || s else 'misc' || s end as dataset,
  rf, xgb, bl from (select test_id, assembler_id, substr(test_id, 2)::int as s, stage1_test_aupr_tss_rf as rf, stage1_test_aupr_tss_xgb as xgb, stage1_test_aupr_tss_baseline as bl from v_run))"""


def datasets(spark, sf_dir):
    return view(spark, sf_dir, "v_run").withColumn("s", F.expr("int(substring(test_id, 2))")).selectExpr(
        "test_id", "assembler_id as tool",
        "case s % 5 when 0 then concat('pacbio_ENC', s) when 1 then concat('cDNA-K', s) when 2 then concat('dRNA-N', s) when 3 then concat('SRR', s) else concat('misc', s) end as dataset",
        "stage1_test_aupr_tss_rf as rf", "stage1_test_aupr_tss_xgb as xgb", "stage1_test_aupr_tss_baseline as bl",
    )


@query(
    "prj_18_dataset_tool_split",
    with_views(
        f"with {DATA_SQL} select test_id, dataset, tool as assembler from (select test_id, dataset, tool from ds)",
        "v_run",
    ),
)
def prj_18(spark, sf_dir):
    dataset, tool = C.split_data_name(F.concat_ws("_", "dataset", "tool"))
    return datasets(spark, sf_dir).select("test_id", dataset.alias("dataset"), tool.alias("assembler"))


@query(
    "prj_19_dataset_group",
    with_views(
        f"with {DATA_SQL} select dataset, case left(dataset, 3) when 'pac' then 'pacbio' when 'cDN' then 'cdna' when 'dRN' then 'drna' when 'SRR' then 'srr' else 'other' end as grp, case left(dataset, 3) when 'pac' then 0 when 'cDN' then 1 when 'dRN' then 2 when 'SRR' then 3 else 4 end as sort_key from ds",
        "v_run",
    ),
)
def prj_19(spark, sf_dir):
    g = C.dataset_group(F.col("dataset"))
    return datasets(spark, sf_dir).select("dataset", g.alias("grp"), C.group_sort_key(g).alias("sort_key"))


@query(
    "prj_20_tool_mode_filter",
    with_views(f"with {DATA_SQL} select dataset, tool from ds where tool = case when dataset like 'SRR%' then 'scallop2' else 'isoquant' end", "v_run"),
)
def prj_20(spark, sf_dir):
    return C.tool_mode_filter(datasets(spark, sf_dir), "other").select("dataset", "tool")


MODELS = ["baseline", "randomforest", "xgboost"]
LONG_DATA = "stack(3, 'baseline', bl, 'randomforest', rf, 'xgboost', xgb) as (label, auc)"


def long_metrics(spark, sf_dir):
    return datasets(spark, sf_dir).selectExpr("dataset", "tool", LONG_DATA)


@query("agg_29_metric_pivot", with_views(f"with {DATA_SQL} select dataset, tool, bl as baseline, rf as randomforest, xgb as xgboost from ds", "v_run"))
def agg_29(spark, sf_dir):
    return C.metric_pivot(long_metrics(spark, sf_dir), ["dataset", "tool"], label="label", value="auc", labels=MODELS, how="max")


@query(
    "agg_30_improvement",
    with_views(
        f"""with {DATA_SQL}, b as (select tool, greatest(coalesce(rf, 0), coalesce(xgb, 0)) as best, bl from ds)
        select tool, {rnd('avg(best - bl)')} as improvement_diff, {rnd('avg(best / nullif(bl, 0) - 1) * 100')} as improvement_pct, count(*) as n_datasets from b where best > 0 group by 1""",
        "v_run",
    ),
)
def agg_30(spark, sf_dir):
    wide = C.metric_pivot(long_metrics(spark, sf_dir), ["dataset", "tool"], label="label", value="auc", labels=MODELS)
    out = C.improvement(wide, models=MODELS[1:], by=["tool"])
    return out.withColumns({c: r6(c) for c in ("improvement_diff", "improvement_pct")})


@query(
    "agg_31_compile_metrics",
    with_views(
        f"with {DATA_SQL} select dataset, tool, rf as auc, xgb as f1, 1::bigint as \"TN\", 2::bigint as \"FP\", 3::bigint as \"FN\", length(dataset)::bigint as \"TP\" from ds", "v_run"
    ),
)
def agg_31(spark, sf_dir):
    long = datasets(spark, sf_dir).selectExpr(
        "dataset", "tool",
        "stack(3, 'auc', string(rf), 'f1', string(xgb), 'confusion_matrix', concat('[[1, 2], [3, ', length(dataset), ']]')) as (metric, value)",
    )
    return C.compile_metrics(long, ["dataset", "tool"], ["auc", "f1"])


@query(
    "src_15_metric_files_scan",
    with_views(f"with {DATA_SQL} select dataset, 4::bigint as \"TN\", 0::bigint as \"FP\", 1::bigint as \"FN\", length(tool)::bigint as \"TP\" from ds", "v_run"),
)
def src_15(spark, sf_dir):
    d = datasets(spark, sf_dir).withColumn("cm", F.expr("concat('[[4, 0], [1, ', length(tool), ']]')"))
    return d.select("dataset", *[c.alias(n) for n, c in C.confusion_from_text(F.col("cm")).items()])


@query(
    "src_16_auc_files_scan",
    with_views(f"with {DATA_SQL} select dataset, 'baseline' as label, bl as auc, round(bl / 10000.0, 8) as auc_normalized from ds", "v_run"),
)
def src_16(spark, sf_dir):
    rows = datasets(spark, sf_dir).selectExpr("dataset", "' baseline_val ' as label", "string(bl) as auc")
    return C.auc_table(rows).withColumn("auc_normalized", F.round("auc_normalized", 8))


@query(
    "jon_17_models_outer_merge",
    with_views(
        f"with {DATA_SQL} select dataset, bl as baseline_value, case when xgb > 0.3 then xgb end as xgboost_value, rf as randomforest_value from ds", "v_run"
    ),
)
def jon_17(spark, sf_dir):
    d = datasets(spark, sf_dir)
    frames = {
        "baseline": d.selectExpr("dataset", "bl as value"),
        "xgboost": d.where("xgb > 0.3").selectExpr("dataset", "xgb as value"),
        "randomforest": d.where("rf is not null").selectExpr("dataset", "rf as value"),
    }
    return C.outer_merge(frames, ["dataset"], "value")


@query(
    "agg_39_importance_topk",
    with_views(f"with {DATA_SQL} select dataset as feature, coalesce(rf, 0.0) as a, xgb as b, round((coalesce(rf, 0.0) + xgb) / 2, 6) as mean_importance from ds order by 4 desc, 1 limit 10", "v_run"),
)
def agg_39(spark, sf_dir):
    d = datasets(spark, sf_dir).selectExpr("dataset as feature", "rf as a", "xgb as b")
    return C.top_importances(d, ["a", "b"]).withColumn("mean_importance", r6("mean_importance"))


@query(
    "jon_18_importance_outer",
    with_views(f"with {DATA_SQL} select dataset as feature, case when rf > 0.3 then rf else 0.0 end as a_importance, case when xgb > 0.3 then xgb else 0.0 end as b_importance from ds where rf > 0.3 or xgb > 0.3", "v_run"),
)
def jon_18(spark, sf_dir):
    d = datasets(spark, sf_dir)
    frames = {
        "a": d.where("rf > 0.3").selectExpr("dataset as feature", "rf as importance"),
        "b": d.where("xgb > 0.3").selectExpr("dataset as feature", "xgb as importance"),
    }
    return C.outer_merge(frames, ["feature"], "importance").fillna(0.0)


@query("prj_25_round_metrics", with_views(f"with {DATA_SQL} select dataset, length(dataset)::int as n, round(bl / 3.0, 2) as v from ds", "v_run"))
def prj_25(spark, sf_dir):
    return C.round_metrics(datasets(spark, sf_dir).selectExpr("dataset", "length(dataset) as n", "bl / 3 as v"))


@query("snk_09_ordered_summary", with_views(f"with {RUNS_SQL} select test_id, assembler_id, 'ok' as status, stage1_test_aupr_tss_rf from runs", "v_run"))
def snk_09(spark, sf_dir):
    return C.ordered_summary(
        runs(spark, sf_dir).selectExpr("run_id as unknown_key", "stage1_test_aupr_tss_rf", "assembler_id", "'ok' as status", "test_id")
    )


@query(
    "win_08_rank_index",
    with_views(f"with {LONG_SQL} select metric_group, test_id, model, row_number() over (partition by metric_group order by baseline_value, data_type, assembler_id, test_id, model) - 1 as rank_idx from cmp", "v_run"),
)
def win_08(spark, sf_dir):
    order = [F.col(c) for c in ("baseline_value", "data_type", "assembler_id", "test_id", "model")]
    return K.rank_index(comparison(spark, sf_dir), by=["metric_group"], order=order).select("metric_group", "test_id", "model", "rank_idx")


@query("prj_21_numeric_coerce", "select event_id, coalesce(try_cast(case when event_id % 3 = 0 then 'bad' else value::varchar end as double), 0.0) as value, 0.0::double as missing from events")
def prj_21(spark, sf_dir):
    raw = table(spark, sf_dir, "events").selectExpr("event_id", "if(event_id % 3 = 0, 'bad', string(value)) as value")
    return C.numeric_features(raw, ["value", "missing"], keep=["event_id"])


@query(
    "prj_33_input_checks",
    """select 'score' as missing_columns, count(*) as rows, count(*) filter (doc_id % 2 = 0) as train_rows, count(*) filter (doc_id % 2 <> 0) as validation_rows,
      count(*) filter (doc_id % 2 = 0 and quality = 1) as train_positive, count(*) filter (doc_id % 2 <> 0 and quality = 1) as validation_positive, 0::bigint as unlabeled_rows from labels""",
)
def prj_33(spark, sf_dir):
    return C.input_checks(table(spark, sf_dir, "labels"), train=F.col("doc_id") % 2 == 0, label="quality", required=["quality", "score"])


# ---- cohorts: every event type against the purchases ----

COHORT_SQL = """ch as (select k.feature, (e.event_type = 'purchase')::int as cohort, e.value from events e
  join (select unnest(['click', 'view', 'error', 'signup']) as feature) k on e.event_type = k.feature or e.event_type = 'purchase')"""


def cohorts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value")
    return e.selectExpr(
        "explode(if(event_type = 'purchase', array('click', 'view', 'error', 'signup'), array(event_type))) as feature",
        "int(event_type = 'purchase') as cohort", "value",
    )


@query(
    "agg_32_distribution_compare",
    f"""with {COHORT_SQL}, s as (select feature, count(*) filter (cohort = 0) as n0, avg(value) filter (cohort = 0) as mean0, stddev_samp(value) filter (cohort = 0) as std0,
      quantile_cont(value, 0.5) filter (cohort = 0) as median0, quantile_cont(value, 0.25) filter (cohort = 1) as q25_1, count(*) filter (cohort = 1) as n1, avg(value) filter (cohort = 1) as mean1,
      stddev_samp(value) filter (cohort = 1) as std1 from ch group by 1),
    d as (select *, (mean0 - mean1) / sqrt(((n0 - 1) * std0 ** 2 + (n1 - 1) * std1 ** 2) / (n0 + n1 - 2)) as d from s)
    select feature, n0, n1, {rnd('mean0')} as mean0, {rnd('mean1')} as mean1, {rnd('std0')} as std0, {rnd('std1')} as std1, {rnd('median0')} as median0, {rnd('q25_1')} as q25_1, {rnd('d')} as cohens_d,
      case when abs(d) < 0.2 then 'negligible' when abs(d) < 0.5 then 'small' when abs(d) < 0.8 then 'medium' else 'large' end as effect_size from d""",
)
def agg_32(spark, sf_dir):
    d = H.distributions(cohorts(spark, sf_dir))
    return d.select("feature", "n0", "n1", *[r6(c).alias(c) for c in ("mean0", "mean1", "std0", "std1", "median0", "q25_1", "cohens_d")], "effect_size")


RANK_SQL = f"""{COHORT_SQL}, v as (select feature, value, count(*) filter (cohort = 0) as c0, count(*) filter (cohort = 1) as c1 from ch group by all),
r as (select *, sum(c0) over w as r0, sum(c1) over w as r1, sum(c0) over g as n0, sum(c1) over g as n1 from v window w as (partition by feature order by value rows unbounded preceding), g as (partition by feature))"""


@query("agg_33_ks_two_sample", f"with {RANK_SQL} select feature, {rnd('max(abs(r0::double / n0 - r1::double / n1))')} as ks_statistic from r group by 1")
def agg_33(spark, sf_dir):
    return H.rank_tests(cohorts(spark, sf_dir)).select("feature", r6("ks_statistic").alias("ks_statistic"))


@query("agg_34_mann_whitney_u", f"with {RANK_SQL} select feature, max(n0)::bigint as n0, max(n1)::bigint as n1, sum(c0 * (r1::double - c1 / 2.0::double)) as u_statistic from r group by 1")
def agg_34(spark, sf_dir):
    return H.rank_tests(cohorts(spark, sf_dir)).select("feature", "n0", "n1", "u_statistic")


@query("prj_24_effect_size_bucket", "select event_id, case when abs(value / 100) < 0.2 then 'negligible' when abs(value / 100) < 0.5 then 'small' when abs(value / 100) < 0.8 then 'medium' else 'large' end as effect from events")
def prj_24(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", H.effect_size(F.col("value") / 100).alias("effect"))


SNR_SQL = """o as (select event_type as feature, case when event_id % 5 < 2 then 'TP' else 'FP' end as outcome, value from events)"""


def outcomes(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_type as feature", "if(event_id % 5 < 2, 'TP', 'FP') as outcome", "value")


@query(
    "agg_35_signal_to_noise",
    f"""with {SNR_SQL}, s as (select feature, avg(value) filter (outcome = 'TP') as a, avg(value) filter (outcome = 'FP') as b, stddev_samp(value) filter (outcome = 'TP') as sa, stddev_samp(value) filter (outcome = 'FP') as sb from o group by 1)
    select feature, {rnd('a')} as tp_mean, {rnd('b')} as fp_mean, {rnd('sa')} as tp_std, {rnd('sb')} as fp_std, {rnd('abs(a) / abs(b)')} as snr_ratio, {rnd('abs(a - b) / sqrt((sa ** 2 + sb ** 2) / 2)')} as separation from s""",
)
def agg_35(spark, sf_dir):
    s = H.signal_to_noise(outcomes(spark, sf_dir))
    return s.select("feature", *[r6(c).alias(c) for c in s.columns if c != "feature"])


@query(
    "agg_36_coverage_impact",
    f"""with t as (select event_type, value + user_id as c from events) select event_type, {rnd('avg(c)')} as mean, {rnd('median(c)')} as median, {rnd('stddev_samp(c)')} as std, {rnd('min(c)')} as min, {rnd('max(c)')} as max,
    {rnd('quantile_cont(c, 0.25)')} as q25, {rnd('quantile_cont(c, 0.75)')} as q75 from t group by 1""",
)
def agg_36(spark, sf_dir):
    t = H.coverage_impact(table(spark, sf_dir, "events"), ["value", "user_id"], ["event_type"])
    return t.select("event_type", *[r6(c).alias(c) for c in t.columns if c != "event_type"])


@query(
    "agg_36_quartile_bins",
    """with q as (select event_type, quantile_cont(value, [0.25, 0.5, 0.75]) as q from events group by 1)
    select event_type, case when value <= q[1] then 'low' when value <= q[2] then 'medium_low' when value <= q[3] then 'medium_high' else 'high' end as bin, count(*) as n from events join q using (event_type) group by all""",
)
def agg_36_bins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value")
    return H.quartile_bins(e, "value", ["event_type"]).groupBy("event_type", "bin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_37_degradation_compare",
    f"""with {RANK_SQL}, k as (select feature, max(abs(r0::double / n0 - r1::double / n1)) as ks from r group by 1),
    m as (select feature, avg(value) filter (cohort = 0) as m0, avg(value) filter (cohort = 1) as m1, median(value) filter (cohort = 0) as d0, median(value) filter (cohort = 1) as d1 from ch group by 1)
    select feature, {rnd('m1 - m0')} as mean_difference, {rnd('d1 - d0')} as median_difference, {rnd('ks')} as ks_statistic from m join k using (feature)""",
)
def agg_37(spark, sf_dir):
    d = H.degradation_compare(cohorts(spark, sf_dir))
    return d.select("feature", *[r6(c).alias(c) for c in ("mean_difference", "median_difference", "ks_statistic")])


@query(
    "agg_38_bonferroni",
    """select 'bonferroni' as method, 0.05::double as original_alpha, round(0.05 / count(*)::double, 12) as corrected_alpha, count(*) as n_tests,
      count(*) filter (value / 500 < 0.05 / (select count(*) from events where value / 500 <= 1)) as significant_tests from events where value / 500 <= 1""",
)
def agg_38(spark, sf_dir):
    p = table(spark, sf_dir, "events").selectExpr("value / 500 as pvalue")
    return H.bonferroni(p).withColumn("corrected_alpha", F.round("corrected_alpha", 12))


@query(
    "win_09_feature_rank_diff",
    """with a as (select p_type || p_brand as feature, row_number() over (order by sum(p_retailprice) desc, p_type || p_brand) - 1 as rank0 from part where p_size < 40 group by 1),
    b as (select p_type || p_brand as feature, row_number() over (order by max(p_size) desc, p_type || p_brand) - 1 as rank1 from part where p_size > 5 group by 1)
    select feature, rank0, rank1, rank1 - rank0 as rank_difference, case when rank0 is null then 'only_second' when rank1 is null then 'only_first' when rank1 > rank0 then 'worse_in_second' else 'better_in_second' end as change
    from a full join b using (feature)""",
)
def win_09(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("feature", F.concat("p_type", "p_brand")).withColumn("all_rows", F.lit(0))
    a = part.where("p_size < 40").groupBy("all_rows", "feature").agg(F.sum("p_retailprice").alias("w"))
    b = part.where("p_size > 5").groupBy("all_rows", "feature").agg(F.max("p_size").alias("w"))

    def ranked(df):
        out = K.rank_index(df, by=["all_rows"], order=[F.desc("w"), F.col("feature")])
        return out.selectExpr("feature", "rank_idx as rank")

    return H.feature_rank_difference(ranked(a), ranked(b))
