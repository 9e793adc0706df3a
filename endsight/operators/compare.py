"""Comparison tables across runs, data sets and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric column triples of a run summary (group, model columns, baseline columns).
METRIC_GROUPS = {
    "stage1_tss": ("stage1_test_aupr_tss_rf", "stage1_test_aupr_tss_xgb", ("stage1_test_aupr_tss_baseline",)),
    "stage1_tes": ("stage1_test_aupr_tes_rf", "stage1_test_aupr_tes_xgb", ("stage1_test_aupr_tes_baseline",)),
    "transcript": (
        "transcript_pr_auc_model_rf", "transcript_pr_auc_model_xgb",
        ("transcript_pr_auc_baseline", "transcript_pr_auc_baseline_rf"),
    ),
    "stage1_tss_novel": ("stage1_test_aupr_tss_novel_rf", "stage1_test_aupr_tss_novel_xgb", ("stage1_test_aupr_tss_novel_baseline",)),
    "stage1_tes_novel": ("stage1_test_aupr_tes_novel_rf", "stage1_test_aupr_tes_novel_xgb", ("stage1_test_aupr_tes_novel_baseline",)),
    "transcript_novel": ("stage2_test_aupr_novel_rf", "stage2_test_aupr_novel_xgb", ("stage2_test_aupr_novel_baseline",)),
}
# Column order of a benchmark summary.
SUMMARY_COLUMNS = (
    "test_id", "assembler_id", "status", "predict_code",
    "stage1_test_aupr_tss_rf", "stage1_test_aupr_tss_xgb", "stage1_test_aupr_tss_baseline",
    "stage1_test_aupr_tss_novel_rf", "stage1_test_aupr_tss_novel_xgb", "stage1_test_aupr_tss_novel_baseline",
    "stage1_test_n_novel_tss", "stage1_test_n_eval_tss",
    "stage1_test_aupr_tes_rf", "stage1_test_aupr_tes_xgb", "stage1_test_aupr_tes_baseline",
    "stage1_test_aupr_tes_novel_rf", "stage1_test_aupr_tes_novel_xgb", "stage1_test_aupr_tes_novel_baseline",
    "stage1_test_n_novel_tes", "stage1_test_n_eval_tes",
    "stage2_test_aupr_rf", "stage2_test_aupr_xgb", "stage2_test_aupr_baseline",
    "stage2_test_aupr_novel_rf", "stage2_test_aupr_novel_xgb", "stage2_test_aupr_novel_baseline",
    "stage2_test_n_novel_pos_tx", "stage2_test_n_eval_tx",
    "transcript_pr_auc_model_rf", "transcript_pr_auc_model_xgb", "transcript_pr_auc_baseline",
    "error", "transcript_pr_error",
)
# Data set groups in report order, sweep area scale, tool names.
GROUP_ORDER = ("pacbio", "cdna", "drna", "srr", "other")
AUC_SCALE = 10_000.0
RUN_PATTERN = "^([^_]+)__train_([^_]+)__test_([^_]+)(?:__(.+))?$"


def parse_run_id(run_id: Column) -> dict[str, Column]:
    """Columns of ``<type>__train_<a>__test_<b>[__variant]``; empty strings when it does not match."""
    names = ("data_type", "train_annotation", "test_annotation", "run_variant")
    return {n: F.regexp_extract(F.trim(run_id), RUN_PATTERN, i + 1) for i, n in enumerate(names)}


def split_data_name(name: Column) -> tuple[Column, Column]:
    """(data set, assembler) split at the last underscore; assembler ``unknown`` without one."""
    has = name.contains("_")
    return (
        F.when(has, F.regexp_replace(name, "_[^_]*$", "")).otherwise(name),
        F.when(has, F.substring_index(name, "_", -1)).otherwise(F.lit("unknown")),
    )


def dataset_group(dataset: Column) -> Column:
    name = F.lower(F.coalesce(dataset, F.lit("")))
    return (
        F.when(name.contains("pacbio"), "pacbio")
        .when(name.contains("cdna"), "cdna")
        .when(name.contains("drna"), "drna")
        .when(name.startswith("srr"), "srr")
        .otherwise("other")
    )


def group_sort_key(group: Column) -> Column:
    return F.array_position(F.array(*[F.lit(g) for g in GROUP_ORDER]), group).cast("int") - 1


def tool_mode_filter(df: DataFrame, mode: str, *, dataset: str = "dataset", tool: str = "tool") -> DataFrame:
    """Rows of StringTie, or of the data set's other assembler (``mode='other'``)."""
    name = F.lower(tool)
    if mode == "stringtie":
        return df.where(name == "stringtie")
    if mode == "other":
        expected = F.when(dataset_group(F.col(dataset)) == "srr", "scallop2").otherwise("isoquant")
        return df.where(name == expected)
    return df


def comparison_table(summary: DataFrame) -> DataFrame:
    """Unpivot run summaries: one row per run, metric group and model with both values."""
    present = set(summary.columns)
    entries = []
    for group, (rf, xgb, baselines) in METRIC_GROUPS.items():
        base = next((b for b in baselines if b in present), None)
        if base and rf in present and xgb in present:
            for model, column in (("rf", rf), ("xgb", xgb)):
                entries.append(f"'{group}', '{model}', try_cast({column} as double), try_cast({base} as double)")
    if not entries:
        raise ValueError("no metric group has both model columns and a baseline")
    ids = ("run_id", "test_id", "data_type", "train_annotation", "test_annotation", "run_variant")
    asm = "coalesce(nullif(lower(trim(assembler_id)), ''), 'unknown') as assembler_id"
    return (
        summary.selectExpr(
            *[i if i in present else f"'' as {i}" for i in ids],
            asm if "assembler_id" in present else "'unknown' as assembler_id",
            f"stack({len(entries)}, {', '.join(entries)}) as (metric_group, model, model_value, baseline_value)",
        )
        .where("not (model_value is null or isnan(model_value) or baseline_value is null or isnan(baseline_value))")
        .selectExpr("*", "model_value - baseline_value as delta_vs_baseline")
        .selectExpr(
            "*",
            "delta_vs_baseline / (abs(baseline_value) + 1e-12D) as relative_gain",
            "delta_vs_baseline / (abs(baseline_value) + 1e-12D) * 100 as relative_gain_pct",
            "delta_vs_baseline > 0 as win_vs_baseline",
        )
    )


def win_rates(comparison: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Win rate and median/mean gains per key; NULL keys form their own group."""
    return comparison.groupBy(*keys).agg(
        F.expr("count(delta_vs_baseline) as n"),
        F.expr("avg(double(win_vs_baseline)) as win_rate"),
        F.expr("avg(double(win_vs_baseline)) * 100 as win_rate_pct"),
        F.expr("percentile(delta_vs_baseline, 0.5) as delta_median"),
        F.expr("avg(delta_vs_baseline) as delta_mean"),
        F.expr("percentile(relative_gain, 0.5) as rel_median"),
        F.expr("percentile(relative_gain_pct, 0.5) as rel_pct_median"),
        F.expr("avg(relative_gain_pct) as rel_pct_mean"),
    )


def heatmap(comparison: DataFrame, keys: Sequence[str], value: str, columns: Sequence[str]) -> DataFrame:
    """``value`` (an aggregate) as a train x test matrix per key."""
    return comparison.groupBy(*keys, "train_annotation").pivot("test_annotation", list(columns)).agg(F.expr(value))


def metric_pivot(
    df: DataFrame, keys: Sequence[str], *, label: str, value: str, labels: Sequence[str], how: str = "first"
) -> DataFrame:
    """Wide table of ``value`` by ``label``; ``how`` is ``first`` or ``max``."""
    agg = F.max(value) if how == "max" else F.first(value)
    return df.groupBy(*keys).pivot(label, list(labels)).agg(agg)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, the uniqueness check before a pivot."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def improvement(wide: DataFrame, *, models: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean gain of the best model over the baseline, absolute and in percent."""
    best = F.greatest(*[F.coalesce(m, F.lit(0.0)) for m in models])
    rows = wide.withColumn("_best", best).where("_best > 0")
    return rows.groupBy(*by).agg(
        F.expr("avg(_best - baseline) as improvement_diff"),
        F.expr("avg(try_divide(_best, baseline) - 1) * 100 as improvement_pct"),
        F.expr("count(1) as n_datasets"),
    )


def outer_merge(frames: dict[str, DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Full outer merge of one value per named frame: columns ``<name>_<value>``."""
    out = None
    for name, df in frames.items():
        part = df.select(*keys, F.col(value).alias(f"{name}_{value}"))
        out = part if out is None else out.join(part, list(keys), "full")
    return out


def top_importances(importances: DataFrame, tools: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` features of largest mean importance over tools, missing ones counted as 0."""
    mean = sum((F.coalesce(t, F.lit(0.0)) for t in tools[1:]), F.coalesce(tools[0], F.lit(0.0))) / len(tools)
    filled = importances.fillna(0.0, list(tools))
    return filled.withColumn("mean_importance", mean).orderBy(F.desc("mean_importance"), "feature").limit(k)


def confusion_from_text(text: Column) -> dict[str, Column]:
    """TN, FP, FN, TP of a confusion matrix written as ``[[tn, fp], [fn, tp]]``; 0 when unreadable."""
    m = F.from_json(text, "array<array<bigint>>")

    def cell(i: int, j: int) -> Column:
        return F.coalesce(F.get(F.get(m, F.lit(i)), F.lit(j)), F.lit(0))

    return {"TN": cell(0, 0), "FP": cell(0, 1), "FN": cell(1, 0), "TP": cell(1, 1)}


def compile_metrics(long: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One wide row per key from ``metric, value`` text rows; the confusion matrix becomes four columns."""
    numbers = long.withColumn("_v", F.col("value").try_cast("double"))
    wide = numbers.groupBy(*keys).agg(
        *[F.first(F.when(F.col("metric") == m, F.col("_v")), ignorenulls=True).alias(m) for m in metrics],
        F.first(F.when(F.col("metric") == "confusion_matrix", F.col("value")), ignorenulls=True).alias("_cm"),
    )
    return wide.withColumns(confusion_from_text(F.col("_cm"))).drop("_cm")


def task_order(task: Column) -> Column:
    """Start sites before end sites."""
    return F.when(task == "tss", 0).when(task == "tes", 1)


def auc_table(rows: DataFrame) -> DataFrame:
    """``label, auc`` rows with cleaned labels and the sweep area divided by its scale."""
    name = F.trim("label")
    return (
        rows.withColumn("label", F.when(name == "baseline_val", "baseline").otherwise(name))
        .withColumn("auc", F.col("auc").try_cast("double"))
        .where("auc is not null")
        .withColumn("auc_normalized", F.col("auc") / AUC_SCALE)
    )


def round_metrics(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round floating-point columns only."""
    return df.select(
        *[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    )


def ordered_summary(df: DataFrame) -> DataFrame:
    """Known summary columns in their order, unknown ones dropped, missing text empty."""
    kept = [c for c in SUMMARY_COLUMNS if c in df.columns]
    return df.select(*kept).fillna("")


def numeric_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Feature columns as doubles: unreadable, NaN, NULL and missing values become 0."""
    present = set(df.columns)
    columns = [
        F.coalesce(F.nanvl(F.col(n).try_cast("double"), F.lit(0.0)), F.lit(0.0)).alias(n)
        if n in present
        else F.lit(0.0).alias(n)
        for n in names
    ]
    return df.select(*keep, *columns)


def input_checks(df: DataFrame, *, train: Column, label: str, required: Sequence[str]) -> DataFrame:
    """One row of checks on training input: missing columns, split sizes, classes per split."""
    missing = [c for c in required if c not in df.columns]
    y = F.col(label)
    return df.agg(
        F.lit(",".join(missing)).alias("missing_columns"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(train).alias("train_rows"),
        F.count_if(~train).alias("validation_rows"),
        F.count_if(train & (y == 1)).alias("train_positive"),
        F.count_if(~train & (y == 1)).alias("validation_positive"),
        F.count_if(y.isNull()).alias("unlabeled_rows"),
    )
