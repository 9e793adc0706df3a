"""Rankings: classification metrics, average precision, curves and sweeps.

Every measure works per group (``by``: test, backend, split ...).  Rows are first
reduced to one row per distinct score where the measure allows it; the order across
the whole group is scanned block by block (:func:`endsight.operators.scale.ordered_scan`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from endsight.operators.scale import ordered_scan


def _ties(df: DataFrame, by: Sequence[str], label: str, score: str, copies: str | None = None) -> DataFrame:
    """Positives and rows per distinct finite score."""
    s = F.col(score).cast("double")
    finite = df.where(F.col(label).isNotNull() & s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")))
    n = F.col(copies).cast("bigint") if copies else F.lit(1)
    return finite.select(*by, (F.col(label).cast("bigint") * n).alias("y"), s.alias("score"), n.alias("n")).groupBy(
        *by, "score"
    ).agg(F.sum("y").alias("pos"), F.sum("n").alias("n"))


def _descending(df: DataFrame, by: Sequence[str], label: str, score: str, copies: str | None = None) -> DataFrame:
    return ordered_scan(
        _ties(df, by, label, score, copies),
        group=by,
        order=[F.col("score").desc()],
        sums={"pos": F.col("pos"), "n": F.col("n")},
    )


def pr_curve(df: DataFrame, *, by: Sequence[str], label: str, score: str) -> DataFrame:
    """Precision and recall at each distinct threshold, plus the closing point (1, 0)."""
    scanned = _descending(df, by, label, score)
    points = scanned.selectExpr(
        *by,
        "score as threshold",
        "run_pos / double(run_n) as precision",
        "coalesce(try_divide(double(run_pos), all_pos), 1D) as recall",
    )
    closing = df.select(*by).distinct().selectExpr(
        *by, "cast(null as double) as threshold", "1D as precision", "0D as recall"
    )
    return points.unionByName(closing)


def average_precision(
    df: DataFrame, *, by: Sequence[str], label: str, score: str, copies: str | None = None
) -> DataFrame:
    """Average precision, ROC AUC and row counts; the measures are NULL for a single class.

    A row counts as many times as the column ``copies`` says.
    """
    scanned = _descending(df, by, label, score, copies)
    both = "max(all_pos) > 0 and max(all_pos) < max(all_n)"
    return scanned.groupBy(*by).agg(
        F.expr("max(all_n) as n_items"),
        F.expr("max(all_pos) as n_positive"),
        F.expr(f"if({both}, sum(try_divide(double(pos), all_pos) * run_pos / run_n), null) as aupr"),
        F.expr(
            f"if({both}, sum(try_divide(double(n - pos) * (run_pos - pos / 2D),"
            " double(all_pos) * (all_n - all_pos))), null) as roc_auc"
        ),
    )


def classification_metrics(
    df: DataFrame, *, by: Sequence[str], label: str, prediction: str, copies: str | None = None
) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 when undefined), confusion counts and positive rate.

    A row counts as many times as the column ``copies`` says.
    """
    def counted(y: int, p: int, name: str) -> Column:
        where = f"{label} = {y} and {prediction} = {p}"
        return F.expr(f"sum(if({where}, bigint({copies}), 0L)) as {name}" if copies else f"count_if({where}) as {name}")

    counts = df.groupBy(*by).agg(counted(0, 0, "tn"), counted(0, 1, "fp"), counted(1, 0, "fn"), counted(1, 1, "tp"))
    return counts.selectExpr(
        *by,
        "tn",
        "fp",
        "fn",
        "tp",
        "double(tp + tn) / (tn + fp + fn + tp) as accuracy",
        "coalesce(try_divide(double(tp), tp + fp), 0D) as precision",
        "coalesce(try_divide(double(tp), tp + fn), 0D) as recall",
        "coalesce(try_divide(2D * tp, 2 * tp + fp + fn), 0D) as f1",
        "double(tp + fn) / (tn + fp + fn + tp) as positive_rate",
    )


def macro_metrics(df: DataFrame, *, by: Sequence[str], label: str, prediction: str) -> DataFrame:
    """Unweighted means over the two classes of precision, recall and F1."""
    c = classification_metrics(df, by=by, label=label, prediction=prediction)
    return c.selectExpr(
        *by,
        "accuracy",
        "(precision + coalesce(try_divide(double(tn), tn + fn), 0D)) / 2 as macro_precision",
        "(recall + coalesce(try_divide(double(tn), tn + fp), 0D)) / 2 as macro_recall",
        "(f1 + coalesce(try_divide(2D * tn, 2 * tn + fp + fn), 0D)) / 2 as macro_f1",
        "tp + fn as support_1",
        "tn + fp as support_0",
    )


def topk_curve(
    df: DataFrame, *, by: Sequence[str], label: str, score: str, tie: Sequence[Column], step: int = 1
) -> DataFrame:
    """Precision and recall after keeping the top k rows, for k = 1, 1+step, 1+2*step ..."""
    rows = df.select(*by, F.col(label).cast("bigint").alias("y"), F.col(score).alias("score"), *tie)
    names = [c for c in rows.columns if c not in (*by, "y", "score")]
    scanned = ordered_scan(
        rows,
        group=by,
        order=[F.col("score").desc(), *[F.col(c) for c in names]],
        sums={"k": F.lit(1), "pos": F.col("y")},
    )
    return scanned.where((F.col("run_k") - 1) % step == 0).selectExpr(
        *by,
        "bigint(run_k) as k",
        "run_pos / double(run_k) as precision",
        "coalesce(try_divide(double(run_pos), all_pos), 0D) as recall",
    )


def trapezoid_area(curve: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Area under a curve of (recall, precision) points ordered by ``k``."""
    scanned = ordered_scan(
        curve,
        group=by,
        order=[F.col("k")],
        previous={"recall": F.col("recall"), "precision": F.col("precision")},
    )
    return scanned.groupBy(*by).agg(
        F.expr(
            "coalesce(sum((recall - prev_recall) * (precision + prev_precision) / 2), 0D) as area"
        )
    )


def measure_column(measure: str) -> str:
    """Abundance column of a sweep: TPM, FPKM, and coverage for anything else."""
    return {"TPM": "tpm", "FPKM": "fpkm"}.get(measure.strip(), "cov")


def roc_sweep(
    matches: DataFrame, reference_size: Column, *, by: Sequence[str], measure: str = "cov"
) -> DataFrame:
    """Recall/precision points while dropping transcripts in ascending abundance.

    ``matches`` has ``ref_id, class_code, row_no`` and the abundance columns.  A
    reference counts as found while its last ``=`` row is still above the cut.  A
    point is kept when the number of references lost is a multiple of ten and the
    row before the cut was a match.
    """
    value = measure_column(measure)
    rows = matches.withColumns({"_m": F.col(value).cast("double"), "_size": reference_size})
    at = F.struct("_m", "row_no")
    last = (
        rows.where("class_code = '='")
        .groupBy(*by, "ref_id")
        .agg(F.max(at).alias("_at"))
        .select(*by, F.col("_at.row_no").alias("row_no"), F.lit(1).alias("_last"))
    )
    flagged = rows.join(last, [*by, "row_no"], "left").selectExpr(
        *by,
        "row_no",
        "_m",
        "_size",
        "coalesce(_last, 0) as last_match",
        "class_code = '=' as is_match",
    )
    scanned = ordered_scan(
        flagged,
        group=by,
        order=[F.col("_m"), F.col("row_no")],
        sums={"row": F.lit(1), "lost": F.col("last_match")},
        previous={"match": F.col("is_match")},
    )
    return (
        scanned.selectExpr(
            *by,
            "bigint(run_row - 1) as idx",
            "run_lost - last_match as lost",
            "all_lost - run_lost + last_match as found",
            "all_row - run_row + 1 as remaining",
            "_size",
            "coalesce(prev_match, true) as after_match",
        )
        .where("after_match and lost % 10 = 0")
        .selectExpr(
            *by,
            "idx",
            "round(if(_size > 0, found / double(greatest(_size, 1)), 0D), 6) as recall",
            "round(found / double(remaining), 6) as precision",
        )
    )


def sweep_auc(matches: DataFrame, reference_size: Column, *, by: Sequence[str]) -> DataFrame:
    """Unnormalised percent-by-percent area of the coverage sweep, counting match rows."""
    rows = matches.select(
        *by, "row_no", F.col("cov").cast("double").alias("_m"), reference_size.alias("_size"),
        F.when(F.col("class_code") == "=", 1).otherwise(0).alias("hit"),
    )
    scanned = ordered_scan(
        rows,
        group=by,
        order=[F.col("_m"), F.col("row_no")],
        sums={"row": F.lit(1), "hit": F.col("hit")},
        previous={"hit": F.col("hit")},
    ).selectExpr(
        *by,
        "prev_hit is null as first",
        "all_hit - run_hit + hit as q",
        "all_hit - run_hit + hit + coalesce(prev_hit, 0) as q_before",
        "all_row - run_row + 1 as left_rows",
        "_size",
    )
    sen = "if(_size > 0, {q} * 100D / greatest(_size, 1), 0D)"
    s, s0 = sen.format(q="q"), sen.format(q="q_before")
    p, p0 = "(q * 100D / left_rows)", "(q_before * 100D / (left_rows + 1))"
    return scanned.groupBy(*by).agg(
        F.expr(f"sum(if(first, {s} * {p}, ({s} + {s0}) * 0.5D * ({p} - {p0}))) as auc")
    )


def match_counts(matches: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Rows with a one-letter class code, and those with ``=``."""
    return matches.groupBy(*by).agg(
        F.expr("count_if(length(class_code) = 1) as n_total"),
        F.expr("count_if(class_code = '=') as n_positive"),
    )


def rank_index(df: DataFrame, *, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Zero-based index after a multi-key sort; ``order`` must be total."""
    scanned = ordered_scan(df, group=by, order=order, sums={"row": F.lit(1)})
    return scanned.withColumn("rank_idx", (F.col("run_row") - 1).cast("bigint")).drop("run_row", "all_row")


def quantiles(
    df: DataFrame, *, by: Sequence[str], value: str, names: dict[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, without holding a group in one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    scanned = ordered_scan(counts, group=by, order=[F.col(value)], sums={"n": F.col("n")})

    def at(index: str) -> str:
        return f"max(if(run_n - n <= {index} and {index} < run_n, {value}, null))"

    columns = []
    for name, q in names.items():
        h = f"((all_n - 1) * {q}D)"
        low, high = at(f"floor({h})"), at(f"ceil({h})")
        columns.append(F.expr(f"{low} + max({h} - floor({h})) * ({high} - {low}) as {name}"))
    return scanned.groupBy(*by).agg(*columns)
