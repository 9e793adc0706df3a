"""Comparison of two cohorts feature by feature.

Input is long: ``feature, cohort, value`` with cohort 0 or 1.  Rank statistics work on
value counts per feature, scanned in blocks, so no task sorts a whole feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from endsight.operators.ranking import quantiles
from endsight.operators.scale import ordered_scan, skew_join

# Bounds of the effect-size classes and the family-wise error rate.
EFFECT_BOUNDS = ((0.2, "negligible"), (0.5, "small"), (0.8, "medium"))
ALPHA = 0.05
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def effect_size(d: Column) -> Column:
    size = F.abs(d)
    out = F.lit("large")
    for bound, name in reversed(EFFECT_BOUNDS):
        out = F.when(size < bound, name).otherwise(out)
    return out


def distributions(long: DataFrame) -> DataFrame:
    """Mean, sample deviation, quartiles per cohort, Cohen's d and its class."""
    def side(c: int) -> list[Column]:
        v = f"if(cohort = {c}, value, null)"
        return [
            F.expr(f"count({v}) as n{c}"),
            F.expr(f"avg({v}) as mean{c}"),
            F.expr(f"stddev_samp({v}) as std{c}"),
        ]

    cuts = quantiles(long, by=["feature", "cohort"], value="value", names=QUARTILES)
    spread = cuts.groupBy("feature").agg(
        *[
            F.expr(f"max(if(cohort = {c}, {q}, null)) as {q if q == 'median' else q + '_'}{c}")
            for c in (0, 1)
            for q in QUARTILES
        ]
    )
    stats = long.groupBy("feature").agg(*side(0), *side(1)).join(spread, "feature")
    pooled = "sqrt(((n0 - 1) * std0 * std0 + (n1 - 1) * std1 * std1) / (n0 + n1 - 2))"
    with_d = stats.where("n0 > 1 and n1 > 1").selectExpr(
        "*", f"coalesce(try_divide(mean0 - mean1, {pooled}), 0D) as cohens_d"
    )
    return with_d.withColumn("effect_size", effect_size(F.col("cohens_d")))


def rank_tests(long: DataFrame) -> DataFrame:
    """Kolmogorov-Smirnov distance and Mann-Whitney U with approximate two-sided p-values.

    U uses mid-ranks.  Its p-value is the normal approximation with tie and continuity
    correction, that of the distance the asymptotic series.
    """
    counts = long.groupBy("feature", "value").agg(
        F.count_if(F.col("cohort") == 0).alias("c0"), F.count_if(F.col("cohort") == 1).alias("c1")
    )
    scanned = ordered_scan(
        counts,
        group=["feature"],
        order=[F.col("value")],
        sums={"c0": F.col("c0"), "c1": F.col("c1")},
    )
    base = scanned.groupBy("feature").agg(
        F.expr("max(all_c0) as n0"),
        F.expr("max(all_c1) as n1"),
        F.expr("max(abs(try_divide(double(run_c0), all_c0) - try_divide(double(run_c1), all_c1))) as ks_statistic"),
        F.expr("sum(c0 * (double(run_c1) - c1 / 2D)) as u_statistic"),
        F.expr("sum(power(double(c0 + c1), 3) - (c0 + c1)) as tie_term"),
    ).where("n0 > 0 and n1 > 0")
    n = "double(n0 + n1)"
    sigma = f"sqrt(double(n0) * n1 / 12 * (({n} + 1) - tie_term / ({n} * ({n} - 1))))"
    z = f"greatest(abs(u_statistic - double(n0) * n1 / 2) - 0.5D, 0D) / nullif({sigma}, 0D)"
    # Abramowitz-Stegun 7.1.26 for the complementary error function
    t = "(1 / (1 + 0.3275911D * (z / sqrt(2D))))"
    poly = f"({t} * (0.254829592D + {t} * (-0.284496736D + {t} * (1.421413741D + {t} * (-1.453152027D + {t} * 1.061405429D)))))"
    lam = "(sqrt(double(n0) * n1 / (n0 + n1)) * ks_statistic)"
    series = " + ".join(f"{2 if k % 2 else -2} * exp(-2D * {k * k} * lam * lam)" for k in range(1, 21))
    return (
        base.selectExpr("*", f"coalesce({z}, 0D) as z", f"{lam} as lam")
        .selectExpr(
            "feature", "n0", "n1", "ks_statistic",
            f"if(lam < 0.2D, 1D, least(greatest({series}, 0D), 1D)) as ks_pvalue",
            "u_statistic", f"least(greatest({poly} * exp(-z * z / 2), 0D), 1D) as mannwhitney_pvalue",
        )
    )


def signal_to_noise(outcomes: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Ratio and separation of feature means between true and false positives.

    ``outcomes`` is long: ``feature, outcome, value``.
    """
    stats = outcomes.groupBy(*keys).agg(
        *[
            F.expr(f"{fn}(if(outcome = '{o}', value, null)) as {o.lower()}_{name}")
            for o in ("TP", "FP")
            for fn, name in (("avg", "mean"), ("stddev_samp", "std"), ("count", "n"))
        ]
    )
    pooled = "sqrt((tp_std * tp_std + fp_std * fp_std) / 2)"
    return stats.where("tp_n > 0 and fp_n > 0").selectExpr(
        *keys, "tp_mean", "fp_mean", "tp_std", "fp_std",
        "case when abs(fp_mean) > 1e-10D then abs(tp_mean) / abs(fp_mean)"
        " when abs(tp_mean) > 1e-10D then double('Infinity') else 1D end as snr_ratio",
        f"coalesce(try_divide(abs(tp_mean - fp_mean), {pooled}), 0D) as separation",
    )


def compare_signal_to_noise(first: DataFrame, second: DataFrame) -> DataFrame:
    """Difference of the signal-to-noise measures of two cohorts by feature."""
    a = first.selectExpr("feature", "snr_ratio as snr0", "separation as separation0")
    b = second.selectExpr("feature", "snr_ratio as snr1", "separation as separation1")
    return a.join(b, "feature").selectExpr(
        "*", "snr0 - snr1 as snr_ratio_difference", "separation0 - separation1 as separation_difference"
    )


def coverage_impact(rows: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Moments and quartile cut points of the sum of some columns, per cohort."""
    total = rows.withColumn("_c", sum((F.col(c) for c in columns[1:]), F.col(columns[0])))
    moments = total.groupBy(*by).agg(
        F.expr("avg(_c) as mean"),
        F.expr("stddev_samp(_c) as std"),
        F.expr("min(_c) as min"),
        F.expr("max(_c) as max"),
    )
    return moments.join(quantiles(total, by=by, value="_c", names=QUARTILES), list(by))


def quartile_bins(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartile class of each value by the exact cut points of its cohort."""
    cuts = quantiles(rows, by=by, value=value, names=QUARTILES)
    return (
        skew_join(rows, cuts, by, "inner")
        .withColumn(
            "bin",
            F.expr(
                f"case when {value} <= q25 then 'low' when {value} <= median then 'medium_low'"
                f" when {value} <= q75 then 'medium_high' else 'high' end"
            ),
        )
        .drop(*QUARTILES)
    )


def degradation_compare(long: DataFrame) -> DataFrame:
    """Mean and median differences of two cohorts with the rank tests, per feature."""
    d = distributions(long).selectExpr(
        "feature", "mean0", "mean1", "mean1 - mean0 as mean_difference", "median1 - median0 as median_difference",
        "if(mean1 > mean0, 'second less precise', 'second more precise') as interpretation",
    )
    return d.join(rank_tests(long), "feature")


def bonferroni(pvalues: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Corrected level and number of significant tests over a long table of ``pvalue``."""
    counted = pvalues.where("pvalue between 0 and 1").groupBy("pvalue").agg(F.count(F.lit(1)).alias("_n"))
    # one row, joined back to the distinct values
    total = counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_all")).withColumn("_level", F.expr(f"{alpha}D / greatest(_all, 1)"))
    marked = total.join(counted, F.expr("pvalue < _level"), "left")
    return marked.groupBy("_all", "_level").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_hits")).selectExpr(
        "'bonferroni' as method", f"{alpha}D as original_alpha", "_level as corrected_alpha", "_all as n_tests", "_hits as significant_tests"
    )


def feature_rank_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rank change of features between two ranked lists; NULL difference for features in one list only.

    Each list has ``feature, rank``.
    """
    a = first.selectExpr("feature", "rank as rank0")
    b = second.selectExpr("feature", "rank as rank1")
    return a.join(b, "feature", "full").selectExpr(
        "feature", "rank0", "rank1", "rank1 - rank0 as rank_difference",
        "case when rank0 is null then 'only_second' when rank1 is null then 'only_first'"
        " when rank1 > rank0 then 'worse_in_second' else 'better_in_second' end as change",
    )
