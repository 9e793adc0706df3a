"""The jobs a user runs: train, predict, evaluate, compare runs, augment a reference."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from endsight.functions.contigs import in_train_split
from endsight.operators import annotation as N
from endsight.operators import cohorts, compare
from endsight.operators import models as M
from endsight.operators import ranking as K
from endsight.operators import sites as S
from endsight.operators import transcripts as T
from endsight.operators.features import SITE, FeatureConfig, attach_features, coordinate_features
from endsight.operators.scale import skew_join, written

BACKENDS = ("rf", "xgb")


@dataclass
class JobConfig:
    """Parameters of training and prediction."""

    features: FeatureConfig = field(default_factory=FeatureConfig)
    train_range: tuple[int, int] = (1, 10)
    tolerance: int = S.LABEL_TOLERANCE
    forest: dict = field(default_factory=dict)
    boosted: dict = field(default_factory=dict)
    ranker: dict = field(default_factory=dict)


@dataclass
class Models:
    """Site models by site type and backend, and a ranker per backend."""

    site_models: dict[tuple[str, str], M.Classifier]
    rankers: dict[str, M.Classifier]


@dataclass
class Trained(Models):
    """Models and tables of a training run."""

    site_metrics: DataFrame
    transcript_metrics: DataFrame
    scored: DataFrame
    ranked: DataFrame


def transcript_ends(cov: DataFrame, features: DataFrame, scored: DataFrame) -> DataFrame:
    """Coverage rows joined with features and best probabilities of both ends.

    ``features`` has one row per coordinate, or per coordinate and type of site, so the best row of a site differs from the
    others in its probabilities only: these are narrow, and the wide rows are joined once for all backends.
    """
    names = [f"p_site_{b}" for b in BACKENDS]
    best = scored.groupBy("site_type", *SITE).agg(*[F.max(T.known_score(c)).alias(c) for c in names])
    best = best.fillna(T.DEFAULT_PROBABILITY, names)
    ends = skew_join(best, features, ["site_type", *SITE]) if "site_type" in features.columns else attach_features(best, features)
    tss = ends.where("site_type = 'TSS'").drop("site_type")
    tes = ends.where("site_type = 'TES'").drop("site_type")
    return T.merge_cov_sites(cov, tss, tes)


def transcript_rows(ends: DataFrame, backend: str) -> DataFrame:
    """Rows of ``transcript_ends`` with the probabilities of one backend and derived features."""
    scores = {f"p_site_{b}_{end}" for b in BACKENDS for end in ("tss", "tes")}
    rows = ends.selectExpr(
        *[c for c in ends.columns if c not in scores],
        *[f"p_site_{backend}_{end} as probability_{end}" for end in ("tss", "tes")],
    )
    return T.derived_features(rows)


def rank_transcripts(rows: DataFrame, model: M.Classifier, keep: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """``transcript_id, pred_prob, pred_label`` and ``keep``; ``names`` are those of packed rows."""
    scored = model.score(rows, "pred_prob", keep=["transcript_id", *keep], names=names)
    return scored.withColumn("pred_label", (F.col("pred_prob") >= 0.5).cast("int"))


def site_places(sites: DataFrame, counts: dict[str, str] | None = None) -> DataFrame:
    """Distinct places of each type of site with the number ``n`` of their sites, or the named aggregates of ``counts``."""
    named = counts or {"n": "count(1)"}
    return sites.groupBy("site_type", *SITE).agg(*[F.expr(e).alias(c) for c, e in named.items()])


def known_places(sites: DataFrame, reads: DataFrame, cfg: JobConfig, reference_sites: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Places of ``sites`` with packed features, labelled where a reference is given, as a written table; and the names of the features."""
    features = coordinate_features(sites, reads, cfg.features)
    names = M.feature_names(features)
    places = site_places(sites)
    if reference_sites is not None:
        places = S.proximity_label(places, reference_sites, tolerance=cfg.tolerance)
    # a place without coordinates has no features
    none = F.array_repeat(F.lit(0.0), len(names))
    rows = attach_features(places, M.packed(features, names, SITE))
    return written(rows.withColumn(M.PACKED, F.coalesce(M.PACKED, none))), names


def scored_sites(sites: DataFrame, scores: DataFrame) -> DataFrame:
    """Every site with the scores of its place."""
    keys = ["site_type", *SITE]
    places = scores.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    joined = sites.join(places, same).select(*M.SITE_KEYS, "p_site_rf", "p_site_xgb")
    return joined.withColumn("site_id", S.site_id())


def packed_ends(ends: DataFrame, backend: str, site_names: Sequence[str], keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Packed rows of the transcripts of ``ends``, whose site features are packed by end, and the names of the features."""
    rows = transcript_rows(ends, backend)
    own = M.feature_names(rows)
    both = [f"{M.PACKED}_tss", f"{M.PACKED}_tes"]
    rows = M.packed(rows, own, [*keep, *both]).withColumn(M.PACKED, F.concat(M.PACKED, *both)).drop(*both)
    return rows, own + [f"{n}_{end}" for end in ("tss", "tes") for n in site_names]


def train(
    transcripts: DataFrame, cov: DataFrame, reads: DataFrame, reference_sites: DataFrame, labels: DataFrame, cfg: JobConfig
) -> Trained:
    """Fit four site models and two transcript rankers; score every site and transcript.

    ``transcripts`` has ``transcript_id, chrom, strand, start, end``; ``labels`` has
    ``transcript_id, label``.  Features and label of a site depend on its place, so site models learn from and score
    distinct places, which weigh as many rows as transcripts end there.  Packed places and transcript rows are each written
    once, as every model reads them several times.
    """
    sites = S.candidate_sites(transcripts)
    labeled, names = known_places(sites, reads, cfg, reference_sites)
    split = in_train_split(F.col("chrom"), cfg.train_range)
    site_models = {}
    for site_type in S.SITE_TYPES:
        learn = labeled.where(split & (F.col("site_type") == site_type))
        for backend in BACKENDS:
            params = cfg.forest if backend == "rf" else cfg.boosted
            site_models[(site_type, backend)] = M.fit(learn, names, kind=backend, params=params, copies="n")
    known = written(M.score_sites(labeled, site_models, ["site_type", *SITE, "label", "n"], names))
    held = known.where(~split).selectExpr(
        "site_type", "label", "n", "stack(2, 'rf', p_site_rf, 'xgb', p_site_xgb) as (backend, p)"
    )
    site_metrics = M.validation_metrics(held, "p", ["site_type", "backend"], copies="n")
    scores = known.drop("label", "n")
    vectors = labeled.select("site_type", *SITE, M.PACKED)
    ends = written(transcript_ends(T.label_join(cov, labels), vectors, scores))
    rankers, ranked = {}, []
    for backend in BACKENDS:
        rows, row_names = packed_ends(ends, backend, names, ["transcript_id", "label", "tes_chrom"])
        learn = rows.where(in_train_split(F.col("tes_chrom"), cfg.train_range))
        model = M.fit(learn, row_names, kind="ranker", params=cfg.ranker)
        rankers[backend] = model
        ranked.append(rank_transcripts(rows, model, ["label", "tes_chrom"], row_names).withColumn("backend", F.lit(backend)))
    ranks = written(_stack(ranked))
    part = in_train_split(F.col("tes_chrom"), cfg.train_range)
    metrics = M.validation_metrics(ranks.where(~part), "pred_prob", ["backend"])
    return Trained(
        site_models, rankers, site_metrics, metrics, scored_sites(sites, scores), ranks.drop("tes_chrom")
    )


# Between assembly and transcript in the ids of pooled training; no id holds it.
BETWEEN = "\x1f"


def _pooled(df: DataFrame) -> DataFrame:
    return df.withColumn("transcript_id", F.concat_ws(BETWEEN, "assembly_id", "transcript_id")).drop("assembly_id")


def _parted(df: DataFrame) -> DataFrame:
    parts = F.split("transcript_id", BETWEEN, 2)
    rest = [c for c in df.columns if c != "transcript_id"]
    return df.select(parts[0].alias("assembly_id"), parts[1].alias("transcript_id"), *rest)


def train_pooled(
    transcripts: DataFrame, cov: DataFrame, reads: DataFrame, reference_sites: DataFrame, labels: DataFrame, cfg: JobConfig
) -> Trained:
    """One training run over the transcripts of several assemblies of one sample.

    As ``train``, with ``assembly_id`` in ``transcripts``, ``cov`` and ``labels``: a transcript meets
    coverage and label of its own assembly only, also where assemblies use the same ids.  Site features are computed once per
    coordinate whatever the number of assemblies that propose it.  ``scored`` and ``ranked`` carry ``assembly_id``.
    """
    named = [df.where("assembly_id is not null") for df in (transcripts, cov, labels)]
    trained = train(_pooled(named[0]), _pooled(named[1]), reads, reference_sites, _pooled(named[2]), cfg)
    trained.scored, trained.ranked = _parted(trained.scored), _parted(trained.ranked)
    return trained


def _places(path: str) -> dict[tuple[str, ...], str]:
    sites = {(t, b): f"{path}/site-{t.lower()}-{b}" for t in S.SITE_TYPES for b in BACKENDS}
    return sites | {(b,): f"{path}/ranker-{b}" for b in BACKENDS}


def save_models(models: Models, path: str, spark: SparkSession) -> None:
    """Write all models under ``path``, each with the list of its features."""
    for key, place in _places(path).items():
        model = models.site_models[key] if len(key) == 2 else models.rankers[key[0]]
        model.save(place, spark)


def load_models(path: str, spark: SparkSession) -> Models:
    """Models written by ``save_models``; a model that is not there raises."""
    loaded = {key: M.Classifier.load(place, spark) for key, place in _places(path).items()}
    return Models({k: m for k, m in loaded.items() if len(k) == 2}, {k[0]: m for k, m in loaded.items() if len(k) == 1})


def predict(transcripts: DataFrame, cov: DataFrame, reads: DataFrame, trained: Models, cfg: JobConfig) -> tuple[DataFrame, DataFrame]:
    """Scored sites and ranked transcripts of another sample; every place is scored once, however many transcripts end there."""
    sites = S.candidate_sites(transcripts)
    known, names = known_places(sites, reads, cfg)
    scores = written(M.score_sites(known, trained.site_models, ["site_type", *SITE], names))
    ends = written(transcript_ends(cov, known.drop("n"), scores))
    ranked = []
    for backend in BACKENDS:
        rows, row_names = packed_ends(ends, backend, names, ["transcript_id"])
        ranked.append(rank_transcripts(rows, trained.rankers[backend], [], row_names).withColumn("backend", F.lit(backend)))
    return scored_sites(sites, scores), _stack(ranked)


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def evaluate_sites(scored: DataFrame, cov: DataFrame, reference: DataFrame, *, by: Sequence[str] = (), tolerance: int = S.LABEL_TOLERANCE) -> DataFrame:
    """Average precision per site type and score: both backends, the coverage baseline, and novel labels.

    All tests go through one pass; ``by`` names the test key.
    """
    # labels depend on the place only, so every place is labelled once and scored rows are joined once
    known = S.proximity_label(T.end_coverage(cov), reference, tolerance=tolerance)
    known = S.novel_label(known, reference, tolerance=tolerance)
    long = T.join_sites(scored, known).selectExpr(
        *by, "site_type", "label", "novel_label",
        "stack(3, 'rf', p_site_rf, 'xgb', p_site_xgb, 'baseline', coverage) as (score_name, score)",
    ).selectExpr(*by, "site_type", "score_name", "score", "stack(2, 'all', label, 'novel', novel_label) as (truth, y)")
    return K.average_precision(long, by=[*by, "site_type", "score_name", "truth"], label="y", score="score")


def evaluate_transcripts(ranked: DataFrame, cov: DataFrame, labels: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Average precision of model and coverage against all and against novel matches.

    All tests go through one pass; ``by`` names the test key, which all three inputs have.
    """
    joined = T.ranked_cov_labels(ranked, cov, labels, by=by).withColumn(
        "novel", ((F.col("label") == 1) & S.is_novel(F.col("ref_id"))).cast("int")
    )
    long = joined.selectExpr(
        *by, "label", "novel", "stack(2, 'model', pred_prob, 'baseline', coverage) as (score_name, score)"
    ).selectExpr(*by, "score_name", "score", "stack(2, 'all', label, 'novel', novel) as (truth, y)")
    return K.average_precision(long, by=[*by, "score_name", "truth"], label="y", score="score")


def matched_contig_sweep(matches: DataFrame, reference_exons: DataFrame, train_range: tuple[int, int], *, measure: str = "cov") -> DataFrame:
    """Sweep area per split with the reference size counted on the same contigs.

    ``matches`` has ``chrom, ref_id, class_code, row_no`` and abundances.
    """
    def split(chrom: str) -> Column:
        return F.when(in_train_split(F.col(chrom), train_range), "train").otherwise("validation")

    sizes = T.multi_exon_count(reference_exons.withColumn("split", split("chrom")), ["split"])
    # one row per split
    rows = matches.withColumn("split", split("chrom")).join(F.broadcast(sizes), "split")
    value = rows.withColumn("cov", F.col(K.measure_column(measure)))
    return K.sweep_auc(value, F.col("multi_exon_transcripts"), by=["split"])


def compare_runs(summary: DataFrame) -> dict[str, DataFrame]:
    """Long comparison and both summary levels."""
    long = compare.comparison_table(summary)
    keys = ["metric_group", "data_type", "assembler_id", "model"]
    return {
        "long": long,
        "aggregates": compare.win_rates(long, keys),
        "by_case": compare.win_rates(long, [*keys, "train_annotation", "test_annotation"]),
    }


def augment(assemblies: DataFrame, annotation_ends: DataFrame, *, by: Sequence[str] = (), min_support: int = N.MIN_SUPPORT, tolerance: int = S.LABEL_TOLERANCE) -> DataFrame:
    """Consensus groups of all samples with the reason they were dropped, NULL for novel ones."""
    groups = N.consensus_summary(N.consensus_groups(assemblies, by=by, tolerance=tolerance), by=by)
    return N.select_novel(groups, annotation_ends, by=by, min_support=min_support, tolerance=tolerance)


def augmented_lines(chosen: DataFrame, assembly_lines: DataFrame, annotation: DataFrame) -> DataFrame:
    """Reference lines followed by the renamed lines of the novel representatives."""
    kept = chosen.where("reason is null").selectExpr(
        "representative_assembler as assembler_id", "representative_transcript_id as transcript_id", "new_gene_id", "new_transcript_id"
    )
    return N.union_annotation(annotation, N.rename_lines(assembly_lines, kept))


def cohort_report(long: DataFrame) -> dict[str, DataFrame]:
    """Distribution, rank-test and correction tables of two cohorts."""
    tests = cohorts.rank_tests(long)
    pvalues = tests.selectExpr("stack(2, ks_pvalue, mannwhitney_pvalue) as (pvalue)")
    return {
        "distributions": cohorts.distributions(long),
        "tests": tests,
        "correction": cohorts.bonferroni(pvalues),
    }
