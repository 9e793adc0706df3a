"""Classifiers for sites and transcripts on Spark ML.

Tree ensembles of other libraries have no exact twin in Spark ML, so scores are
comparable by quality, not by value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler, VarianceThresholdSelector
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from endsight.operators.compare import numeric_features
from endsight.operators.ranking import average_precision, classification_metrics, rank_index
from endsight.operators.scale import cut_lineage, skew_join, written

# Seed and default sizes of the three models.
SEED = 42
FOREST = {"numTrees": 300, "maxDepth": 30, "featureSubsetStrategy": "sqrt"}
BOOSTED = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
RANKER = {
    "maxIter": 300, "maxDepth": 4, "stepSize": 0.03, "subsamplingRate": 0.7,
    "featureSubsetStrategy": "0.7", "minInstancesPerNode": 20,
}
# Numbers that say where a site lies or what is to be learned, also with the suffix of a transcript's end.
PLACES = {"position", "tss_pos", "tes_pos", "chrom_num"}
TARGET = "label"
# One array with all features of a row, see ``packed``.
PACKED = "_features"
NUMERIC = {"int", "bigint", "double", "float", "smallint", "tinyint"}


def feature_names(df: DataFrame) -> list[str]:
    """Numeric columns that are neither places nor labels; ids are text and never among them."""
    known = PLACES | {TARGET}
    stem = {c: c.removesuffix("_tss").removesuffix("_tes") for c in df.columns}
    return [c for c, t in df.dtypes if t in NUMERIC and c not in known and stem[c] not in known]


def packed(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns and one array with the features in the order of their names.

    Rows of more than a hundred columns are read and assembled slowly, and every pass of a fit would do it again.
    """
    rows = numeric_features(df, features, keep=[F.col(k).alias(f"_k_{k}") for k in keep])
    return rows.select(*[F.col(f"_k_{k}").alias(k) for k in keep], F.array(*[F.col(f) for f in features]).alias(PACKED))


@dataclass
class Classifier:
    """A fitted pipeline, or a constant when training saw one class only."""

    features: list[str]
    pipeline: PipelineModel | None
    constant: float = 0.0

    def contract(self, df: DataFrame) -> tuple[list[str], list[str]]:
        """Features of the model that ``df`` lacks, and numeric columns of ``df`` that the model does not know."""
        return (
            [f for f in self.features if f not in df.columns],
            [c for c in feature_names(df) if c not in self.features],
        )

    def score(self, df: DataFrame, column: str, keep: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
        """``keep`` columns and the probability of class 1.

        Features are taken by name: their order in ``df`` does not matter, further columns are left
        out, and a missing one counts as 0 (see ``contract``).  Where rows are ``packed``, ``names`` says in which order.
        """
        if self.pipeline is None:
            return df.select(*keep, F.lit(self.constant).alias(column))
        if names is None:
            return self.score(packed(df, self.features, keep), column, keep, self.features)
        place = {n: i for i, n in enumerate(names)}
        values = F.col(PACKED)
        if list(names) != list(self.features):
            values = F.array(*[values[place[f]] if f in place else F.lit(0.0) for f in self.features])
        scored = self.pipeline.stages[-1].transform(df.select(*keep, array_to_vector(values).alias("features")))
        return scored.select(*keep, vector_to_array("probability")[1].alias(column))

    def importances(self, spark: SparkSession) -> DataFrame:
        """``feature, importance``, one row per feature of the model."""
        values = self.pipeline.stages[-1].featureImportances.toArray() if self.pipeline else [0.0] * len(self.features)
        return spark.createDataFrame(
            [(f, float(v)) for f, v in zip(self.features, values)], "feature string, importance double"
        )

    def save(self, path: str, spark: SparkSession) -> None:
        spark.createDataFrame(
            [(self.features, float(self.constant), self.pipeline is not None)],
            "features array<string>, constant double, fitted boolean",
        ).write.mode("overwrite").parquet(f"{path}/about")
        if self.pipeline is not None:
            self.pipeline.write().overwrite().save(f"{path}/pipeline")

    @staticmethod
    def load(path: str, spark: SparkSession) -> Classifier:
        about = spark.read.parquet(f"{path}/about").first()
        pipeline = PipelineModel.load(f"{path}/pipeline") if about["fitted"] else None
        return Classifier(list(about["features"]), pipeline, about["constant"])


def _estimator(kind: str, params: dict, weights: dict | None = None):
    common = {"featuresCol": "features", "labelCol": "label", "seed": SEED}
    if kind == "rf":
        return RandomForestClassifier(**common, weightCol="_weight", **(FOREST | params))
    if kind == "xgb":
        return GBTClassifier(**common, **(weights or {}), **(BOOSTED | params))
    if kind == "ranker":
        return GBTClassifier(**common, **(weights or {}), **(RANKER | params))
    raise ValueError(f"unknown model kind {kind!r}")


def fit(
    train: DataFrame, features: Sequence[str], *, kind: str, params: dict | None = None, copies: str | None = None
) -> Classifier:
    """Fit one model on ``label`` 0/1; the forest weighs classes by ``n / (2 * n_class)``.

    Rows without a label are not learned from.  ``train`` may be ``packed``.  A row stands for as many equal ones as the
    column ``copies`` says: it weighs as much, and is drawn or left out by the samples of the trees as one.
    Assembled rows are written once, as a fit reads them several times.
    """
    if PACKED not in train.columns:
        train = packed(train, features, ["label", *([copies] if copies else [])])
    count = F.col(copies).cast("double") if copies else F.lit(1.0)
    rows = written(
        train.where("label is not null").select(
            F.col("label").cast("double").alias("label"), array_to_vector(PACKED).alias("features"), count.alias("_copies")
        )
    )
    ones, zeros = rows.agg(F.expr("sum(if(label = 1, _copies, 0D))"), F.expr("sum(if(label = 1, 0D, _copies))")).first()
    if not (ones or zeros):
        raise ValueError("no training rows")
    if not ones or not zeros:
        return Classifier(list(features), None, 1.0 if ones else 0.0)
    total = ones + zeros
    balance = F.when(F.col("label") == 1, total / (2 * ones)).otherwise(total / (2 * zeros))
    weighed = rows.withColumn("_weight", F.col("_copies") * balance if kind == "rf" else F.col("_copies"))
    model = _estimator(kind, params or {}, {"weightCol": "_weight"} if copies else None).fit(weighed)
    return Classifier(list(features), PipelineModel([VectorAssembler(inputCols=list(features), outputCol="features"), model]))


def validation_metrics(scored: DataFrame, probability: str, by: Sequence[str], *, copies: str | None = None) -> DataFrame:
    """Classification metrics at 0.5, average precision and ROC AUC per group; rows are scored once for both.

    A row counts as many times as the column ``copies`` says.
    """
    scored = cut_lineage(scored.select(*by, "label", probability, *([copies] if copies else [])))
    at_half = scored.withColumn("_pred", (F.col(probability) >= 0.5).cast("int"))
    metrics = classification_metrics(at_half, by=by, label="label", prediction="_pred", copies=copies)
    ranked = average_precision(scored, by=by, label="label", score=probability, copies=copies)
    return metrics.join(ranked, list(by), "left")


SITE_KEYS = ("transcript_id", "site_type", "chrom", "position", "strand")


def score_sites(features: DataFrame, models: dict[tuple[str, str], Classifier], keep: Sequence[str] = SITE_KEYS, names: Sequence[str] | None = None) -> DataFrame:
    """``keep``, ``p_site_rf`` and ``p_site_xgb`` for every row of sites or of places; ``models`` is keyed by (site type, backend).

    Each row is scored by the models of its own type; a missing model gives 0.5.  ``names`` are those of packed rows.
    """
    parts = []
    for site_type in ("TSS", "TES"):
        rows = features.where(F.upper("site_type") == site_type)
        out = rows
        for backend in ("rf", "xgb"):
            column, model = f"p_site_{backend}", models.get((site_type, backend))
            if model is None:
                out = out.withColumn(column, F.lit(0.5))
            else:
                out = model.score(out, column, keep=out.columns, names=names)
        parts.append(out.select(*keep, "p_site_rf", "p_site_xgb"))
    return parts[0].unionByName(parts[1])


def low_variance(df: DataFrame, features: Sequence[str], threshold: float = 0.01) -> list[str]:
    """Features whose sample variance exceeds ``threshold``."""
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(numeric_features(df, features))
    selector = VarianceThresholdSelector(featuresCol="features", outputCol="kept", varianceThreshold=threshold)
    return [features[i] for i in sorted(selector.fit(rows).selectedFeatures)]


def uncorrelated(df: DataFrame, features: Sequence[str], threshold: float = 0.95) -> list[str]:
    """Features that correlate with no earlier feature above ``threshold``."""
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(numeric_features(df, features))
    matrix = Correlation.corr(rows, "features").first()[0].toArray()
    return [f for j, f in enumerate(features) if not any(abs(matrix[i][j]) > threshold for i in range(j))]


def univariate(df: DataFrame, features: Sequence[str], k: int) -> list[str]:
    """The ``k`` features with the strongest single-feature dependence on the label."""
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(
        numeric_features(df, features, keep=["label"])
    )
    selector = UnivariateFeatureSelector(featuresCol="features", labelCol="label", outputCol="kept", selectionMode="numTopFeatures")
    fitted = selector.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k).fit(rows)
    return [features[i] for i in sorted(fitted.selectedFeatures)]


def select_by_importance(df: DataFrame, features: Sequence[str], *, params: dict | None = None) -> DataFrame:
    """Forest importances learned on ``df``, the caller's train split, most important first."""
    model = fit(df, features, kind="rf", params={"numTrees": 100} | (params or {}))
    return model.importances(df.sparkSession).orderBy(F.desc("importance"), "feature")


def stratified_split(df: DataFrame, keys: Sequence[str], *, test_share: float = 0.2) -> DataFrame:
    """Mark a share of each class as test rows, chosen by the hash of the keys."""
    hashed = df.withColumn("_h", F.xxhash64(F.lit(SEED), *keys))
    ranked = rank_index(hashed, by=["label"], order=[F.col("_h"), *[F.col(k) for k in keys]])
    sizes = ranked.groupBy("label").agg((F.max("rank_idx") + 1).alias("_n"))
    joined = skew_join(ranked, sizes, ["label"], "inner")
    return joined.withColumn("is_test", F.col("rank_idx") < F.col("_n") * test_share).drop("_h", "_n", "rank_idx")


def cross_validated_accuracy(df: DataFrame, features: Sequence[str], *, kind: str, params: dict, folds: int = 5) -> float:
    """Mean accuracy over folds."""
    rows = numeric_features(df, features, keep=["label"]).withColumn("_weight", F.lit(1.0))
    pipeline = Pipeline(
        stages=[VectorAssembler(inputCols=list(features), outputCol="features"), _estimator(kind, params)]
    )
    validator = CrossValidator(
        estimator=pipeline, estimatorParamMaps=ParamGridBuilder().build(), numFolds=folds, seed=SEED,
        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
    )
    return float(validator.fit(rows).avgMetrics[0])
