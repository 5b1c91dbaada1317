"""Class-balanced random forests: training, prediction, evaluation and importance."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwatt.operators.growing import grow_forests
from keepwatt.operators.preparation import PreparedData, weight_table
from keepwatt.operators.trees import (
    WIDE, StoredForest, load_forest, store_forest, store_with_nodes, with_min_split,
)

MAX_DEPTH = 30
MAX_CLASSES = 100  # Spark's limit
VECTOR = "feature_vector"
WEIGHT = "class_weight"


@dataclass(frozen=True)
class ForestParams:
    """Forest settings. Spark has no minimum size for splitting a node, only one for the two
    children; smaller splits are undone in the fitted trees."""

    n_estimators: int = 100
    max_depth: int = 20
    min_samples_split: int = 2
    min_samples_leaf: int = 1

    def __post_init__(self):
        if self.max_depth > MAX_DEPTH:
            raise ValueError(f"max_depth {self.max_depth} is above Spark's limit of {MAX_DEPTH}")

    @property
    def undoes_splits(self) -> bool:
        """Whether a split that leaves enough rows on both sides may still be too small."""
        return self.min_samples_split > 2 * self.min_samples_leaf

    def as_dict(self) -> dict[str, int]:
        return asdict(self)


def classifier(params: ForestParams, target: str, seed: int = 0,
               max_bins: int = 128) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol=VECTOR, labelCol=target, weightCol=WEIGHT,
        numTrees=params.n_estimators, maxDepth=params.max_depth,
        minInstancesPerNode=params.min_samples_leaf,
        featureSubsetStrategy="sqrt", maxBins=max_bins, seed=seed,
        # fewer passes over the data per tree level, and row-to-node ids instead of whole
        # trees sent to the tasks once trees get deep
        maxMemoryInMB=512, cacheNodeIds=params.max_depth > 10,
    )


def fit_forest(weighted: DataFrame, params: ForestParams, target: str, seed: int = 0,
               max_bins: int = 128) -> StoredForest | RandomForestClassificationModel:
    """A forest on rows with a vector, a label and the weight of the label's class."""
    return load_forest(stored_forests(
        weighted, params, [params.min_samples_leaf], target, seed, max_bins)[0])


def stored_forests(weighted: DataFrame, params: ForestParams, leaf_sizes: Sequence[int],
                   target: str, seed: int = 0, max_bins: int = 128) -> list[str]:
    """The folders of forests on the same rows, one for each minimum leaf size.

    Their trees are grown by ``grow_forests``, whose cost follows the rows. The models take their
    settings and their description from ones that Spark fits on a row for each class.
    """
    spark = weighted.sparkSession
    own = [classifier(replace(params, min_samples_leaf=size), target, seed, max_bins)
           for size in leaf_sizes]
    first = weighted.select(F.size(vector_to_array(VECTOR)).alias("width")).first()
    classes = {r[target]: r for r in weighted.groupBy(target).agg(
        F.count(F.lit(1)).alias("n"), F.first(WEIGHT).alias(WEIGHT)).limit(
            MAX_CLASSES + 1).collect()}
    plain = all(label >= 0 and label == int(label) for label in classes)
    if not classes or not plain or max(classes) >= MAX_CLASSES or not 0 < first["width"] < WIDE:
        return [store_forest(each.fit(weighted), spark) for each in own]
    width, n_classes = first["width"], int(max(classes)) + 1
    one_each = spark.createDataFrame(
        [(float(k), Vectors.dense([float(k)] * width), 1.0) for k in range(n_classes)],
        [target, VECTOR, WEIGHT]).coalesce(1)
    weights = [float(classes[k][WEIGHT]) if k in classes else 1.0 for k in range(n_classes)]
    forests = grow_forests(weighted, VECTOR, target, WEIGHT, weights,
                           sum(r["n"] for r in classes.values()), width, params.n_estimators,
                           params.max_depth, leaf_sizes, max_bins, seed)
    return [store_with_nodes(store_forest(each.fit(one_each), spark), nodes)
            for each, nodes in zip(own, forests, strict=True)]


def assembler(features: list[str]) -> PipelineModel:
    """Features to one vector. The assembler takes a dot in a name for a field of a struct, so
    such columns go in under other names."""
    inputs = {c: f"{VECTOR}_{k}" if set(c) & set(".`") else c for k, c in enumerate(features)}
    renamed = ", ".join(f"`{c.replace('`', '``')}` AS {new}"
                        for c, new in inputs.items() if c != new)
    vectors = VectorAssembler(inputCols=list(inputs.values()), outputCol=VECTOR,
                              handleInvalid="error")
    rename = [SQLTransformer(statement=f"SELECT *, {renamed} FROM __THIS__")] if renamed else []
    return PipelineModel([*rename, vectors])


def assemble(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Numeric label and feature vector; the separate feature columns are left behind."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in features and c != target]
    return assembler(features).transform(df).select(
        *rest, F.col(target).cast("double").alias(target), VECTOR)


def train_random_forest(prepared: PreparedData, params: ForestParams = ForestParams(),
                        seed: int = 0) -> PipelineModel:
    """Fit on the training rows with balanced class weights.

    The returned pipeline holds assembler and forest and works on scaled rows.
    """
    vectors = assembler(prepared.features)
    train = assemble(prepared.train, prepared.features, prepared.target)
    weighted = train.join(weight_table(train, prepared.target, WEIGHT), prepared.target)
    forest = fit_forest(weighted, params, prepared.target, seed)
    if params.undoes_splits:
        forest = with_min_split(forest, params.min_samples_split, train.sparkSession)
    return PipelineModel([*vectors.stages, forest])


def with_scaler(prepared: PreparedData, model: PipelineModel) -> PipelineModel:
    """The same model for unscaled rows; this is what should be saved."""
    return PipelineModel([prepared.scaler, *model.stages])


def forest_of(model: PipelineModel) -> StoredForest | RandomForestClassificationModel:
    return model.stages[-1]


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    made = [c for c in out.columns if c.startswith(VECTOR)]
    return out.drop(*made, "rawPrediction", "probability")


def evaluate_predictions(df: DataFrame, label: str = "churn",
                         prediction: str = "prediction", digits: int = 2) -> DataFrame:
    """Recall, precision (of class 1) and accuracy in one pass, as (metric, value) rows.

    A metric without any row to base it on is 0.
    """
    is_true, is_guessed = F.col(label) == 1, F.col(prediction) == 1
    counts = df.agg(
        F.count_if(is_true & is_guessed).alias("hits"),
        F.count_if(is_true).alias("positives"),
        F.count_if(is_guessed).alias("guessed"),
        F.count_if(F.col(label) == F.col(prediction)).alias("right"),
        F.count(F.lit(1)).alias("rows"),
    )

    def share(part: str, whole: str):
        return F.round(F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0)), digits)

    metrics = [("Recall", share("hits", "positives")), ("Precision", share("hits", "guessed")),
               ("Accuracy", share("right", "rows"))]
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in metrics])))


def evaluate_model(model: PipelineModel, test: DataFrame, target: str = "churn") -> DataFrame:
    return evaluate_predictions(predict(model, test), target)


def feature_importance(spark: SparkSession, model: PipelineModel, features: list[str],
                       names: DataFrame | None = None) -> DataFrame:
    """(feature, importance) in ascending order; the importances sum to 1. Where features are
    vectors, ``names`` (column, position, value) has the values that their places stand for."""
    raw = forest_of(model).featureImportances
    total = float(raw.toArray().sum()) or 1.0
    found = [(int(i), float(v) / total) for i, v in zip(raw.indices, raw.values, strict=True)]
    sizes = {} if names is None else {r["column"]: r["count"] for r in names.groupBy(
        "column").count().collect()}
    starts = dict(zip(features, itertools.accumulate(
        (sizes.get(c, 1) for c in features), initial=0), strict=False))
    places = spark.createDataFrame([(starts[c], c) for c in features if c not in sizes],
                                   "at int, feature string")
    if sizes:
        start = F.create_map(*[F.lit(x) for c in sizes for x in (c, starts[c])])
        places = places.unionByName(names.select(
            (start[F.col("column")] + F.col("position")).alias("at"),
            F.concat_ws("_", "column", "value").alias("feature")))
    table = places.join(spark.createDataFrame(found, "at int, importance double"), "at", "left")
    return table.select("feature", F.round(F.coalesce("importance", F.lit(0.0)), 4).alias(
        "importance")).orderBy("importance", "feature")


def fitted_parameters(spark: SparkSession, model: PipelineModel,
                      params: ForestParams) -> DataFrame:
    """The settings of a fitted or loaded model as one row, as its forest holds them. Spark does
    not know a minimum split size; that one comes from ``params``."""
    forest = forest_of(model)
    return model_parameters(spark, ForestParams(
        forest.getNumTrees, forest.getOrDefault("maxDepth"), params.min_samples_split,
        forest.getOrDefault("minInstancesPerNode")))


def model_parameters(spark: SparkSession, params: ForestParams) -> DataFrame:
    """The forest's four settings as one row."""
    values = params.as_dict()
    return spark.createDataFrame(
        [tuple(values.values())], ", ".join(f"{name} int" for name in values))
