"""Feature table to trained, evaluated and explained forests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwatt.operators.forest import (
    ForestParams, evaluate_model, feature_importance, fitted_parameters, forest_of,
    train_random_forest,
)
from keepwatt.operators.preparation import (
    PreparedData, dummies, prepare_data, selectable_features,
)
from keepwatt.operators.trees import importances, store_forest, stored_nodes
from keepwatt.operators.tuning import SearchSpace, TuningResult, train_random_forest_tuned
from keepwatt.session import stage
from keepwatt.sources.models import ModelRegistry, data_version


@dataclass
class ChurnModel:
    """A forest for scaled rows, with the data it was trained and is tested on."""

    model: PipelineModel
    prepared: PreparedData
    params: ForestParams

    def scores(self) -> DataFrame:
        return evaluate_model(self.model, self.prepared.test, self.prepared.target)

    def importance(self) -> DataFrame:
        return feature_importance(self.prepared.data.sparkSession, self.model,
                                  self.prepared.features)

    def importance_of_nodes(self) -> DataFrame:
        """The same importances, added up from the stored trees."""
        spark = self.prepared.data.sparkSession
        nodes = stored_nodes(spark, store_forest(forest_of(self.model), spark))
        return importances(nodes, self.prepared.features)

    def parameters(self) -> DataFrame:
        return fitted_parameters(self.prepared.data.sparkSession, self.model, self.params)


def encoded_features(features: DataFrame) -> DataFrame:
    return dummies(features, ["channel_sales"])


def prepare_and_stage(encoded: DataFrame, chosen: Sequence[str] | None = None,
                      fill_missing: float | None = 0.0, seed: int = 0) -> PreparedData:
    """Prepare the model input and write it once, since every fit and evaluation reads it."""
    prepared = prepare_data(encoded, features=chosen, fill_missing=fill_missing, seed=seed)
    prepared.data = stage(prepared.data, "prepared", ("split",))
    return prepared


def custom_model(encoded: DataFrame, chosen: Sequence[str] | None = None,
                 params: ForestParams = ForestParams(), registry: ModelRegistry | None = None,
                 version: str | None = None, seed: int = 0) -> ChurnModel:
    """A forest on the chosen features (default: all of them). With a registry, stored data
    and model are used unless features, settings, seed or the data changed. The version of the
    data is a digest of the ids, the features and the label, unless the caller knows one."""
    def build() -> tuple[PreparedData, PipelineModel]:
        prepared = prepare_and_stage(encoded, chosen, seed=seed)
        return prepared, train_random_forest(prepared, params, seed)

    if registry is None:
        prepared, model = build()
    else:
        features = chosen or selectable_features(encoded)
        used = encoded.select(*[F.col(f"`{c}`") for c in ("id", "churn", *features)])
        key = registry.key(features, params, version or data_version(used), seed)
        prepared, model = registry.fit_or_load(key, build, params)
        params = registry.settings(key)
    return ChurnModel(model, prepared, params)


def tuned_model(encoded: DataFrame, n_trials: int = 50, folds: int = 5,
                space: SearchSpace = SearchSpace(), seed: int = 0, parallelism: int = 4,
                chosen: Sequence[str] | None = None) -> tuple[ChurnModel, TuningResult]:
    """The forest with the best cross-validated recall, on the chosen features (default: all)."""
    prepared = prepare_and_stage(encoded, chosen, seed=seed)
    result = train_random_forest_tuned(prepared, n_trials, folds, space, seed,
                                       parallelism=parallelism)
    return ChurnModel(result.model, prepared, result.best), result
