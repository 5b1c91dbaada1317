"""Stored models, stored train/test data, and a registry that retrains only on change."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwatt.operators.forest import ForestParams
from keepwatt.operators.preparation import PreparedData
from keepwatt.operators.trees import load_forest, save_forest


def save_model(model: PipelineModel, path: str) -> None:
    """The forest, which is the last stage, and the stages before it, in two folders."""
    *before, forest = model.stages
    PipelineModel(before).write().overwrite().save(f"{path}/before")
    save_forest(forest, SparkSession.active(), f"{path}/forest")


def load_model(path: str) -> PipelineModel:
    """The model, whose forest stays in its folder."""
    before = PipelineModel.load(f"{path}/before")
    return PipelineModel([*before.stages, load_forest(f"{path}/forest")])


def save_prepared(prepared: PreparedData, path: str) -> None:
    """One Parquet table, a folder per side of the split, with the scaler next to it."""
    prepared.data.write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    prepared.scaler.write().overwrite().save(f"{path}/scaler")
    roles = {"features": prepared.features, "target": prepared.target}
    spark = prepared.data.sparkSession
    (spark.createDataFrame([(json.dumps(roles),)], "roles string").coalesce(1)
     .write.mode("overwrite").json(f"{path}/roles"))


def load_prepared(spark: SparkSession, path: str) -> PreparedData:
    roles = json.loads(spark.read.schema("roles string").json(f"{path}/roles").first()[0])
    return PreparedData(spark.read.parquet(f"{path}/rows"),
                        SQLTransformer.load(f"{path}/scaler"),
                        roles["features"], roles["target"])


def data_version(df: DataFrame) -> str:
    """A digest of a table's columns, types and rows, from one aggregate.

    Two sums of row hashes do not depend on the order of the rows or on how they are dealt out,
    but on every cell, on missing values and on how often a row occurs. The order of the columns
    does not count.
    """
    fields = sorted(df.schema, key=lambda f: f.name)
    cells = [c for f in fields for c in (F.col(f"`{f.name}`").isNull(), F.col(f"`{f.name}`"))]
    sums = [F.sum(F.xxhash64(F.lit(turn), *cells).cast("decimal(20,0)")) for turn in (0, 1)]
    row = df.agg(F.count(F.lit(1)), *sums).first()
    content = [[f.name, f.dataType.simpleString()] for f in fields] + [str(v) for v in row]
    return hashlib.sha256(json.dumps(content).encode()).hexdigest()[:32]


class ModelRegistry:
    """Models with their train/test data under one folder, each keyed by features, settings,
    seed and data version.

    Asking again for the same combination loads what is stored instead of preparing and
    training. An entry counts once its ``ready`` table exists, which is written last, so a job
    that died halfway leaves nothing that could be taken for a model.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def key(self, features: Sequence[str], params: ForestParams, data_version: str,
            seed: int = 0, target: str = "churn", test_size: float = 0.2,
            fill_missing: float | None = 0.0) -> str:
        content = {"features": sorted(features), "params": params.as_dict(),
                   "data": data_version, "seed": seed, "target": target, "layout": 2,
                   "test_size": test_size, "fill_missing": fill_missing}
        return hashlib.sha256(json.dumps(content, sort_keys=True).encode()).hexdigest()[:32]

    def path(self, key: str) -> str:
        return f"{self.folder}/{key}"

    def has(self, key: str) -> bool:
        try:
            ready = self.spark.read.schema("key string").parquet(f"{self.path(key)}/ready")
            return bool(ready.take(1))
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return False
            raise

    def settings(self, key: str) -> ForestParams:
        """The settings a stored model was trained with."""
        ready = self.spark.read.schema("settings string").parquet(f"{self.path(key)}/ready")
        return ForestParams(**json.loads(ready.first()[0]))

    def load(self, key: str) -> tuple[PreparedData, PipelineModel]:
        path = self.path(key)
        return load_prepared(self.spark, f"{path}/prepared"), load_model(f"{path}/model")

    def fit_or_load(self, key: str, build: Callable[[], tuple[PreparedData, PipelineModel]],
                    params: ForestParams = ForestParams()) -> tuple[PreparedData, PipelineModel]:
        if not self.has(key):
            prepared, model = build()
            save_prepared(prepared, f"{self.path(key)}/prepared")
            save_model(model, f"{self.path(key)}/model")
            ready = [(key, json.dumps(params.as_dict()))]
            (self.spark.createDataFrame(ready, "key string, settings string").coalesce(1)
             .write.mode("overwrite").parquet(f"{self.path(key)}/ready"))
            # the driver need not hold the model twice
            del prepared, model
        return self.load(key)
