"""Hyperparameter search by cross-validated recall, and the comparison of two models."""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence
from contextvars import copy_context
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwatt.operators.forest import (
    VECTOR, WEIGHT, ForestParams, assemble, evaluate_model, stored_forests, train_random_forest,
)
from keepwatt.operators.hash_split import stratified_folds
from keepwatt.operators.preparation import PreparedData, weight_table
from keepwatt.operators.trees import (
    load_forest, nested_margins, reached_leaves, store_forest, stored_nodes,
)
from keepwatt.session import stage


BROADCAST_LEAVES = 50_000  # rows of the table of leaves, some 10 MB


@dataclass(frozen=True)
class SearchSpace:
    """Inclusive ranges of the four forest settings."""

    n_estimators: tuple[int, int] = (90, 110)
    max_depth: tuple[int, int] = (10, 12)
    min_samples_split: tuple[int, int] = (2, 5)
    min_samples_leaf: tuple[int, int] = (1, 3)

    def settings(self) -> list[ForestParams]:
        """All settings, the last range running fastest."""
        ranges = [range(lo, hi + 1) for lo, hi in (
            self.n_estimators, self.max_depth, self.min_samples_split, self.min_samples_leaf)]
        return [ForestParams(*values) for values in itertools.product(*ranges)]

    def sample(self, n_trials: int, seed: int = 0) -> list[ForestParams]:
        """``n_trials`` different settings; all of them if there are not more."""
        settings = self.settings()
        if n_trials >= len(settings):
            return settings
        return random.Random(seed).sample(settings, n_trials)


@dataclass
class TuningResult:
    model: PipelineModel
    best: ForestParams
    trials: list[tuple[ForestParams, float]]

    def trial_table(self, spark) -> DataFrame:
        rows = [(*params.as_dict().values(), score) for params, score in self.trials]
        names = [f"{name} int" for name in ForestParams().as_dict()]
        return spark.createDataFrame(rows, ", ".join([*names, "recall double"])).orderBy(
            F.desc("recall"), *ForestParams().as_dict())


def cross_validate(folded: DataFrame, settings: Sequence[ForestParams], target: str,
                   folds: int, seed: int = 0, parallelism: int = 2) -> list[float]:
    """Mean recall over the folds for each setting, on rows with a ``fold`` column.

    Settings are nested: the first trees of a forest are a smaller forest, the top of a tree is
    a less deep one, and a tree whose small splits are undone is one with a larger minimum
    split size. So one fit per fold and minimum leaf size, with the most trees and the greatest
    depth asked for, has all settings in it; trees are drawn once and shared by the settings.
    The fits of a fold bin and gather its rows together.
    The rows of class 1 are sent down these trees, and what every setting says of them is
    counted in one pass, whatever the number of settings.

    Class weights are those of the training folds. Up to ``parallelism`` fits run at a time;
    each of them is itself a distributed job.
    """
    spark = folded.sparkSession
    trees, depth = (max(getattr(s, name) for s in settings)
                    for name in ("n_estimators", "max_depth"))
    leaf_sizes = sorted({s.min_samples_leaf for s in settings})
    variants = sorted({(s.max_depth, s.min_samples_split) for s in settings})
    weights = [weight_table(folded.where(F.col("fold") != fold), target, WEIGHT)
               for fold in range(folds)]
    positives = {row["fold"]: row["n"] for row in folded.where(F.col(target) == 1).groupBy(
        "fold").agg(F.count(F.lit(1)).alias("n")).collect()}

    def grow(fold: int) -> list[str]:
        train = folded.where(F.col("fold") != fold).join(weights[fold], target)
        return stored_forests(train, ForestParams(trees, depth), leaf_sizes, target, seed)

    def send_down(job: tuple[int, int, str]) -> tuple[DataFrame, DataFrame]:
        fold, place, path = job
        name = F.lit(fold * len(leaf_sizes) + place).alias("model")
        forest = load_forest(path)
        held = folded.where((F.col("fold") == fold) & (F.col(target) == 1)).select(
            F.monotonically_increasing_id().alias("row"), VECTOR)
        reached = stage(reached_leaves(forest, held).select(name, "row", "tree", "leaf"), "leaves")
        return reached, stored_nodes(spark, store_forest(forest, spark)).select(
            name, "treeID", "id", "impurityStats", "rawCount", "leftChild", "rightChild")

    def at_once(work, jobs: Sequence) -> list:
        run = inheritable_thread_target(spark)(lambda job: job[0].run(work, job[1]))
        with ThreadPool(max(1, parallelism)) as pool:
            return pool.map(run, [(copy_context(), job) for job in jobs], chunksize=1)

    stored = at_once(grow, range(folds))
    sent = at_once(send_down, [(fold, place, path) for fold, paths in enumerate(stored)
                               for place, path in enumerate(paths)])
    reached, nodes = (reduce(DataFrame.unionByName, some) for some in zip(*sent, strict=True))
    margins = stage(nested_margins(nodes, variants, depth), "margins")
    # the side of the rows must not be broadcast, whatever its files say: the leaves that rows of
    # shallow trees reach take hardly any space in Parquet
    margins = (F.broadcast(margins) if margins.count() <= BROADCAST_LEAVES
               else margins.hint("merge"))
    # the votes of the first trees, up to each one
    upto = Window.partitionBy("model", "row").orderBy("tree")
    votes = reached.join(margins, ["model", "tree", "leaf"]).select("model", "tree", *[
        F.sum(f"m{v}").over(upto).alias(f"m{v}") for v in range(len(variants))])
    counts = sorted({s.n_estimators - 1 for s in settings})
    hits = {(row["model"], row["tree"]): row for row in votes.where(
        F.col("tree").isin(counts)).groupBy("model", "tree").agg(*[
            F.count_if(F.col(f"m{v}") > 0).alias(f"m{v}") for v in range(len(variants))]).collect()}

    def recall(params: ForestParams, fold: int) -> float:
        model = fold * len(leaf_sizes) + leaf_sizes.index(params.min_samples_leaf)
        variant = variants.index((params.max_depth, params.min_samples_split))
        if not positives.get(fold):
            return 0.0
        return hits[model, params.n_estimators - 1][f"m{variant}"] / positives[fold]

    return [sum(recall(params, fold) for fold in range(folds)) / folds for params in settings]


def train_random_forest_tuned(prepared: PreparedData, n_trials: int = 50, folds: int = 5,
                              space: SearchSpace = SearchSpace(), seed: int = 0,
                              keys: Sequence[str] = ("id",),
                              parallelism: int = 4) -> TuningResult:
    """Try ``n_trials`` settings, keep the one with the best mean recall and refit it on all
    training rows. The sample of settings is seeded, so the search can be repeated.

    The assembled training rows are written once and read by every fit.
    """
    rows = stratified_folds(prepared.train, prepared.target, keys, folds, seed)
    folded = stage(assemble(rows, prepared.features, prepared.target), "folds", ("fold",))
    settings = space.sample(n_trials, seed)
    scores = cross_validate(folded, settings, prepared.target, folds, seed, parallelism)
    trials = list(zip(settings, scores, strict=True))
    best = max(trials, key=lambda trial: trial[1])[0]
    return TuningResult(train_random_forest(prepared, best, seed), best, trials)


def compare_models(models: dict[str, tuple[PipelineModel, PreparedData]]) -> DataFrame:
    """(model, metric, value) on each model's own test rows."""
    tables = [
        evaluate_model(model, prepared.test, prepared.target)
        .select(F.lit(name).alias("model"), "metric", "value")
        for name, (model, prepared) in models.items()
    ]
    return reduce(DataFrame.unionByName, tables)
