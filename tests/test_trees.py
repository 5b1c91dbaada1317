"""Node tables: splits that are undone, nested settings against walks down the trees."""

import itertools

import pytest
from conftest import rows
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from keepwatt.operators.forest import (
    VECTOR, WEIGHT, ForestParams, assemble, classifier, feature_importance, forest_of, predict,
    train_random_forest, with_scaler,
)
from keepwatt.operators import trees, tuning
from keepwatt.operators.hash_split import stratified_folds
from keepwatt.operators.preparation import prepare_data, weight_table
from keepwatt.operators.trees import (
    importances, nested_margins, store_forest, stored_nodes, with_depth,
    with_min_split, without_small_splits,
)
from keepwatt.operators.tuning import SearchSpace, cross_validate, train_random_forest_tuned
from keepwatt.session import shared_dir, stage, staging
from keepwatt.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def prepared(spark):
    df = spark.range(900).select(
        "id", F.rand(1).alias("noise"), F.rand(2).alias("signal"), F.rand(3).alias("other"))
    churn = (F.col("signal") + F.col("other") / 2 > 1).cast("int")
    return prepare_data(df.withColumn("churn", F.when(F.rand(4) < 0.15, 1 - churn).otherwise(churn)))


@pytest.fixture(scope="module")
def folded(prepared):
    rows_ = stratified_folds(prepared.train, "churn", ["id"], 3, 0)
    return stage(assemble(rows_, prepared.features, "churn"), "folds", ("fold",))


def by_tree(nodes):
    trees = {}
    for n in nodes.collect():
        trees.setdefault(n["treeID"], {})[n["id"]] = n
    return trees


def node(tree, id_, rows_, left=-1, right=-1, stats=(1.0, 1.0)):
    split = (0 if left >= 0 else -1, [0.5] if left >= 0 else [], -1)
    return (tree, id_, 0.0, 0.5, list(stats), rows_, 0.1 if left >= 0 else -1.0, left, right, split)


NODE = ("treeID int, id int, prediction double, impurity double, impurityStats array<double>, "
        "rawCount long, gain double, leftChild int, rightChild int, split struct<featureIndex: int,"
        "leftCategoriesOrThreshold: array<double>, numCategories: int>")


def test_small_splits_of_a_tree_made_by_hand(spark):
    tree = [node(0, 0, 20, 1, 6), node(0, 1, 9, 2, 5), node(0, 2, 4, 3, 4), node(0, 3, 2),
            node(0, 4, 2), node(0, 5, 5), node(0, 6, 11, 7, 8), node(0, 7, 3, ), node(0, 8, 8),
            node(1, 0, 3, 1, 2), node(1, 1, 1), node(1, 2, 2), node(2, 0, 30)]
    nodes = spark.createDataFrame(tree, NODE)

    def cut(least):
        return [tuple(r) for r in without_small_splits(nodes, least).select(
            "treeID", "id", "rawCount", "leftChild", "rightChild", "split.featureIndex").orderBy(
                "treeID", "id").collect()]

    assert cut(2) == [(r[0], r[1], r[5], r[7], r[8], r[9][0]) for r in tree]
    assert cut(5) == [(0, 0, 20, 1, 4, 0), (0, 1, 9, 2, 3, 0), (0, 2, 4, -1, -1, -1),
                      (0, 3, 5, -1, -1, -1), (0, 4, 11, 5, 6, 0), (0, 5, 3, -1, -1, -1),
                      (0, 6, 8, -1, -1, -1), (1, 0, 3, -1, -1, -1), (2, 0, 30, -1, -1, -1)]
    assert cut(10) == [(0, 0, 20, 1, 2, 0), (0, 1, 9, -1, -1, -1), (0, 2, 11, 3, 4, 0),
                       (0, 3, 3, -1, -1, -1), (0, 4, 8, -1, -1, -1), (1, 0, 3, -1, -1, -1),
                       (2, 0, 30, -1, -1, -1)]
    assert cut(100) == [(0, 0, 20, -1, -1, -1), (1, 0, 3, -1, -1, -1), (2, 0, 30, -1, -1, -1)]
    depths = with_depth(nodes.withColumn("model", F.lit(0)), 3)
    assert rows(depths.where("treeID = 0").select("depth", "rows_above"), "id") == [
        (0, None), (1, 20), (2, 9), (3, 4), (3, 4), (2, 9), (1, 20), (2, 11), (2, 11)]


def test_no_split_below_the_minimum_is_left(spark, prepared):
    whole = forest_of(train_random_forest(prepared, ForestParams(6, 6, 2, 2)))
    model = with_min_split(whole, 40, spark)
    nodes, before = (stored_nodes(spark, store_forest(f, spark)) for f in (model, whole))
    assert before.where("leftChild >= 0 AND rawCount < 40").count() > 0
    splits = ["treeID", "split.featureIndex", "split.leftCategoriesOrThreshold", "rawCount", "gain"]
    assert rows(nodes.where("leftChild >= 0").select(splits), *splits[:1], "rawCount", "gain") == rows(
        before.where("leftChild >= 0 AND rawCount >= 40").select(splits), *splits[:1], "rawCount", "gain")
    assert model.getNumTrees == 6 and model.numFeatures == 3
    trained = forest_of(train_random_forest(prepared, ForestParams(6, 6, 40, 2)))
    assert stored_nodes(spark, store_forest(trained, spark)).where("leftChild >= 0").agg(
        F.min("rawCount")).first()[0] >= 40


def walked(tree, vector, depth, least):
    at, level = tree[0], 0
    while at["leftChild"] >= 0 and level < depth and at["rawCount"] >= least:
        split = at["split"]
        left = vector[split["featureIndex"]] <= split["leftCategoriesOrThreshold"][0]
        at, level = tree[at["leftChild"] if left else at["rightChild"]], level + 1
    zero, one = at["impurityStats"]
    return one / (zero + one), zero / (zero + one)


def test_nested_settings_equal_walks_down_the_trees(spark, folded, monkeypatch):
    paths = []
    monkeypatch.setattr(tuning, "store_forest", lambda forest, spark: paths.append(
        store_forest(forest, spark)) or paths[-1])
    settings = [ForestParams(k, d, s, leaf) for k in (3, 6, 7) for d in (2, 4, 5)
                for s in (2, 9, 30) for leaf in (1, 4)]
    got = cross_validate(folded, settings, "churn", 3, parallelism=1)
    want = dict.fromkeys(settings, 0.0)
    for (fold, leaf), path in zip(itertools.product(range(3), (1, 4)), paths, strict=True):
        trees = by_tree(stored_nodes(spark, path))
        assert len(trees) == 7
        held = [r[VECTOR] for r in folded.where((F.col("fold") == fold) & (F.col("churn") == 1))
                .collect()]
        for s in (s for s in settings if s.min_samples_leaf == leaf):
            votes = [[walked(trees[t], v, s.max_depth, s.min_samples_split)
                      for t in range(s.n_estimators)] for v in held]
            hits = sum(sum(a for a, _ in some) > sum(b for _, b in some) for some in votes)
            want[s] += hits / len(held) / 3
    assert len(set(got)) > 5
    assert got == pytest.approx(list(want.values()))


@pytest.mark.parametrize("broadcast_leaves", [50_000, 0])
def test_rows_of_the_search_are_never_broadcast(spark, folded, monkeypatch, broadcast_leaves):
    """Their files are small, since rows of shallow trees reach few leaves; the rows are not."""
    joins = []

    def seen(self, other, on=None, how=None):
        joined = joined_by(self, other, on, how)
        if on == ["model", "tree", "leaf"]:
            joins.append(joined)
        return joined

    joined_by = type(folded).join
    monkeypatch.setattr(type(folded), "join", seen)
    monkeypatch.setattr(tuning, "BROADCAST_LEAVES", broadcast_leaves, raising=False)
    cross_validate(folded, [ForestParams(3, 2, 2, 1)], "churn", 3)
    plan = joins[-1]._jdf.queryExecution().executedPlan().toString()
    assert ("BuildRight" if broadcast_leaves else "SortMergeJoin") in plan
    assert "BuildLeft" not in plan


def test_nested_margins_of_the_whole_tree_are_those_of_the_model(spark, prepared, folded):
    train = folded.join(weight_table(folded, "churn", WEIGHT), "churn")
    forest = classifier(ForestParams(5, 7, 2, 1), "churn").fit(train).setLeafCol("leaves")
    nodes = stored_nodes(spark, store_forest(forest, spark)).withColumn("model", F.lit(0))
    margins = {(r["tree"], r["leaf"]): r["m0"]
               for r in nested_margins(nodes, [(7, 2)], 7).collect()}
    for row in forest.transform(folded).limit(80).collect():
        sums = sum(margins[t, int(leaf)] for t, leaf in enumerate(row["leaves"]))
        assert sums == pytest.approx(row["rawPrediction"][1] - row["rawPrediction"][0])


def test_large_forests_are_written_tree_by_tree(spark, prepared, monkeypatch, tmp_path):
    """Spark's writer makes rows of all nodes in the driver at once."""
    model = train_random_forest(prepared, ForestParams(12, 5, 10, 1))
    forest_of(model).write().save(str(tmp_path / "whole"))
    want = rows(stored_nodes(spark, str(tmp_path / "whole")), "treeID", "id")
    monkeypatch.setattr(trees, "NODES_AT_ONCE", 0, raising=False)
    monkeypatch.setattr(type(forest_of(model)), "write", None)
    with staging(spark) as written:
        path = store_forest(forest_of(model), spark)
        assert rows(stored_nodes(spark, path), "treeID", "id") == want
        save_model(with_scaler(prepared, model), str(tmp_path / "model"))
        assert all(folder.startswith(shared_dir(spark)) for folder in written)
    loaded = load_model(str(tmp_path / "model"))
    assert forest_of(loaded).treeWeights == forest_of(model).treeWeights
    assert forest_of(loaded).uid == forest_of(model).uid
    assert forest_of(loaded).getOrDefault("maxDepth") == 5
    columns = ["id", "prediction"]
    assert rows(predict(PipelineModel(loaded.stages[1:]), prepared.data).select(columns), "id") == rows(
        predict(model, prepared.data).select(columns), "id")


def test_importances_of_nodes(spark, prepared):
    model = train_random_forest(prepared, ForestParams(8, 5, 10, 1))
    nodes = stored_nodes(spark, store_forest(forest_of(model), spark))
    got = dict(rows(importances(nodes, prepared.features)))
    assert got == pytest.approx(dict(rows(
        feature_importance(spark, model, prepared.features))), abs=1.1e-4)
    alone = spark.createDataFrame([node(0, 0, 5)], NODE)
    assert rows(importances(alone, ["a", "b"])) == [("a", 0.0), ("b", 0.0)]


def test_search_refits_the_best_setting(spark, prepared):
    space = SearchSpace((3, 5), (2, 4), (2, 40), (1, 2))
    result = train_random_forest_tuned(prepared, n_trials=30, folds=3, space=space)
    assert len(result.trials) == 30 and result.best == max(result.trials, key=lambda t: t[1])[0]
    nodes = stored_nodes(spark, store_forest(forest_of(result.model), spark))
    assert forest_of(result.model).getNumTrees == result.best.n_estimators
    least = nodes.where("leftChild >= 0").agg(F.min("rawCount")).first()[0]
    assert least >= result.best.min_samples_split
