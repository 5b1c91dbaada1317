"""Forests grown by tasks: splits against trying all of them, large nodes, Spark's own forest."""

import numpy as np
import pytest
from conftest import rows
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from keepwatt.operators import growing
from keepwatt.operators.forest import (
    VECTOR, WEIGHT, ForestParams, assemble, classifier, evaluate_model, fit_forest, forest_of,
    stored_forests, train_random_forest,
)
from keepwatt.operators.growing import Growth, gains, grow
from keepwatt.operators.preparation import prepare_data, weight_table
from keepwatt.operators.trees import stored_nodes


@pytest.fixture(scope="module")
def prepared(spark):
    df = spark.range(1500).select(
        "id", F.rand(1).alias("noise"), F.rand(2).alias("signal"), F.rand(3).alias("other"),
        (F.rand(5) * 3).cast("int").alias("few"))
    churn = (F.col("signal") + F.col("other") / 2 > 1).cast("int")
    return prepare_data(df.withColumn("churn", F.when(F.rand(4) < 0.1, 1 - churn).otherwise(churn)))


@pytest.fixture(scope="module")
def weighted(prepared):
    train = assemble(prepared.train, prepared.features, "churn")
    return train.join(weight_table(train, "churn", WEIGHT), "churn")


def made(n, width, classes, seed=0):
    draw = np.random.default_rng(seed)
    return (draw.integers(0, 16, (width, n), dtype=np.uint8),
            draw.integers(0, classes, n, dtype=np.uint8), draw.integers(1, 4, n, dtype=np.uint8))


def growth_of(width, classes, subset=None, least=1, depth=30):
    return Growth(1, depth, least, subset or width, 16, 0, tuple(1.0 + k for k in range(classes)),
                  [np.arange(15) + 0.5] * width)


@pytest.mark.parametrize("n, classes, least", [(40, 2, 1), (300, 2, 5), (200, 3, 2)])
def test_splits_are_the_best_of_all(n, classes, least):
    bins, labels, drawn = made(n, 4, classes)
    growth = growth_of(4, classes, least=least)
    tree = grow(bins, labels, drawn, 0, growth, np.random.default_rng(0))
    at = {int(k): i for i, k in enumerate(tree["id"])}
    assert sorted(at) == list(range(len(at)))

    def check(node, inside):
        i = at[node]
        total = np.bincount(labels[inside], drawn[inside], classes)
        assert tree["counts"][:, i].tolist() == total.tolist()
        best = max((float(gains(np.bincount(labels[inside & (bins[f] <= c)], drawn[
            inside & (bins[f] <= c)], classes), total, growth)), f, c)
            for f in range(4) for c in range(15))[0]
        if tree["feature"][i] < 0:
            return 1
        assert tree["gain"][i] == pytest.approx(best) and best > 0
        left = inside & (bins[tree["feature"][i]] <= tree["cut"][i])
        assert tree["first"][i] == node + 1
        size = check(node + 1, left)
        assert tree["second"][i] == node + 1 + size
        return 1 + size + check(int(tree["second"][i]), inside & ~left)

    assert check(0, np.ones(n, bool)) == len(at) == tree["size"][at[0]]


def test_rows_with_one_label_or_no_depth_are_a_leaf():
    bins, labels, drawn = made(50, 3, 2)
    for some, growth in ((labels * 0, growth_of(3, 2)), (labels, growth_of(3, 2, depth=0))):
        tree = grow(bins, some, drawn, 0, growth, np.random.default_rng(0))
        assert tree["id"].tolist() == [0] and tree["feature"].tolist() == [-1]


def test_rows_of_one_task_need_no_pass_over_all_rows():
    """The size of the training rows of 60 times sf0.1."""
    top, small = growing._grow_top(None, 720_000, growth_of(28, 2))
    assert small == [0] and top.feature == [-1]


def test_passes_draw_only_for_trees_with_wanted_nodes(monkeypatch):
    import pyarrow as pa
    bins, labels, _ = made(500, 3, 2)
    growth = Growth(4, 9, 1, 2, 16, 0, (1.0, 1.0), [np.arange(15) + 0.5] * 3)
    block = pa.RecordBatch.from_pydict({
        "part": [0], "block": [0], "labels": [labels.tobytes()], "bins": [bins.tobytes()]})
    # node 2, the root of the third tree, is split in 4 and 5, and 5 in 6 and 7
    feature, cut, left = np.array([-1, -1, 1, -1, -1, 0, -1, -1]), np.zeros(8, int) + 7, \
        np.array([-1, -1, 4, -1, -1, 6, -1, -1])
    tree_of = np.array([0, 1, 2, 3, 2, 2, 2, 2])
    seeds, make = [], np.random.default_rng
    monkeypatch.setattr(np.random, "default_rng", lambda seed: seeds.append(seed) or make(seed))
    found = {node: rows for _, _, _, node, rows in growing._drawn_rows(
        [block], growth, (feature, cut, left), np.isin(np.arange(8), [4, 7]), tree_of)}
    assert seeds == [[0, 0, 0, 2]]
    drawn = np.flatnonzero(make([0, 0, 0, 2]).poisson(1.0, 500))
    assert found[4].tolist() == drawn[bins[1, drawn] <= 7].tolist()
    assert found[7].tolist() == drawn[(bins[1, drawn] > 7) & (bins[0, drawn] > 7)].tolist()
    assert set(found) == {4, 7}


def checked(spark, forest, leaf=1):
    nodes = {(n["treeID"], n["id"]): n for n in stored_nodes(spark, forest.stored_at).collect()}
    reached = set()

    def walk(tree, k):
        node = nodes[tree, k]
        reached.add((tree, k))
        assert node["rawCount"] >= leaf
        if node["leftChild"] < 0:
            return
        both = [nodes[tree, node[c]] for c in ("leftChild", "rightChild")]
        assert sum(n["rawCount"] for n in both) == node["rawCount"]
        assert np.add(*[n["impurityStats"] for n in both]).tolist() == pytest.approx(
            node["impurityStats"])
        assert not (both[0]["leftChild"] < 0 and both[1]["leftChild"] < 0
                    and both[0]["prediction"] == both[1]["prediction"])
        walk(tree, node["leftChild"])
        walk(tree, node["rightChild"])

    for tree in range(forest.getNumTrees):
        walk(tree, 0)
    assert reached == set(nodes)
    return nodes


@pytest.mark.parametrize("group_rows, histogram_bytes", [(250_000, 64 << 20), (100, 64 << 20), (100, 1)])
def test_large_nodes_are_split_over_all_rows(spark, prepared, weighted, monkeypatch, group_rows,
                                             histogram_bytes):
    """The rows of a larger node are never in one task."""
    monkeypatch.setattr(growing, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(growing, "HISTOGRAM_BYTES", histogram_bytes)
    forest = fit_forest(weighted, ForestParams(5, 7, 2, 3), "churn")
    nodes = checked(spark, forest, leaf=3)
    per_leaf = rows(forest.setLeafCol("leaves").transform(weighted).select("prediction", "churn"))
    assert sum(a == b for a, b in per_leaf) > 0.85 * len(per_leaf)
    assert all(nodes[t, 0]["rawCount"] == pytest.approx(weighted.count(), rel=0.15)
               for t in range(5))


def test_leaf_sizes_share_bins_and_gathered_rows(spark, weighted, monkeypatch):
    staged, stage = [], growing.stage
    monkeypatch.setattr(growing, "stage", lambda df, name: staged.append(name) or stage(df, name))
    together = stored_forests(weighted, ForestParams(4, 6), [1, 3], "churn")
    assert staged == ["binned", "grown"]
    alone = [stored_forests(weighted, ForestParams(4, 6), [size], "churn")[0] for size in (1, 3)]
    nodes = [rows(stored_nodes(spark, path).select(
        "treeID", "id", "rawCount", "prediction", "leftChild", "split")) for path in together + alone]
    assert sorted(nodes[0]) == sorted(nodes[2]) and sorted(nodes[1]) == sorted(nodes[3])
    assert sorted(nodes[0]) != sorted(nodes[1])
    staged.clear()
    monkeypatch.setattr(growing, "GROUP_ROWS", 100)  # now the tops of the trees differ
    large = stored_forests(weighted, ForestParams(4, 6), [1, 3], "churn")
    assert staged == ["binned", "grown", "grown"]
    least = [stored_nodes(spark, path).agg(F.min("rawCount")).scalar() for path in large]
    assert spark.range(1).select(*least).first()[1] >= 3


def test_forest_is_as_good_as_that_of_spark(prepared, weighted):
    params = ForestParams(30, 8, 2, 1)
    spark_own = classifier(params, "churn").fit(weighted)
    ours = fit_forest(weighted, params, "churn")
    test = assemble(prepared.test, prepared.features, "churn")
    right = [m.transform(test).where("prediction = churn").count() / test.count()
             for m in (spark_own, ours)]
    assert right[1] > right[0] - 0.03
    assert ours.featureImportances.toArray() == pytest.approx(
        spark_own.featureImportances.toArray(), abs=0.06)
    assert ours.totalNumNodes == pytest.approx(spark_own.totalNumNodes, rel=0.15)
    assert (ours.numClasses, ours.numFeatures, ours.getOrDefault("maxDepth")) == (2, 4, 8)


def test_spark_fits_one_row_a_class_only(spark, prepared, monkeypatch):
    """Its statistics take nodes times bins in every task, however few rows a node has."""
    fitted = []
    fit = RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df, params=None: fitted.append(
        df.count()) or fit(self, df, params))
    model = train_random_forest(prepared, ForestParams(6, 5, 2, 1))
    assert fitted == [2] and forest_of(model).getNumTrees == 6
    assert evaluate_model(model, prepared.test).count() == 3


def test_other_classes_and_few_rows(spark):
    from pyspark.ml.linalg import Vectors
    three = spark.createDataFrame([(float(k % 3), Vectors.dense([k % 3, k]), 1.0)
                                   for k in range(60)], ["churn", VECTOR, WEIGHT])
    forest = fit_forest(three, ForestParams(9, 5), "churn")
    assert forest.numClasses == 3
    assert forest.transform(three).where("prediction = churn").count() == 60
    one = fit_forest(three.where("churn = 1").limit(1), ForestParams(9, 5), "churn")
    assert one.getNumTrees == 9 and len(checked(spark, one, 0)) == 9
    with pytest.raises(Exception, match="(?i)label|integer"):
        fit_forest(three.withColumn("churn", F.lit(0.5)), ForestParams(3, 2), "churn")
