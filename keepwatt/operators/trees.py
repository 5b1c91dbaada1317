"""The trees of a forest as a table of nodes: minimum split sizes, nested settings, importances.

A stored forest has one row per node. Nodes are numbered from 0 in pre-order: a split comes
before its left part, which comes before its right part. So the nodes below a split are the
ones that follow it, up to some number.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from contextvars import copy_context
from multiprocessing.pool import ThreadPool
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.base import Model
from pyspark.ml.classification import (
    RandomForestClassificationModel, _ProbabilisticClassifierParams, _RandomForestClassifierParams,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector
from pyspark.ml.util import DefaultParamsWriter, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepwatt.operators.descent import Descent, share_scale
from keepwatt.session import new_folder, stage

IS_SPLIT = "leftChild >= 0"
# What a leaf has in place of a split.
LEAF_COLUMNS = (
    "-1.0D AS gain", "-1 AS leftChild", "-1 AS rightChild",
    "named_struct('featureIndex', -1, 'leftCategoriesOrThreshold', "
    "CAST(array() AS array<double>), 'numCategories', -1) AS split")


# Spark's writer holds some 2 KB of the driver's heap for each node of a forest at once.
NODES_AT_ONCE = 150_000
ONE_FOREST = Lock()
TREES_AT_ONCE = 4
WIDE = 1000  # features from which on Spark grows the trees and holds the model
ROW = "row_of_forest"


class StoredForest(Model, _ProbabilisticClassifierParams, _RandomForestClassifierParams):
    """The forest in a folder, as Spark writes it, with the settings, outputs and columns of
    Spark's model. Its nodes are never in the driver: rows are sent down the trees by tasks. So
    it lasts as long as its folder; inside ``staging`` it has to be saved elsewhere to stay."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        self.spark, self.stored_at = spark, path
        about = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        self._resetUid(about["uid"])
        self.numFeatures, self.numClasses = int(about["numFeatures"]), int(about["numClasses"])
        self.getNumTrees = int(about["numTrees"])
        for name, value in about.get("defaultParamMap", {}).items():
            if self.hasParam(name):
                self._setDefault(**{name: value})
        for name, value in about["paramMap"].items():
            if self.hasParam(name):
                self._set(**{name: value})

    @property
    def treeWeights(self) -> list[float]:
        table = self.spark.read.parquet(f"{self.stored_at}/treesMetadata")
        tree, _, weight = table.columns
        return [r[0] for r in table.orderBy(tree).select(weight).collect()]

    @property
    def totalNumNodes(self) -> int:
        return stored_nodes(self.spark, self.stored_at).count()

    @property
    def featureImportances(self) -> SparseVector:
        """In each tree a feature's share of gain times weighted rows, then the same over trees."""
        def of_tree(key, table):
            table = table.sort_by("id")
            gain, at = table.column("gain").to_numpy(), table.column("at").to_numpy()
            sums = np.bincount(at, gain)
            found = np.flatnonzero(sums)
            return pa.table({
                "tree": pa.array(np.full(len(found), key[0].as_py()), pa.int32()),
                "at": pa.array(found, pa.int32()), "share": sums[found] / sums.sum()})

        total = F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b)
        gains = stored_nodes(self.spark, self.stored_at).where(IS_SPLIT).select(
            "treeID", "id", F.col("split.featureIndex").alias("at"),
            (F.col("gain") * total).alias("gain"))
        summed: dict[int, float] = {}
        for r in gains.groupBy("treeID").applyInArrow(
                of_tree, "tree int, at int, share double").orderBy("tree", "at").collect():
            summed[r["at"]] = summed.get(r["at"], 0.0) + r["share"]
        whole = sum(summed.values()) or 1.0
        return SparseVector(self.numFeatures, {k: v / whole for k, v in summed.items()})

    def setLeafCol(self, value: str) -> StoredForest:
        return self._set(leafCol=value)

    def descent(self, rows: DataFrame) -> Descent:
        """``rows`` (row, vector) on their way down the trees."""
        values = vector_to_array(F.col(f"`{self.getFeaturesCol()}`"))
        return Descent(stored_nodes(self.spark, self.stored_at), rows.select(
            "row", values.alias("values")), self.numFeatures, self.getNumTrees, self.numClasses)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """The rows with the columns that Spark's model adds. They are stored with a number, which
        what the trees say of them is joined by."""
        made = [self.getRawPredictionCol(), self.getProbabilityCol(), self.getPredictionCol()]
        if there := {c for c in (*made, self.getLeafCol()) if c and c in dataset.columns}:
            raise ValueError(f"columns are there already: {sorted(there)}")
        kept = stage(dataset.withColumn(ROW, F.monotonically_increasing_id()), "rows")
        descent = self.descent(kept.withColumnRenamed(ROW, "row"))
        scale = float(share_scale(self.getNumTrees))
        votes = [F.col(f"v{k}") for k in range(self.numClasses)]
        said = stage(descent.votes().select(
            F.col("row").alias(ROW), F.array(*[v / scale for v in votes]).alias("raw"),
            (F.array_position(F.array(*votes), F.greatest(F.lit(0), *votes)) - 1).cast(
                "double").alias("said")), "votes")
        total = F.aggregate("raw", F.lit(0.0), lambda a, b: a + b)
        shares = F.transform("raw", lambda v: F.coalesce(F.try_divide(v, total), v))
        columns = [array_to_vector("raw"), array_to_vector(shares), F.col("said")]
        # never broadcast: rows with the same votes take hardly any space in files
        out = kept.join(said.hint("merge"), ROW)
        if self.getLeafCol():
            leaves = descent.leaves().groupBy(F.col("row").alias(ROW)).agg(
                F.array_sort(F.collect_list(F.struct("tree", "leaf"))).alias("found"))
            out = out.join(stage(leaves, "row-leaves").hint("merge"), ROW)
            columns.append(array_to_vector(F.transform(
                "found", lambda x: x.getField("leaf").cast("double"))))
            made.append(self.getLeafCol())
        return out.select(*[F.col(f"`{c}`") for c in dataset.columns], *[
            c.alias(name) for name, c in zip(made, columns, strict=True) if name])

    def write(self) -> MLWriter:
        return _ForestCopy(self)


class _ForestCopy(MLWriter):
    """Writes a stored forest to another folder."""

    def __init__(self, forest: StoredForest):
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:
        copy_forest(self.forest.spark, self.forest.stored_at, path)


def copy_forest(spark: SparkSession, source: str, path: str) -> None:
    """The files of a stored forest written to ``path`` by tasks."""
    if source.rstrip("/") == path.rstrip("/"):
        return
    for part in ("data", "treesMetadata"):
        spark.read.parquet(f"{source}/{part}").write.mode("overwrite").parquet(f"{path}/{part}")
    spark.read.text(f"{source}/metadata").coalesce(1).write.mode("overwrite").text(
        f"{path}/metadata")


def save_forest(forest: StoredForest | RandomForestClassificationModel, spark: SparkSession,
                path: str) -> None:
    """Write the forest, as Spark does and for Spark's reader. A stored forest is copied. One of
    Spark's with many nodes is written tree by tree, so that the driver makes rows of a few trees
    only, not of all of them."""
    if isinstance(forest, StoredForest):
        copy_forest(spark, forest.stored_at, path)
        return
    if forest.totalNumNodes <= NODES_AT_ONCE:
        with ONE_FOREST:
            forest.write().overwrite().save(path)
        return
    parts = new_folder(spark, "trees")

    def save(tree: tuple) -> None:
        tree[1].write().save(f"{parts}/tree-{tree[0]}")

    run = inheritable_thread_target(spark)(lambda job: job[0].run(save, job[1]))
    with ThreadPool(TREES_AT_ONCE) as pool:
        pool.map(run, [(copy_context(), tree) for tree in enumerate(forest.trees)], chunksize=1)
    tree_id = F.regexp_extract("_metadata.file_path", r"/tree-(\d+)/[^/]+/[^/]+$", 1).cast("int")
    nodes = spark.read.parquet(f"{parts}/tree-*/data")
    (nodes.select(tree_id.alias("treeID"), F.struct(*nodes.columns).alias("nodeData"))
     .write.mode("overwrite").parquet(f"{path}/data"))
    weight = F.element_at(F.array(*[F.lit(w) for w in forest.treeWeights]), tree_id + 1)
    (spark.read.text(f"{parts}/tree-*/metadata")
     .select(tree_id.alias("_1"), F.col("value").alias("_2"), weight.alias("_3"))
     .write.mode("overwrite").parquet(f"{path}/treesMetadata"))
    about = json.loads(DefaultParamsWriter._get_metadata_to_save(forest, spark, {
        "numFeatures": forest.numFeatures, "numClasses": forest.numClasses,
        "numTrees": forest.getNumTrees}))
    about["class"] = forest._java_obj.getClass().getName()
    (spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1)
     .write.mode("overwrite").text(f"{path}/metadata"))


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def store_forest(forest: StoredForest | RandomForestClassificationModel, spark: SparkSession) -> str:
    """Write the forest to a new folder, unless it is stored already, and return its folder."""
    if (stored := getattr(forest, "stored_at", None)) and _exists(spark, stored):
        return stored
    path = new_folder(spark, "forest")
    save_forest(forest, spark, path)
    return path


def stored_nodes(spark: SparkSession, path: str) -> DataFrame:
    """One row per node of a stored forest: treeID, id, prediction, impurity, impurityStats
    (weighted rows by class), rawCount (drawn rows), gain, leftChild, rightChild, split."""
    return spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")


def without_small_splits(nodes: DataFrame, min_rows: int) -> DataFrame:
    """The nodes of the trees that would have grown if nodes of fewer than ``min_rows`` rows had
    not been split: those are leaves now, and what was below them is gone.

    This is exact, because a node's split does not depend on what happens below it, and because
    no node has more rows than the one above it. Nodes are never broadcast: numbers of nodes
    take little space in files, but much in the driver.
    """
    splits = nodes.where(IS_SPLIT).where(F.col("rawCount") >= min_rows)
    below = splits.select("treeID", F.explode(F.array("leftChild", "rightChild")).alias("id"))
    kept = nodes.where("id = 0").unionByName(nodes.join(below.hint("merge"), ["treeID", "id"]))
    # a window group is a tree, which a model holds in memory anyway
    in_order = Window.partitionBy("treeID").orderBy("id")
    numbered = kept.withColumn("new", F.row_number().over(in_order) - 1)
    right = numbered.select("treeID", F.col("id").alias("rightChild"), F.col("new").alias("right"))
    still = F.expr(IS_SPLIT) & (F.col("rawCount") >= min_rows)
    both = ["treeID", "new AS id", "prediction", "impurity", "impurityStats", "rawCount"]
    leaves = numbered.where(~still).selectExpr(*both, *LEAF_COLUMNS)
    inner = numbered.where(still).join(right.hint("merge"), ["treeID", "rightChild"]).selectExpr(
        *both, "gain", "new + 1 AS leftChild", "right AS rightChild", "split")
    return inner.unionByName(leaves)


def with_min_split(forest: StoredForest | RandomForestClassificationModel, min_rows: int,
                   spark: SparkSession) -> StoredForest | RandomForestClassificationModel:
    """The forest without splits of nodes that have fewer than ``min_rows`` rows. Its node table
    is stored, edited and loaded again."""
    path = store_forest(forest, spark)
    return forest_with_nodes(path, without_small_splits(stored_nodes(spark, path), min_rows))


def forest_with_nodes(path: str, nodes: DataFrame) -> StoredForest | RandomForestClassificationModel:
    """The forest stored at ``path`` with other nodes."""
    return load_forest(store_with_nodes(path, nodes))


def load_forest(path: str) -> StoredForest | RandomForestClassificationModel:
    """The forest of a folder. Its nodes stay there, but for what only Spark's own model does:
    many features, whose rows it has as sparse vectors, splits by category and thresholds."""
    spark = SparkSession.active()
    forest = StoredForest(spark, path)
    by_category = stored_nodes(spark, path).where("split.numCategories >= 0")
    if forest.numFeatures < WIDE and not forest.isSet("thresholds") and not by_category.take(1):
        return forest
    # where the forest is stored is remembered, which saves making rows of its nodes again
    forest = RandomForestClassificationModel.load(path)
    forest.stored_at = path
    return forest


def reached_leaves(forest: StoredForest | RandomForestClassificationModel,
                   rows: DataFrame) -> DataFrame:
    """(row, tree, leaf): where ``rows`` (row, vector) end, leaves numbered as Spark does."""
    if isinstance(forest, StoredForest):
        return forest.descent(rows).leaves()
    reached = forest.setLeafCol("leaves").transform(rows).select(
        "row", F.posexplode(vector_to_array("leaves")).alias("tree", "leaf"))
    return reached.withColumn("leaf", F.col("leaf").cast("long"))


def store_with_nodes(path: str, nodes: DataFrame) -> str:
    """The folder of the forest stored at ``path`` with other nodes."""
    spark = nodes.sparkSession
    edited = new_folder(spark, "forest")
    columns = spark.read.parquet(f"{path}/data").schema["nodeData"].dataType.names
    nodes.select("treeID", F.struct(*columns).alias("nodeData")).write.parquet(f"{edited}/data")
    spark.read.parquet(f"{path}/treesMetadata").write.parquet(f"{edited}/treesMetadata")
    spark.read.text(f"{path}/metadata").coalesce(1).write.text(f"{edited}/metadata")
    return edited


def with_depth(nodes: DataFrame, max_depth: int) -> DataFrame:
    """``nodes`` (model, treeID, id, ...) with their depth and the rows of the split above.

    Each node knows the one above it; in every round it learns how far the node it knows is
    from one twice as far up, so the rounds are the logarithm of the depth.
    """
    key = ["model", "treeID"]
    above = nodes.where(IS_SPLIT).select(
        *key, F.col("id").alias("above"), F.col("rawCount").alias("rows_above"),
        F.explode(F.array("leftChild", "rightChild")).alias("id"))
    first = stage(nodes.join(above.hint("merge"), [*key, "id"], "left"), "tree-nodes")
    steps = first.select(*key, "id", "above",
                         F.when(F.col("above").isNull(), 0).otherwise(1).alias("depth"))
    for _ in range(max(max_depth - 1, 0).bit_length()):
        further = steps.select(*key, F.col("id").alias("above"), F.col("above").alias("next"),
                               F.col("depth").alias("more"))
        steps = stage(steps.join(further.hint("merge"), [*key, "above"], "left").select(
            *key, "id", F.col("next").alias("above"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "tree-depths")
    return first.join(steps.select(*key, "id", "depth").hint("merge"), [*key, "id"])


def _margin(stats: str = "impurityStats") -> Column:
    """Share of class 1 less that of class 0."""
    one = F.coalesce(F.try_element_at(stats, F.lit(2)), F.lit(0.0))
    total = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    return F.coalesce(F.try_divide(one - F.element_at(stats, 1), total), F.lit(0.0))


def nested_margins(nodes: DataFrame, variants: Sequence[tuple[int, int]],
                   max_depth: int) -> DataFrame:
    """(model, tree, leaf, m0, m1, ...): for each leaf, numbered as ``predictLeaf`` does, the
    margin of class 1 where its rows would end in a tree of each (depth, minimum split size).

    Growing a tree less deep, or with a larger minimum, gives the top of the same tree. Its
    leaves are the nodes that stop while the one above does not. Going through the nodes in
    pre-order, a row's leaf lies below the last of them.
    """
    in_order = Window.partitionBy("model", "treeID").orderBy("id")
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = with_depth(nodes, max_depth).withColumn("margin", _margin())
    is_leaf = ~F.expr(IS_SPLIT)

    def reached(depth: int, rows: int) -> Column:
        stops = is_leaf | (F.col("depth") >= depth) | (F.col("rawCount") < rows)
        above_stops = (F.col("depth") > depth) | F.coalesce(
            F.col("rows_above") < rows, F.lit(False))
        return F.last(F.when(stops & ~above_stops, F.col("margin")), True).over(upto)

    return placed.select(
        "model", F.col("treeID").alias("tree"), is_leaf.alias("is_leaf"),
        (F.sum(is_leaf.cast("int")).over(upto) - 1).alias("leaf"),
        *[reached(*v).alias(f"m{k}") for k, v in enumerate(variants)]
    ).where("is_leaf").drop("is_leaf")


def importances(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, importance) of a stored forest: in each tree a feature's share of the sum of
    gain times weighted rows over all splits, then the mean over the trees, ascending."""
    spark = nodes.sparkSession
    names = spark.createDataFrame(list(enumerate(features)), "at int, feature string")
    rows = F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b)
    gains = nodes.where(IS_SPLIT).groupBy("treeID", F.col("split.featureIndex").alias("at")).agg(
        F.sum(F.col("gain") * rows).alias("gain"))
    of_tree = Window.partitionBy("treeID")
    shares = gains.select("at", F.coalesce(F.try_divide(
        F.col("gain"), F.sum("gain").over(of_tree)), F.lit(0.0)).alias("share"))
    summed = shares.groupBy("at").agg(F.sum("share").alias("share"))
    total = summed.agg(F.sum("share").alias("total")).scalar()
    value = F.coalesce(F.try_divide(F.col("share"), total), F.lit(0.0))
    return names.join(summed, "at", "left").select(
        "feature", F.round(value, 4).alias("importance")).orderBy("importance", "feature")
