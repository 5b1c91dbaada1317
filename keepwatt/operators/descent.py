"""Rows sent down the trees of a stored forest by tasks.

Spark's model holds all its nodes in the driver, which sends them to every task. Here some trees
and some rows meet in a task: the trees packed, a row of binary columns each, the rows as blocks
of bins. The driver holds no nodes and no rows, whatever the size of the forest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwatt.operators.growing import write_blocks
from keepwatt.session import stage

GROUP_ROWS = 1_000_000  # rows that meet trees in one task
GROUP_BYTES = 32 << 20  # bins, or packed trees, that do so, or one larger tree
LEAVES_AT_ONCE = 4_000_000  # leaves reached that a task gives, if each is a row
PAIRS = 1_000_000  # rows times trees that are worth a task of their own
MOST_TASKS = 2000
PACKED = "tree int, feature binary, cut binary, right binary, shares binary"


def split_points(nodes: DataFrame, width: int) -> list[np.ndarray]:
    """The thresholds of each feature, at most one less than its bins."""
    threshold = F.element_at("split.leftCategoriesOrThreshold", 1)
    found = {r["at"]: np.unique(r["found"]) for r in nodes.where("leftChild >= 0").groupBy(
        F.col("split.featureIndex").alias("at")).agg(
            F.collect_set(threshold).alias("found")).collect()}
    return [found.get(k, np.zeros(0)) for k in range(width)]


def share_scale(n_trees: int) -> int:
    """Shares of classes are added up as whole numbers, so that sums are the same in any order."""
    return 1 << 62 - n_trees.bit_length()


def pack_trees(nodes: DataFrame, thresholds: list[np.ndarray], n_trees: int) -> DataFrame:
    """A row for each tree: feature (-1 for a leaf), last bin on the left side and right child
    of its nodes, whose left child comes next, and for its leaves the share of each class."""
    scale = share_scale(n_trees)

    def packed(key, table):
        table = table.sort_by("id")
        feature, threshold = (table.column(c).to_numpy() for c in ("feature", "threshold"))
        leaf, cut = feature < 0, np.zeros(len(feature), np.uint32)
        for k in np.unique(feature[~leaf]):
            cut[feature == k] = np.searchsorted(thresholds[k], threshold[feature == k])
        stats = table.column("stats").combine_chunks().flatten().to_numpy().reshape(leaf.sum(), -1)
        total = stats.sum(1, keepdims=True)
        shares = np.divide(stats, total, out=np.zeros_like(stats), where=total > 0)
        return pa.table({
            "tree": pa.array([key[0].as_py()], pa.int32()),
            "feature": [feature.astype(np.int32).tobytes()], "cut": [cut.tobytes()],
            "right": [table.column("right").to_numpy().astype(np.int32).tobytes()],
            "shares": [np.rint(shares * scale).astype(np.int64).tobytes()]})

    columns = nodes.selectExpr(
        "treeID", "id", "split.featureIndex AS feature", "rightChild AS right",
        "IF(leftChild < 0, 0D, element_at(split.leftCategoriesOrThreshold, 1)) AS threshold",
        "IF(leftChild < 0, impurityStats, CAST(array() AS array<double>)) AS stats")
    return stage(columns.groupBy("treeID").applyInArrow(packed, PACKED), "packed-trees")


def ends(feature: np.ndarray, cut: np.ndarray, right: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The node where each row, a column of ``bins``, ends in a tree."""
    n = bins.shape[1]
    at, going, flat = np.zeros(n, np.int64), np.arange(n), bins.reshape(-1)
    while len(going):
        node = at.take(going)
        split = feature.take(node)
        inner = split >= 0
        if not inner.all():
            going, node, split = going[inner], node[inner], split[inner]
        left = flat.take(split.astype(np.int64) * n + going) <= cut.take(node)
        at[going] = np.where(left, node + 1, right.take(node))
    return at


def groups(n_rows: int, row_bytes: int, n_blocks: int, n_trees: int, tree_bytes: int,
           most_pairs: int | None, cores: int) -> tuple[int, int]:
    """How many groups rows and trees are dealt into: so many that a task can hold one of each,
    and that all cores have work. Rows are copied for every group of trees and the other way
    round, so of two ways to go on the one that copies less is taken."""
    pairs = n_rows * n_trees
    wanted = max(min(2 * cores, pairs // PAIRS), -(-pairs // most_pairs) if most_pairs else 1)
    by_row = max(1, min(n_blocks, max(-(-n_rows // GROUP_ROWS), -(-row_bytes // GROUP_BYTES))))
    by_tree = max(1, min(n_trees, -(-tree_bytes // GROUP_BYTES)))
    while by_row * by_tree < wanted and (by_row < n_blocks or by_tree < n_trees):
        if by_row == n_blocks or by_tree < n_trees and (
                row_bytes * by_tree <= tree_bytes * by_row):
            by_tree = min(n_trees, 2 * by_tree)
        else:
            by_row = min(n_blocks, 2 * by_row)
    return by_row, by_tree


class Descent:
    """Rows (``row``, a number, and ``values``, an array) on their way down the trees of
    ``nodes``, as ``stored_nodes`` has them."""

    def __init__(self, nodes: DataFrame, rows: DataFrame, width: int, n_trees: int, classes: int):
        self.n_trees, self.classes = n_trees, classes
        thresholds = split_points(nodes, width)
        self.trees = pack_trees(nodes, thresholds, n_trees)
        self.bins = np.min_scalar_type(max(map(len, thresholds), default=0))
        self.blocks = write_blocks(rows, thresholds, "row", np.int64, self.bins)

    def _met(self, of_block: Callable[..., pa.Table], schema: str,
             most_pairs: int | None = None) -> DataFrame:
        """What ``of_block`` says of the row numbers of each block and of (tree, its arrays, the
        node where each of these rows ends)."""
        kind = self.bins
        n_blocks, labels, row_bytes = self.blocks.agg(
            F.count(F.lit(1)), F.sum(F.length("labels")), F.sum(F.length("bins"))).first()
        packed = [F.sum(F.length(c)) for c in ("feature", "cut", "right", "shares")]
        by_row, by_tree = groups(
            (labels or 0) // 8, row_bytes or 0, n_blocks, self.n_trees,
            sum(self.trees.agg(*packed).first()), most_pairs,
            self.blocks.sparkSession.sparkContext.defaultParallelism)

        def met(left: pa.Table, right: pa.Table) -> pa.Table:
            trees = [(t["tree"], np.frombuffer(t["feature"], np.int32),
                      np.frombuffer(t["cut"], np.uint32), np.frombuffer(t["right"], np.int32),
                      np.frombuffer(t["shares"], np.int64))
                     for t in left.sort_by("tree").to_pylist()]

            def of_blocks() -> Iterator[pa.Table]:
                for block in right.select(["labels", "bins"]).to_pylist():
                    rows = np.frombuffer(block["labels"], np.int64)
                    bins = np.frombuffer(block["bins"], kind).reshape(-1, len(rows))
                    yield of_block(rows, ((*t, ends(*t[1:4], bins)) for t in trees))

            found = list(of_blocks())
            return pa.concat_tables(found) if found else of_block(np.zeros(0, np.int64), iter(()))

        def dealt(side: DataFrame, own: str, others: str, number, own_groups: int,
                  other_groups: int):
            return side.withColumns({
                own: number % own_groups,
                others: F.explode(F.sequence(F.lit(0), F.lit(other_groups - 1)))}).repartition(
                    min(2 * by_row * by_tree, MOST_TASKS), "trees", "rows").groupBy("trees", "rows")

        of_trees = dealt(self.trees, "trees", "rows", F.col("tree"), by_tree, by_row)
        of_rows = dealt(self.blocks, "rows", "trees", F.col("part") + F.col("block"), by_row, by_tree)
        return of_trees.cogroup(of_rows).applyInArrow(met, schema)

    def votes(self) -> DataFrame:
        """(row, v0, v1, ...): the sums of the classes' shares over all trees, times
        ``share_scale``."""
        classes = self.classes
        names = [f"v{k}" for k in range(classes)]

        def of_block(rows, reached) -> pa.Table:
            sums = np.zeros((len(rows), classes), np.int64)
            for _, feature, _, _, shares, node in reached:
                leaf = np.cumsum(feature < 0) - 1
                sums += shares.reshape(-1, classes).take(leaf.take(node), axis=0)
            return pa.table({"row": rows} | {c: np.ascontiguousarray(sums[:, k])
                                             for k, c in enumerate(names)})

        met = self._met(of_block, ", ".join(f"{c} long" for c in ("row", *names)))
        return met.groupBy("row").agg(*[F.sum(c).alias(c) for c in names])

    def leaves(self) -> DataFrame:
        """(row, tree, leaf): the leaf of each tree that a row reaches, numbered as Spark does."""
        def of_block(rows, reached) -> pa.Table:
            trees, leaves = [], []
            for tree, feature, *_, node in reached:
                trees.append(tree)
                leaves.append((np.cumsum(feature < 0) - 1).take(node))
            return pa.table({
                "row": np.tile(rows, len(trees)),
                "tree": pa.array(np.repeat(np.array(trees, np.int32), len(rows)), pa.int32()),
                "leaf": np.concatenate(leaves) if leaves else np.zeros(0, np.int64)})

        return self._met(of_block, "row long, tree int, leaf long", LEAVES_AT_ONCE)
