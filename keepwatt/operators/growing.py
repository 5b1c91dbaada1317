"""Random forests whose cost follows the rows, not nodes times bins.

Spark's forest adds up one dense array of statistics for each node in every task, whatever few
rows the node has. Here that is done only for nodes with more rows than a task should hold. The
rows of each smaller node are shuffled to one task, which grows the part of the tree below.

What is grown is what Spark grows: Poisson(1) draws, up to ``max_bins`` bins by weighted
quantiles of a sample, the square root of the features for each node, Gini impurity of weighted
rows, minimum leaf sizes in drawn rows, leaves of one prediction under one split merged. The
result is stored in Spark's layout and loaded as Spark's model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwatt.session import stage

GROUP_ROWS, GROUP_BYTES = 1_000_000, 32 << 20  # most of a node that one task grows further
HISTOGRAM_BYTES = 64 << 20  # statistics of larger nodes that a task holds at once
BLOCK_ROWS = 1 << 16
LEAST_GAIN = 1e-12  # less is rounding
BLOCKS = "part int, block int, labels binary, bins binary"
PIECES = "node int, labels binary, drawn binary, bins binary"
HISTOGRAMS = "node int, cells binary"
SPLITS = "node int, gain double, feature int, cut int, below array<long>, total array<long>"
GROWN = ("least int, node int, id int, size int, prediction double, impurity double, "
         "impurityStats array<double>, rawCount long, gain double, leftChild int, rightChild int, "
         "featureIndex int, threshold double")


@dataclass(frozen=True)
class Growth:
    """What all tasks have to know."""

    n_trees: int
    max_depth: int
    least: int
    subset: int
    bins: int
    seed: int
    weights: tuple[float, ...]
    thresholds: list[np.ndarray]


@dataclass
class Top:
    """The nodes that were split over all rows, and their children. Node k < n_trees is the root
    of tree k; the children of a node are ``left`` and the one after it."""

    tree: list[int]
    depth: list[int]
    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    counts: list[np.ndarray | None] = field(default_factory=list)

    def add(self, tree: int, depth: int, counts: np.ndarray | None) -> int:
        self.tree.append(tree)
        self.depth.append(depth)
        self.fill(counts)
        return len(self.tree) - 1

    def fill(self, counts: np.ndarray | None) -> None:
        self.feature.append(-1)
        self.cut.append(0)
        self.left.append(-1)
        self.gain.append(-1.0)
        self.counts.append(counts)

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.cut), np.array(self.left)


def _thresholds_of(values: np.ndarray, weights: np.ndarray, bins: int) -> list[float]:
    """Midpoints between distinct values, all of them or about evenly spaced by weight."""
    distinct, place = np.unique(values, return_inverse=True)
    middles = (distinct[:-1] + distinct[1:]) / 2
    if len(distinct) <= bins:
        return middles.tolist()
    upto = np.cumsum(np.bincount(place, weights))
    stride, found = upto[-1] / bins, []
    target = stride
    for k in range(1, len(distinct)):
        if abs(upto[k - 1] - target) < abs(upto[k] - target):
            found.append(float(middles[k - 1]))
            target += stride
    return found[:bins - 1]


def find_thresholds(rows: DataFrame, n_rows: int, width: int, bins: int,
                    seed: int) -> list[np.ndarray]:
    """Split points of each feature, from as many sampled rows as Spark's forest takes."""
    wanted = max(bins * bins, 10_000)
    sample = rows if n_rows <= wanted else rows.sample(wanted / n_rows, seed)

    def of_feature(key, table):
        found = _thresholds_of(table.column("value").to_numpy(), table.column("weight").to_numpy(),
                               bins)
        return pa.table({"at": [key[0].as_py()], "found": [found]}, schema=pa.schema(
            [("at", pa.int32()), ("found", pa.list_(pa.float64()))]))

    long = sample.select("weight", F.posexplode("values").alias("at", "value"))
    found = {r["at"]: np.array(r["found"], float) for r in long.groupBy("at").applyInArrow(
        of_feature, "at int, found array<double>").collect()}
    return [found.get(k, np.zeros(0)) for k in range(width)]


def write_blocks(rows: DataFrame, thresholds: list[np.ndarray], label: str = "label",
                 label_type: type = np.uint8, bin_type: type = np.uint8) -> DataFrame:
    """Rows as blocks of labels (or numbers) and bins, feature by feature."""
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, labels, bins = TaskContext.get().partitionId(), 0, 0, [], []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()),
                "labels": [np.concatenate(labels).tobytes()],
                "bins": [np.concatenate(bins, axis=1).tobytes()]})

        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("values").flatten().to_numpy().reshape(
                batch.num_rows, len(thresholds))
            labels.append(batch.column(label).to_numpy().astype(label_type))
            bins.append(np.stack([np.searchsorted(t, values[:, k]).astype(bin_type)
                                  for k, t in enumerate(thresholds)]))
            held += batch.num_rows
            if held >= BLOCK_ROWS:
                yield made()
                block, held, labels, bins = block + 1, 0, [], []
        if held:
            yield made()

    return stage(rows.select(label, "values").mapInArrow(of_batches, BLOCKS), "binned")


def _drawn_rows(batches: Iterator[pa.RecordBatch], growth: Growth, top: tuple,
                wanted: np.ndarray, tree_of: np.ndarray):
    """(labels, bins, how often each row is drawn, node, its drawn rows), for every block and
    wanted node. Trees without such nodes are left out. The draws depend on seed, block and tree
    only, so every pass over the blocks has the same."""
    trees = np.unique(tree_of[wanted]).tolist()
    for batch in batches:
        for row in batch.to_pylist():
            labels = np.frombuffer(row["labels"], np.uint8)
            bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, len(labels))
            for tree in trees:
                draw = np.random.default_rng([growth.seed, row["part"], row["block"], tree])
                drawn = np.minimum(draw.poisson(1.0, len(labels)), 255).astype(np.uint8)
                for node, rows in _walk(top, tree, bins, np.flatnonzero(drawn)):
                    if wanted[node]:
                        yield labels, bins, drawn, node, rows


def _walk(top: tuple, tree: int, bins: np.ndarray, rows: np.ndarray):
    """(node, its rows) where the rows end. They go down together, a node at a time."""
    feature, cut, left = top
    going = [(tree, rows)]
    while going:
        node, rows = going.pop()
        if not len(rows):
            continue
        if feature[node] < 0:
            yield node, rows
            continue
        right = bins[feature[node]].take(rows) > cut[node]
        going += [(left[node], rows[~right]), (left[node] + 1, rows[right])]


def _purity(counts: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    weighted = [c * w for c, w in zip(counts, weights, strict=True)]
    return sum(x * x for x in weighted) / sum(weighted)


def gains(below: np.ndarray, total: np.ndarray, growth: Growth) -> np.ndarray:
    """Loss of Gini impurity by splits with ``below`` (class, ...) of the ``total`` drawn rows on
    the left side, -1 where a side is too small."""
    above, weights = total - below, growth.weights
    whole = sum(c * w for c, w in zip(total, weights, strict=True))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (_purity(below, weights) + _purity(above, weights) - _purity(total, weights)) / whole
    valid = (below.sum(0) >= growth.least) & (above.sum(0) >= growth.least)
    return np.where(valid, gain, -1.0)


def _dense(cells: np.ndarray, total: np.ndarray, growth: Growth):
    """Best gain, cut and rows below it of each node from its (class, node, bin) counts."""
    upto = cells.cumsum(2)
    gain = gains(upto, total[:, :, None], growth)
    cut, nodes = gain.argmax(1), np.arange(gain.shape[0])
    return gain[nodes, cut], cut, upto[:, nodes, cut]


def _sorted(keys: np.ndarray, class_bits: int, total: np.ndarray, growth: Growth):
    """The same from sorted keys of node, bin, class and draws, for many nodes of few rows."""
    keys.sort()
    drawn, label = keys & 255, keys >> 8 & (1 << class_bits) - 1
    cell = keys >> 8 + class_bits
    ends = np.flatnonzero(np.append(cell[1:] != cell[:-1], True))
    node, cut = np.divmod(cell[ends], growth.bins)
    before = total.cumsum(1) - total
    upto = np.stack([np.cumsum(drawn * (label == k))[ends] for k in range(len(total))])
    upto = upto - before[:, node]
    gain = gains(upto, total[:, node], growth)
    best = np.maximum.reduceat(gain, np.flatnonzero(np.append(True, node[1:] != node[:-1])))
    hits = np.flatnonzero(gain == best[node])[::-1]
    first = np.empty(len(best), np.int64)
    first[node[hits]] = hits
    return best, cut[first], upto[:, first]


def _best_splits(bins: np.ndarray, rows: np.ndarray, at: np.ndarray, labels: np.ndarray,
                 drawn: np.ndarray, total: np.ndarray, growth: Growth, draw):
    """Best split of each node among its share of the features."""
    classes, nodes = total.shape
    features = draw.random((nodes, len(bins))).argpartition(growth.subset - 1, axis=1)
    best, feature = np.full(nodes, -1.0), np.zeros(nodes, np.int64)
    cut, below = np.zeros(nodes, np.int64), np.zeros_like(total)
    flat, class_bits = bins.reshape(-1), max(classes - 1, 1).bit_length()
    few = classes * nodes * growth.bins <= 4 * len(rows)
    base, starts = at * growth.bins, features * bins.shape[1]
    if few:
        base += labels.astype(np.int64) * (nodes * growth.bins)
        times = drawn.astype(float)
    else:
        base = (base << 8 + class_bits) | (labels.astype(np.int64) << 8) | drawn
    for slot in range(growth.subset):
        tried = features[:, slot]
        place = starts[:, slot].take(at)
        place += rows
        value = flat.take(place)
        if few:
            cells = np.bincount(base + value, times, classes * nodes * growth.bins)
            found = _dense(cells.reshape(classes, nodes, -1), total, growth)
        else:
            found = _sorted(base + (value.astype(np.int64) << 8 + class_bits), class_bits, total,
                            growth)
        better = found[0] > best
        best[better], cut[better] = found[0][better], found[1][better]
        feature[better], below[:, better] = tried[better], found[2][:, better]
    return best, feature, cut, below


def _kept(nodes: np.ndarray, rows: np.ndarray, at: np.ndarray, *others: np.ndarray):
    """The rows of some nodes, which are numbered anew, and what belongs to the rows."""
    if nodes.all():
        return rows, at, *others
    kept = np.flatnonzero(nodes.take(at))
    return (rows.take(kept), (nodes.cumsum() - 1).take(at.take(kept)),
            *(some.take(kept) for some in others))


def grow(bins: np.ndarray, labels: np.ndarray, drawn: np.ndarray, depth: int, growth: Growth,
         draw) -> dict[str, np.ndarray]:
    """The tree below a node of ``depth`` as columns, numbered in pre-order from 0."""
    rows, at = np.arange(len(labels)), np.zeros(len(labels), np.int64)
    counts = np.bincount(labels, drawn, len(growth.weights)).astype(np.int64)[:, None]
    flat, levels = bins.reshape(-1), []
    while True:
        nodes = counts.shape[1]
        level = {"counts": counts, "feature": np.full(nodes, -1), "cut": np.zeros(nodes, np.int64),
                 "gain": np.full(nodes, -1.0), "left": np.full(nodes, -1)}
        levels.append(level)
        going = ((counts > 0).sum(0) > 1) & (counts.sum(0) >= 2 * growth.least)
        if depth + len(levels) > growth.max_depth or not going.any():
            break
        rows, at, labels, drawn = _kept(going, rows, at, labels, drawn)
        total = counts[:, going]
        gain, feature, cut, below = _best_splits(bins, rows, at, labels, drawn, total, growth, draw)
        good = gain > LEAST_GAIN
        if not good.any():
            break
        ids = np.flatnonzero(going)[good]
        level["feature"][ids], level["cut"][ids] = feature[good], cut[good]
        level["gain"][ids], level["left"][ids] = gain[good], 2 * np.arange(len(ids))
        rows, at, labels, drawn = _kept(good, rows, at, labels, drawn)
        place = (feature[good] * bins.shape[1]).take(at)
        place += rows
        at = 2 * at + (flat.take(place) > cut[good].astype(np.uint8).take(at))
        counts = np.empty((len(counts), 2 * len(ids)), np.int64)
        counts[:, 0::2], counts[:, 1::2] = below[:, good], (total - below)[:, good]
    return _numbered(levels, growth)


def _numbered(levels: list[dict], growth: Growth) -> dict[str, np.ndarray]:
    weights = np.array(growth.weights)[:, None]
    for level, under in zip(levels[::-1], [None, *levels[:0:-1]], strict=True):
        level["prediction"] = (level["counts"] * weights).argmax(0)
        level["size"] = np.ones(len(level["feature"]), np.int64)
        split = np.flatnonzero(level["feature"] >= 0)
        if not len(split):
            continue
        left = level["left"][split]
        alike = ((under["size"][left] == 1) & (under["size"][left + 1] == 1)
                 & (under["prediction"][left] == under["prediction"][left + 1]))
        level["feature"][split[alike]] = -1
        level["size"][split] += np.where(alike, 0, under["size"][left] + under["size"][left + 1])
    levels[0]["id"] = np.zeros(1, np.int64)
    parts = []
    for depth, level in enumerate(levels):
        split = (level["feature"] >= 0) & (level["id"] >= 0)
        level["first"] = np.where(split, level["id"] + 1, -1)
        level["second"] = np.full(len(split), -1)
        if depth + 1 < len(levels):
            under, left = levels[depth + 1], level["left"][split]
            under["id"] = np.full(len(under["size"]), -1)
            level["second"][split] = level["first"][split] + under["size"][left]
            under["id"][left], under["id"][left + 1] = level["first"][split], level["second"][split]
        kept = level["id"] >= 0
        parts.append({k: level[k][..., kept] for k in (
            "id", "size", "prediction", "counts", "feature", "cut", "gain", "first", "second")})
    return {k: np.concatenate([p[k] for p in parts], axis=-1) for k in parts[0]}


def _stats(counts: np.ndarray, growth: Growth) -> tuple[list[float], float]:
    weighted = [float(c) * w for c, w in zip(counts, growth.weights, strict=True)]
    whole = sum(weighted)
    return weighted, 1 - sum((x / whole) ** 2 for x in weighted) if whole else 0.0


def _table(node: int, grown: dict[str, np.ndarray], growth: Growth) -> pa.Table:
    stats = grown["counts"] * np.array(growth.weights)[:, None]
    split = grown["feature"] >= 0
    starts = np.cumsum([0, *(len(t) for t in growth.thresholds)])
    flat = np.append(np.concatenate(growth.thresholds), 0.0)
    at = np.where(split, starts[grown["feature"]] + grown["cut"], 0)
    n, wide = len(split), len(stats)
    return pa.table({
        "least": pa.array(np.full(n, growth.least, np.int32)),
        "node": pa.array(np.full(n, node, np.int32)), "id": pa.array(grown["id"], pa.int32()),
        "size": pa.array(grown["size"], pa.int32()),
        "prediction": pa.array(grown["prediction"].astype(float)),
        "impurity": pa.array(1 - ((stats / stats.sum(0)) ** 2).sum(0)),
        "impurityStats": pa.ListArray.from_arrays(
            pa.array(np.arange(0, (n + 1) * wide, wide), pa.int32()),
            pa.array(np.ascontiguousarray(stats.T).reshape(-1))),
        "rawCount": pa.array(grown["counts"].sum(0)),
        "gain": pa.array(np.where(split, grown["gain"], -1.0)),
        "leftChild": pa.array(grown["first"], pa.int32()),
        "rightChild": pa.array(grown["second"], pa.int32()),
        "featureIndex": pa.array(np.where(split, grown["feature"], -1), pa.int32()),
        "threshold": pa.array(flat[at])})


def _split_large(blocks: DataFrame, top: Top, nodes: list[int], growth: Growth) -> dict:
    """Best splits of ``nodes`` over all their rows, wherever these are."""
    width, classes, paths = len(growth.thresholds), len(growth.weights), top.paths()
    tried = np.stack([np.random.default_rng([growth.seed, k, 1]).permutation(width)[
        :growth.subset] for k in nodes])
    place = np.full(len(top.tree), -1)
    place[nodes] = np.arange(len(nodes))
    shape = (len(nodes), growth.subset, classes, growth.bins)
    tree_of = np.array(top.tree)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(shape, np.int64).reshape(-1)
        for labels, bins, drawn, node, rows in _drawn_rows(
                batches, growth, paths, place >= 0, tree_of):
            within = labels.take(rows).astype(np.int64) * growth.bins
            times, view = drawn.take(rows).astype(float), cells.reshape(shape)[place[node]]
            for slot, feature in enumerate(tried[place[node]]):
                some = np.bincount(within + bins[feature].take(rows), times, classes * growth.bins)
                view[slot] += some.astype(np.int64).reshape(classes, growth.bins)
        for k, one in zip(nodes, cells.reshape(len(nodes), -1), strict=True):
            if one.any():
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array([k], pa.int32()), "cells": [one.tobytes()]})

    def chosen(key, table):
        node = key[0].as_py()
        cells = sum(np.frombuffer(c.as_py(), np.int64) for c in table.column("cells"))
        cells = cells.reshape(shape[1:]).transpose(1, 0, 2)
        total = cells.sum(2)
        gain, cut, below = _dense(cells, total, growth)
        slot = int(gain.argmax())
        return pa.table({
            "node": pa.array([node], pa.int32()), "gain": [float(gain[slot])],
            "feature": pa.array([int(tried[place[node], slot])], pa.int32()),
            "cut": pa.array([int(cut[slot])], pa.int32()),
            "below": [below[:, slot].tolist()], "total": [total[:, slot].tolist()]})

    return {r["node"]: r for r in blocks.mapInArrow(added, HISTOGRAMS).groupBy(
        "node").applyInArrow(chosen, SPLITS).collect()}


def _grow_top(blocks: DataFrame, n_rows: int, growth: Growth) -> tuple[Top, list[int]]:
    """Split nodes of too many rows for a task, level by level, over all trees at once. Gives
    them and the nodes to go on with in tasks. The driver holds a few nodes of each tree."""
    top = Top(list(range(growth.n_trees)), [0] * growth.n_trees)
    for _ in range(growth.n_trees):
        top.fill(None)
    most = min(GROUP_ROWS, GROUP_BYTES // len(growth.thresholds))
    roots = list(range(growth.n_trees))
    large, small = (roots, []) if n_rows > most else ([], roots)
    of_node = 8 * growth.subset * len(growth.weights) * growth.bins
    at_once = max(1, HISTOGRAM_BYTES // of_node)
    while large:
        found, further = {}, []
        for k in range(0, len(large), at_once):
            found |= _split_large(blocks, top, large[k:k + at_once], growth)
        for node in large:
            best = found[node]
            top.counts[node] = total = np.array(best["total"])
            if top.depth[node] >= growth.max_depth or best["gain"] <= LEAST_GAIN:
                continue
            top.feature[node], top.cut[node] = best["feature"], best["cut"]
            top.gain[node], top.left[node] = best["gain"], len(top.tree)
            below = np.array(best["below"])
            for counts in (below, total - below):
                child = top.add(top.tree[node], top.depth[node] + 1, counts)
                if top.depth[child] < growth.max_depth and (counts > 0).sum() > 1:
                    (further if counts.sum() > most else small).append(child)
        large = sorted(further, key=top.tree.__getitem__)
    return top, small


def _grow_small(blocks: DataFrame, top: Top, nodes: list[int],
                growths: Sequence[Growth]) -> DataFrame:
    """The trees below ``nodes``; the rows of each are gathered in one task, once for all
    ``growths``, which differ in the least size of a leaf."""
    growth = growths[0]
    paths, depth = top.paths(), np.array(top.depth)
    wanted, tree_of = np.zeros(len(top.tree), bool), np.array(top.tree)
    wanted[nodes] = True

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for labels, bins, drawn, node, rows in _drawn_rows(batches, growth, paths, wanted, tree_of):
            yield pa.RecordBatch.from_pydict({
                "node": pa.array([node], pa.int32()), "labels": [labels.take(rows).tobytes()],
                "drawn": [drawn.take(rows).tobytes()],
                "bins": [bins.take(rows, axis=1).tobytes()]})

    def below(key, table):
        node = key[0].as_py()
        labels, drawn = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8)
                         for c in ("labels", "drawn"))
        bins = np.concatenate([np.frombuffer(b, np.uint8).reshape(len(growth.thresholds), -1)
                               for b in table.column("bins").to_pylist()], axis=1)
        return pa.concat_tables([_table(node, grow(
            bins, labels, drawn, int(depth[node]), each,
            np.random.default_rng([each.seed, node, 2])), each) for each in growths])

    parts = min(2 * len(nodes), 1000)
    pieces = blocks.mapInArrow(dealt, PIECES).repartition(parts, "node")
    return stage(pieces.groupBy("node").applyInArrow(below, GROWN), "grown")


def _joined(spark: SparkSession, top: Top, small: list[int], grown: DataFrame,
            growth: Growth) -> DataFrame:
    """One table of nodes, numbered in pre-order by tree, in the columns of a stored forest."""
    ends = {r["node"]: r for r in grown.where("id = 0").select(
        "node", "size", "prediction").collect()}
    n = len(top.tree)
    size, leaf, offset = [1] * n, [None] * n, {}
    for k in range(n - 1, -1, -1):  # children come after their parents
        if top.feature[k] >= 0:
            left = top.left[k]
            if leaf[left] is not None and leaf[left] == leaf[left + 1]:
                top.feature[k], leaf[k] = -1, leaf[left]
            else:
                size[k] += size[left] + size[left + 1]
        elif k in ends:
            size[k] = ends[k]["size"]
            leaf[k] = ends[k]["prediction"] if size[k] == 1 else None
        else:  # a leaf of the top; without counts, no row was drawn for the tree
            counts = np.zeros(len(growth.weights)) if top.counts[k] is None else top.counts[k]
            leaf[k] = float(np.argmax(counts * np.array(growth.weights)))
    own, ids = [], dict.fromkeys(range(growth.n_trees), 0)
    for k in range(n):
        if k not in ids:  # merged into a leaf above
            continue
        if k in ends:
            offset[k] = ids[k]
            continue
        counts = np.zeros(len(growth.weights)) if top.counts[k] is None else top.counts[k]
        stats, impurity = _stats(counts, growth)
        split, left, right = (-1, [], -1), -1, -1
        if top.feature[k] >= 0:
            left = ids[top.left[k]] = ids[k] + 1
            right = ids[top.left[k] + 1] = left + size[top.left[k]]
            split = (top.feature[k], [float(growth.thresholds[top.feature[k]][top.cut[k]])], -1)
        own.append((top.tree[k], ids[k], float(np.argmax(stats)), float(impurity), stats,
                    int(counts.sum()), float(top.gain[k]) if left >= 0 else -1.0, left, right,
                    split))
    places = spark.createDataFrame([(k, top.tree[k], v) for k, v in offset.items()],
                                   "node int, treeID int, before int")
    none = "CAST(array() AS array<double>)"
    nodes = grown.join(F.broadcast(places), "node").selectExpr(
        "treeID", "id + before AS id", "prediction", "impurity", "impurityStats", "rawCount",
        "gain", "IF(leftChild < 0, -1, leftChild + before) AS leftChild",
        "IF(rightChild < 0, -1, rightChild + before) AS rightChild",
        "named_struct('featureIndex', featureIndex, 'leftCategoriesOrThreshold', "
        f"IF(featureIndex < 0, {none}, array(threshold)), 'numCategories', -1) AS split")
    return nodes.unionByName(spark.createDataFrame(own, nodes.schema)) if own else nodes


def grow_forests(vectors: DataFrame, vector: str, label: str, weight: str,
                 class_weights: list[float], n_rows: int, width: int, n_trees: int, max_depth: int,
                 min_leaves: Sequence[int], max_bins: int, seed: int) -> list[DataFrame]:
    """The nodes of a forest for each minimum leaf size, as ``stored_nodes`` has them, on
    ``n_rows`` rows of ``width`` features, labels from 0 on and a weight for each class.

    The forests have the same bins and draws. As long as no node is too large for a task, the
    rows of a tree are gathered once for all of them.
    """
    rows = vectors.select(F.col(label).cast("int").alias("label"), F.col(weight).alias("weight"),
                          vector_to_array(vector).alias("values"))
    thresholds = find_thresholds(rows, n_rows, width, max_bins, seed)
    first = Growth(n_trees, max_depth, 1, math.ceil(math.sqrt(width)), max_bins,
                   seed % (1 << 63), tuple(class_weights), thresholds)
    leasts = [max(least, 1) for least in min_leaves]
    growths = {least: replace(first, least=least) for least in leasts}
    blocks = write_blocks(rows, thresholds)
    tops = {least: _grow_top(blocks, n_rows, growth) for least, growth in growths.items()}
    if all(len(top.tree) == n_trees and len(small) == n_trees for top, small in tops.values()):
        once = _grow_small(blocks, *tops[leasts[0]], list(growths.values()))
        grown = {least: once.where(F.col("least") == least) for least in growths}
    else:
        grown = {least: _grow_small(blocks, *tops[least], [growth])
                 for least, growth in growths.items()}
    return [_joined(vectors.sparkSession, *tops[least], grown[least], growths[least])
            for least in leasts]
