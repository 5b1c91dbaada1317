"""Exact, reproducible splits without sorting or shuffling the rows.

Rows are ordered by a hash of (seed, key) and then by the key. The order position that ends the
wanted share is found with two counting passes; afterwards a row's side follows from comparing
its own hash and key with that position, so the split is a plain projection.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from keepwatt.session import stage

HASH_BITS = 32
# 2^16 buckets: a counting task sends at most 65,536 rows, and a bucket of 10^11 keys holds
# about 1.5 million of them
BUCKET_BITS = 16


def hash_order(keys: Sequence[str], seed: int = 0) -> Column:
    """First 32 bits of md5('seed:key[:key...]') as BIGINT."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _order_key(keys: Sequence[str], seed: int) -> Column:
    return F.struct(hash_order(keys, seed).alias("h"), *keys)


def _cut_positions(df: DataFrame, keys: Sequence[str], seed: int,
                   ranks: Callable[[Column], Column], label: str | None) -> DataFrame:
    """(label, rank, key): order positions (h, keys) of the rows with the given ranks within
    each label.

    ``ranks`` turns a label's row count into an array of ranks. The result has one row per
    label and rank, and there may be any number of labels. The running totals are over 2^16 hash buckets, and then over the keys of
    the buckets hit, each 1/65536 of all keys. Copies of a key are counted before either total,
    so they cannot pile up in one task.
    """
    # in a struct missing labels are equal, so they are a label like others
    group = F.struct((F.col(label) if label else F.lit(0)).alias("value"))
    rows = df.select(group.alias("label"), _order_key(keys, seed).alias("key")).withColumn(
        "bucket", F.shiftright(F.col("key.h"), HASH_BITS - BUCKET_BITS))
    in_label = Window.partitionBy("label")
    buckets = (rows.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("upto", F.sum("n").over(in_label.orderBy("bucket")))
               .withColumn("total", F.sum("n").over(in_label)))
    inside = F.filter(ranks(F.col("total")),
                      lambda r: (r > F.col("upto") - F.col("n")) & (r <= F.col("upto")))
    # written, so that its size is known where it is joined
    targets = stage(
        buckets.select("label", "bucket", (F.col("upto") - F.col("n")).alias("before"),
                       F.explode(inside).alias("rank")), "split-ranks")

    in_bucket = Window.partitionBy("label", "bucket").orderBy("key")
    spots = targets.select("label", "bucket").distinct()
    ordered = (rows.join(spots, ["label", "bucket"], "left_semi")
               .groupBy("label", "bucket", "key").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("upto", F.sum("n").over(in_bucket)))
    position = F.col("before") + F.col("upto")
    return (ordered.join(targets, ["label", "bucket"])
            .where((F.col("rank") <= position) & (F.col("rank") > position - F.col("n")))
            .select("label", "rank", "key"))


def _bound(df: DataFrame, keys: Sequence[str], cut: Row) -> Column:
    return F.struct(
        F.lit(cut["key"]["h"]).cast("bigint").alias("h"),
        *[F.lit(cut["key"][k]).cast(df.schema[k].dataType).alias(k) for k in keys])


def train_test_split(df: DataFrame, keys: Sequence[str] = ("id",), test_size: float = 0.2,
                     seed: int = 0) -> DataFrame:
    """Add a ``split`` column: 'test' for the first ceil(n * test_size) rows in hash order.

    The size is exact if the keys are unique. Copies of one key always stay on one side, so a
    repeated key at the boundary moves to the test side as a whole.
    """
    def rank(total: Column) -> Column:
        return F.array(F.ceil(total * F.lit(float(test_size))))

    cut = _cut_positions(df, keys, seed, rank, None).first()
    if cut is None:
        return df.withColumn("split", F.lit("train"))
    is_test = _order_key(keys, seed) <= _bound(df, keys, cut)
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str] = ("id",), folds: int = 5,
                     seed: int = 0) -> DataFrame:
    """Add a ``fold`` column, 0 to ``folds`` - 1, with equal shares of every label per fold."""
    def ranks(total: Column) -> Column:
        return F.array(*[F.ceil(total * i / F.lit(float(folds))) for i in range(1, folds)])

    # one row per label: a table like others, joined as its size asks for
    cuts = stage(_cut_positions(df, keys, seed, ranks, label).groupBy("label").agg(
        F.collect_list("key").alias("fold_cuts")), "fold-cuts")
    placed = df.withColumns({"order_key": _order_key(keys, seed),
                             "fold_label": F.struct(F.col(label).alias("value"))})
    beyond = F.filter("fold_cuts", lambda cut: F.col("order_key") > cut)
    return (placed.join(cuts.withColumnRenamed("label", "fold_label"), "fold_label", "left")
            .withColumn("fold", F.coalesce(F.size(beyond), F.lit(0)))
            .select(*[F.col(f"`{c}`") for c in df.columns], "fold"))
