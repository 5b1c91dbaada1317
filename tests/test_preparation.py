import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from keepwatt.operators.hash_split import hash_order, stratified_folds, train_test_split
from keepwatt.operators.preparation import (
    class_weights, dummies, feature_names, fit_scaler, prepare_data, selectable_features,
)


def test_dummies(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "z")],
                               "id int, c string")
    result = dummies(df, ["c"])
    assert result.columns == ["id", "c_a", "c_b", "c_z"]
    assert rows(result, "id") == [(1, 1, 0, 0), (2, 0, 1, 0), (3, 1, 0, 0), (4, 0, 0, 0),
                                  (5, 0, 0, 1)]


def test_dummies_sort_numbers_as_numbers(spark):
    df = spark.createDataFrame([(10, 1), (9, 1)], "c int, d int")
    assert dummies(df, ["c", "d"]).columns == ["c_9", "c_10", "d_1"]


def test_dummies_limit_and_fixed_values(spark):
    df = spark.range(50).withColumnRenamed("id", "c")
    with pytest.raises(ValueError, match="more than 20"):
        dummies(df, ["c"], max_categories=20)
    assert dummies(df, ["c"], categories={"c": [3, 1]}).columns == ["c_3", "c_1"]


@pytest.mark.parametrize("n, size", [(1000, 0.2), (1001, 0.2), (7, 0.5), (1, 0.2), (997, 0.33)])
def test_split_size_is_exact(spark, n, size):
    split = train_test_split(spark.range(n), ["id"], size)
    assert split.where("split = 'test'").count() == math.ceil(n * size)


def test_split_takes_the_first_rows_in_hash_order(spark):
    df = spark.range(500)
    ranked = sorted((r["h"], r["id"]) for r in df.select(
        hash_order(["id"], 3).alias("h"), "id").collect())
    expected = {i for _, i in ranked[:100]}
    split = train_test_split(df, ["id"], 0.2, seed=3)
    assert {r["id"] for r in split.where("split = 'test'").collect()} == expected


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(2000).select("id", (F.col("id") * 7).cast("string").alias("name"))
    first = train_test_split(df, ["name"], 0.2).where("split = 'test'")
    second = train_test_split(df.repartition(13, "id"), ["name"], 0.2).where("split = 'test'")
    assert rows(first, "id") == rows(second, "id")
    other = train_test_split(df, ["name"], 0.2, seed=1).where("split = 'test'")
    assert rows(first, "id") != rows(other, "id")


def test_copies_of_a_key_stay_together(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id"))
                                  .alias("id"), F.col("id").alias("other"))
    split = train_test_split(df, ["id"], 0.2)
    sides = split.groupBy("id").agg(F.count_distinct("split").alias("n"))
    assert sides.where("n > 1").count() == 0
    unique = train_test_split(df, ["id", "other"], 0.2)
    assert unique.where("split = 'test'").count() == 600


def test_splitting_moves_no_rows(spark):
    df = spark.range(100)
    plan = train_test_split(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_empty_table(spark):
    assert train_test_split(spark.range(0), ["id"]).count() == 0


def test_folds_are_stratified(spark):
    df = spark.range(1003).select("id", (F.col("id") % 10 == 0).cast("int").alias("churn"))
    folded = stratified_folds(df, "churn", ["id"], 5)
    counts = {(r["churn"], r["fold"]): r["count"]
              for r in folded.groupBy("churn", "fold").count().collect()}
    for label, total in ((1, 101), (0, 902)):
        sizes = [counts[(label, k)] for k in range(5)]
        assert sum(sizes) == total and max(sizes) - min(sizes) <= 1
    again = stratified_folds(df.repartition(9), "churn", ["id"], 5)
    assert rows(folded, "id") == rows(again, "id")


def test_folds_of_many_labels_and_missing_ones(spark):
    df = spark.range(6000).select("id", F.expr("nullif(id % 3000, 0)").alias("churn"))
    df = df.union(spark.range(6000, 6100).selectExpr("id", "CAST(NULL AS BIGINT)"))
    folded = stratified_folds(df, "churn", ["id"], 5)
    missing = folded.where("churn IS NULL").groupBy("fold").count().collect()
    assert folded.count() == 6100 and folded.columns == ["id", "churn", "fold"]
    assert len(missing) == 5 and {r["count"] for r in missing} <= {20, 21}
    pairs = folded.where("churn IS NOT NULL").groupBy("churn").agg(F.count_distinct("fold").alias("n"))
    assert pairs.where("n <> 2").count() == 0


def test_scaler_uses_population_spread(spark):
    values = [1.0, 2.0, 4.0] + [9.0] * 10
    df = spark.createDataFrame([(v, 5.0, None) for v in values], "x double, c double, e double")
    scaled = fit_scaler(df, ["x", "c", "e"]).transform(df).toPandas()
    np.testing.assert_allclose(scaled.x, (np.array(values) - np.mean(values)) / np.std(values))
    assert (scaled.c == 0).all() and scaled.e.isna().all()
    # a value unseen in a constant column is only centred
    other = fit_scaler(df, ["c"]).transform(spark.createDataFrame([(7.5,)], "c double"))
    assert rows(other) == [(2.5,)]


def test_scaler_fills_missing_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (2.0,), (2.0,)], "x double")
    assert rows(fit_scaler(df, ["x"], fill_missing=0.0).transform(df)) == [
        (-1.0,), (-1.0,), (1.0,), (1.0,)]
    assert rows(fit_scaler(df, ["x"]).transform(df)) == [(None,), (None,), (0.0,), (0.0,)]


def test_prepared_training_rows_are_standardised(spark):
    df = spark.range(400).select("id", F.rand(1).alias("a"), (F.rand(2) * 50).alias("b"),
                                 (F.col("id") % 4 == 0).cast("int").alias("churn"))
    prepared = prepare_data(df)
    assert prepared.features == ["a", "b"]
    assert prepared.test.count() == 80 and prepared.train.count() == 320
    stats = prepared.train.agg(F.avg("a"), F.stddev_pop("a"), F.avg("b"), F.stddev_pop("b"))
    np.testing.assert_allclose(stats.first(), [0, 1, 0, 1], atol=1e-12)
    # fitted on the training rows only
    assert abs(prepared.data.agg(F.avg("b")).first()[0]) > 1e-6


def test_feature_selection(spark):
    df = spark.createDataFrame([(1, 2, 3, 0)], "id int, b int, a int, churn int")
    assert feature_names(df, "churn", ["id", "churn", "churn"]) == ["b", "a"]
    assert feature_names(df, "churn", features=["a"]) == ["a"]
    assert selectable_features(df) == ["a", "b"]
    with pytest.raises(ValueError, match="not available"):
        feature_names(df, "churn", features=["a", "churn"])


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] * 2 + [(0,)] * 6 + [(None,)], "churn int")
    assert rows(class_weights(df), "churn") == [(0, 6, 8 / 12), (1, 2, 2.0)]
