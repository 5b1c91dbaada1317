"""Properties of the physical plans that decide whether the jobs hold at scale."""

import pytest

import __spark_entry__ as registered
from keepwatt import roles
from keepwatt.operators.features import price_sensitivity_features

QUERIES = registered.queries()
ML = {name for name in QUERIES if name.startswith(("forest", "tuned", "model"))}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ML - set(registered.LLM_QUERIES)))
def test_no_python_and_no_pair_building(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct",
                 "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_features_read_only_their_columns(spark, small):
    plan = plan_of(roles.feature_role(spark, small))
    assert "l_quantity" in plan
    for unused in ("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "c_name"):
        assert unused not in plan
    assert "IsNotNull(l_orderkey)" in plan


def test_both_sides_are_aggregated_before_the_join(spark, small):
    features = price_sensitivity_features(
        roles.price_role(spark, small), roles.client_role(spark, small), roles.AS_OF)
    optimized = features._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(optimized) if "Join Inner" in line)
    assert not any("Aggregate" in line for line in optimized[:join])
    assert sum("Aggregate" in line for line in optimized[join:]) >= 4


def test_shuffle_partitions_grow_with_the_tables(spark, small, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        registered.sized(spark, small)
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
        monkeypatch.setattr(registered, "SHUFFLE_PARTITION_BYTES", 1000)
        registered.sized(spark, small)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) >= int(before)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def scans_run(df) -> int:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("FileScan")


def test_profiles_read_the_rows_twice(spark, small):
    """Once for the range or bandwidth, once for the counts, for any number of columns."""
    from keepwatt.operators.density import churn_kde
    from keepwatt.operators.profiling import churn_histogram, column_ranges
    from keepwatt.schemas import NUMERIC_FEATURES
    from keepwatt.session import stage
    df = stage(roles.feature_role(spark, small), "features")
    assert scans_run(churn_histogram(df)) == 2
    assert scans_run(churn_kde(df, {c: None for c in NUMERIC_FEATURES})) == 2
    assert scans_run(column_ranges(df)) == 1


def test_channel_codes_read_the_rows_once(spark, medium):
    from keepwatt.operators.cleaning import channel_codes
    assert scans_run(channel_codes(roles.channel_role(spark, medium))) == 1


def test_hot_orders_are_split_by_the_join(spark, tmp_path):
    """A third of the lines belongs to one order; the join has to cut that partition up."""
    from pyspark.sql import functions as F
    n = 60_000
    lines = spark.range(n, numPartitions=12).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 9000).alias("l_orderkey"),
        (F.col("id") % 50 + 1.0).alias("l_quantity"),
        (F.rand(1) * 1000 + 1000).alias("l_extendedprice"),
        F.rand(2).alias("l_discount"), F.rand(3).alias("l_tax"),
        F.timestamp_seconds(F.col("id") * 3000 + 800_000_000).alias("l_shipdate"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(9000).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 700).alias("o_custkey"),
    ).write.parquet(f"{tmp_path}/orders.parquet")
    expected = sorted(map(tuple, roles.price_role(spark, str(tmp_path)).collect()))

    small = {"spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
             "spark.sql.shuffle.partitions": "16"}
    before = {key: spark.conf.get(key, None) for key in small}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        result = roles.price_role(spark, str(tmp_path))
        found = sorted(map(tuple, result.collect()))
        assert "SortMergeJoin(skew=true)" in plan_of(result)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert found == expected


@pytest.mark.parametrize("collation", [None, "UTF8_LCASE"])
def test_hot_clients_are_split_by_the_feature_join(spark, small, tmp_path, collation):
    """A third of the client rows has one id; the join has to cut that partition up."""
    from pyspark.sql import functions as F
    prices = roles.price_role(spark, small).withColumn("id", F.concat(F.lit("id"), "id"))
    clients = roles.client_role(spark, small).limit(1).drop("id", "channel_sales").crossJoin(
        spark.range(60_000, numPartitions=12).select(
            F.concat(F.lit("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 150)
                     ).alias("id"), F.concat(F.lit("channel"), "id").alias("channel_sales")))
    # values that do not shrink when shuffled
    clients = clients.withColumns({c: F.rand(k) * 1000 for k, c in enumerate(
        ["cons_12m", "cons_last_month", "imp_cons", "net_margin"])})
    clients.write.parquet(f"{tmp_path}/clients")
    clients = spark.read.parquet(f"{tmp_path}/clients")

    def features():
        return price_sensitivity_features(prices, clients, roles.AS_OF, collation)

    expected = sorted(map(tuple, features().collect()))
    tight = {"spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
             "spark.sql.shuffle.partitions": "16"}
    before = {key: spark.conf.get(key, None) for key in tight}
    try:
        for key, value in tight.items():
            spark.conf.set(key, value)
        result = features()
        found = sorted(map(tuple, result.collect()))
        assert "SortMergeJoin(skew=true)" in plan_of(result)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert found == expected and len(found) == 60_000
