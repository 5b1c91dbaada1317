import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from keepwatt.operators.cleaning import (
    channel_codes, clean_channel_sales, clean_datatypes,
)


def channels(spark, **counts):
    data = [(name if name != "missing" else None, i)
            for name, n in counts.items() for i in range(n)]
    return spark.createDataFrame(data, "channel_sales string, n_row int")


def test_threshold_and_shared_codes(spark):
    df = channels(spark, a=25, b=25, c=21, d=20, missing=30)
    assert rows(channel_codes(df), "channel_sales") == [("a", 25, 0), ("b", 25, 0), ("c", 21, 1)]
    cleaned = clean_channel_sales(df)
    assert cleaned.columns == df.columns
    counts = cleaned.groupBy("channel_sales").count()
    assert rows(counts, "channel_sales") == [(0, 50), (1, 21)]


def test_other_threshold_and_column(spark):
    df = channels(spark, a=3, b=2).withColumnRenamed("channel_sales", "kind")
    assert rows(clean_channel_sales(df, "kind", min_count=2).select("kind").distinct()) == [(0,)]


def test_codes_joined_by_broadcast_and_by_shuffle_give_the_same_rows(spark):
    counts = {f"k{i}": 5 + i for i in range(30)} | {"hot": 400}
    df = channels(spark, **counts)
    small = rows(clean_channel_sales(df, min_count=10), "channel_sales", "n_row")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(clean_channel_sales(df, min_count=10), "channel_sales", "n_row") == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_integers_written_as_floats(spark):
    df = spark.createDataFrame([("3.0",), (" 7 ",), ("-2.9",), ("9007199254740993",)], "n string")
    assert rows(clean_datatypes(df, int_columns=["n"])) == [(3,), (7,), (-2,), (9007199254740993,)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        clean_datatypes(df.limit(0).union(df.selectExpr("'x'")), int_columns=["n"]).collect()


def test_boolean_text(spark):
    df = spark.createDataFrame([("True",), ("T",), (" t",), (None,), ("1",), ("f",)], "b string")
    assert rows(clean_datatypes(df, bool_columns=["b"])) == [(1,), (1,), (0,), (0,), (0,), (0,)]


def test_all_types_in_one_projection(spark):
    df = spark.createDataFrame([("1.5", 2.9, 7, "2015-03-04", "t")],
                               "f string, i double, s int, d string, b string")
    cleaned = clean_datatypes(df, ["f"], ["i"], ["s"], ["d"], ["b"])
    assert [t for _, t in cleaned.dtypes] == ["double", "bigint", "string", "timestamp", "int"]
    assert rows(cleaned) == [(1.5, 2, "7", dt.datetime(2015, 3, 4), 1)]
    assert df.dtypes[0] == ("f", "string")


def test_later_conversion_sees_the_earlier_one(spark):
    df = spark.createDataFrame([("7.9",)], "x string")
    assert rows(clean_datatypes(df, float_columns=["x"], int_columns=["x"])) == [(7,)]


@pytest.mark.parametrize("value, kind", [("abc", "int_columns"), (None, "int_columns"),
                                         ("abc", "float_columns"), ("abc", "date_columns")])
def test_strict_and_lenient(spark, value, kind):
    df = spark.createDataFrame([(value,)], "x string")
    with pytest.raises(Exception):
        clean_datatypes(df, **{kind: ["x"]}).collect()
    assert rows(clean_datatypes(df, **{kind: ["x"]}, strict=False)) == [(None,)]


def test_date_format(spark):
    df = spark.createDataFrame([("04.03.2015",)], "d string")
    cleaned = clean_datatypes(df, date_columns=["d"], date_format="dd.MM.yyyy")
    assert rows(cleaned) == [(dt.datetime(2015, 3, 4),)]


def test_unknown_column(spark):
    with pytest.raises(ValueError, match="unknown column"):
        clean_datatypes(spark.range(1), int_columns=["nope"])


def test_skewed_channel_counts_before_the_shuffle(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
        .alias("channel_sales"))
    assert rows(clean_channel_sales(df).groupBy("channel_sales").count()) == [(0, 334)]
