import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from keepwatt import roles
from keepwatt.operators.features import price_changes, price_statistics
from keepwatt.plans.clean_tables import build_client_table, build_price_table
from keepwatt.plans.feature_table import (
    build_feature_table, price_change_table, register_views,
)
from keepwatt.schemas import CLIENT_SCHEMA, FEATURE_COLUMNS, PRICE_SCHEMA
from keepwatt.session import configure, shared_dir, stage
from keepwatt.sources.catalog import (
    largest_share, read_table, register_tables, save_clustered, save_plain, use_database,
)
from keepwatt.sources.csv_tables import load_table, preview, schema_report, write_csv


def write(path, text):
    path.write_text(text)
    return str(path)


def test_columns_are_matched_by_name(spark, tmp_path):
    path = write(tmp_path / "t.csv", "b,a,c\n1.5,7,x\n")
    schema = T.StructType().add("a", "integer").add("b", "double")
    df = load_table(spark, path, schema)
    assert df.dtypes == [("b", "double"), ("a", "int"), ("c", "string")]
    assert rows(df) == [(1.5, 7, "x")]


@pytest.mark.parametrize("text", ["", "NaN", "NULL", "n/a", "<NA>", "nan"])
def test_missing_texts(spark, tmp_path, text):
    df = load_table(spark, write(tmp_path / "t.csv", f"a,b\n{text},{text}\n"),
                    T.StructType().add("a", "double"))
    assert rows(df) == [(None, None)]


def test_text_that_is_not_missing(spark, tmp_path):
    df = load_table(spark, write(tmp_path / "t.csv", "a\nMISSING\nnone\n"))
    assert rows(df) == [("MISSING",), ("none",)]


def test_bad_values_and_absent_columns_are_errors(spark, tmp_path):
    path = write(tmp_path / "t.csv", "a\nabc\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load_table(spark, path, T.StructType().add("a", "integer")).collect()
    with pytest.raises(ValueError, match="columns not in"):
        load_table(spark, path, T.StructType().add("z", "integer"))


def test_quotes_survive(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", then\\go', 1.25, dt.datetime(2015, 1, 2, 3, 4, 5, 6))],
                               "s string, x double, t timestamp")
    write_csv(df, str(tmp_path / "out"))
    assert rows(load_table(spark, str(tmp_path / "out"), df.schema)) == rows(df)


def test_line_breaks_in_quotes(spark, tmp_path):
    path = write(tmp_path / "t.csv", 'a,b\n"x\ny",1\n')
    assert rows(load_table(spark, path, multi_line=True)) == [("x\ny", "1")]


def test_report_and_preview(spark):
    df = spark.createDataFrame([(2, None), (1, "x"), (3, None)], "a int, b string")
    assert rows(schema_report(df), "position") == [(0, "a", "int", 3, 3),
                                                   (1, "b", "string", 3, 1)]
    assert rows(preview(df, 2, ["a"])) == [(1, "x"), (2, None)]


def test_stage_writes_to_the_shared_folder(spark):
    staged = stage(spark.range(10), "numbers")
    assert shared_dir(spark) in staged.inputFiles()[0]
    assert staged.count() == 10


def test_clean_and_feature_plans(spark, small, tmp_path):
    client = roles.client_role(spark, small).select(*CLIENT_SCHEMA.fieldNames())
    price = roles.price_role(spark, small).select(*PRICE_SCHEMA.fieldNames())
    write_csv(client, str(tmp_path / "raw_client"))
    write_csv(price, str(tmp_path / "raw_price"))
    clean_client = build_client_table(spark, str(tmp_path / "raw_client"),
                                      str(tmp_path / "clean_client"))
    clean_price = build_price_table(spark, str(tmp_path / "raw_price"),
                                    str(tmp_path / "clean_price"))
    assert dict(clean_client.dtypes)["channel_sales"] == "bigint"
    assert dict(clean_client.dtypes)["has_gas"] == "int"
    assert clean_price.count() == price.count()

    use_database(spark, "default")
    register_tables(client_data=clean_client, price_data=clean_price)
    assert read_table(spark, "client_data").count() == clean_client.count()
    features = build_feature_table(spark, str(tmp_path / "features"), as_of="1998-01-01")
    assert features.columns == FEATURE_COLUMNS
    assert features.count() == clean_client.count()
    assert price_change_table(spark).count() == price.count()

    register_views(spark, as_of="1998-01-01")
    both = spark.sql("""
        SELECT f.id, f.net_margin, count(price_peak_var_change) AS changes
        FROM describe_price f JOIN price_change p ON f.id = p.id GROUP BY ALL""")
    assert both.count() == features.count()
    assert spark.sql("SELECT * FROM client_consumption").count() == clean_client.count()


def stored_prices(spark, small, tmp_path, buckets, hot=0):
    price = roles.price_role(spark, small)
    for _ in range(hot):
        price = price.unionByName(price.where("id % 10 = 1").withColumn("id", F.lit(1)
                                                                       .cast("bigint")))
    table = f"stored_{buckets}_{hot}"
    if hot:
        save_plain(price, table, path=str(tmp_path / table))
    else:
        save_clustered(price, table, buckets, sort_by=["price_date"], path=str(tmp_path / table))
    return spark.table(table), price


def test_clustered_table_needs_no_shuffle(spark, small, tmp_path):
    stored, price = stored_prices(spark, small, tmp_path, 4)
    stats, changes = price_statistics(stored), price_changes(stored)
    for df in (stats, changes):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert rows(stats, "id") == rows(price_statistics(price), "id")
    assert rows(changes, "id", "price_date") == rows(price_changes(price), "id", "price_date")


def test_hot_keys_are_told_and_stored_without_buckets(spark, small, tmp_path):
    stored, price = stored_prices(spark, small, tmp_path, 64, hot=2)
    assert largest_share(price, "id") * 64 > 1
    assert stored.count() == price.count()
    assert "Exchange" in price_statistics(stored)._jdf.queryExecution().executedPlan().toString()


def test_shuffle_partitions_follow_the_data(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        configure(spark, shuffled_bytes=100 * 1024**4)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "409600"
        configure(spark, shuffled_bytes=1)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "16"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_price_table_is_stored_gzipped(spark, small, tmp_path):
    """Plain text of prices takes several times the space, in files that tasks can share."""
    raw = roles.price_role(spark, small).withColumn("id", F.col("id").cast("string"))
    write_csv(raw, str(tmp_path / "plain"))
    write_csv(raw, str(tmp_path / "raw"), rows_per_gzip=1000)
    build_price_table(spark, str(tmp_path / "raw"), str(tmp_path / "clean"))
    size = {name: sum(p.stat().st_size for p in (tmp_path / name).glob("part-*"))
            for name in ("plain", "raw", "clean")}
    assert size["raw"] < 0.5 * size["plain"] and size["clean"] < 0.5 * size["plain"]
    assert len(list((tmp_path / "raw").glob("part-*.csv.gz"))) >= raw.count() / 1000


def test_gzipped_texts_with_line_breaks(spark, tmp_path):
    texts = spark.range(50).select("id", F.concat(
        F.lit('a "b"\n, '), F.col("id").cast("string"), F.lit("\n ")).alias("text"))
    write_csv(texts.coalesce(1), str(tmp_path / "csv"), rows_per_gzip=7)
    assert len(list((tmp_path / "csv").glob("part-*.csv.gz"))) == 8
    loaded = load_table(spark, str(tmp_path / "csv"), texts.schema)
    assert rows(loaded, "id") == rows(texts, "id")
