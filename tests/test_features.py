import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from keepwatt import roles
from keepwatt.functions import whole_months
from keepwatt.operators.features import (
    client_consumption_distinct, history_pieces, price_changes, price_sensitivity_features,
    price_statistics,
    repeated_keys, require_unique,
)
from keepwatt.schemas import CLIENT_SCHEMA, FEATURE_COLUMNS, PRICE_COLUMNS, PRICE_SCHEMA


def prices(spark, *items):
    """Price rows from (id, off_peak, peak) with mid_peak 0."""
    data = [(i, dt.datetime(2015, 1 + n % 12, 1), off, peak, 0.0, 0.0, 0.0, 0.0)
            for n, (i, off, peak) in enumerate(items)]
    return spark.createDataFrame(data, PRICE_SCHEMA)


def client_row(id_="a", channel="x", churn=0, years=4, modified=None, **values):
    row = {f.name: None for f in CLIENT_SCHEMA}
    row.update({f.name: 1.0 for f in CLIENT_SCHEMA if f.dataType.simpleString() == "double"})
    row.update(id=id_, channel_sales=channel, churn=churn, num_years_antig=years,
               date_end=dt.datetime(2016, 6, 15), date_modif_prod=modified,
               date_renewal=dt.datetime(2015, 6, 23), has_gas="t", **values)
    return tuple(row.values())


def test_zero_denominators_are_skipped(spark):
    stats = price_statistics(prices(spark, ("a", 0.0, 1.0), ("a", 2.0, 1.0), ("b", 0.0, 1.0)))
    assert rows(stats.select("id", "price_peak_off_peak_ratio_var"), "id") == [
        ("a", 0.5), ("b", None)]


def test_single_price_row_has_no_spread(spark):
    stats = price_statistics(prices(spark, ("a", 5.0, 5.0)))
    assert rows(stats.select("std_price_peak_var", "range_price_peak_var")) == [(0.0, 0.0)]


def test_spread_is_the_population_form(spark):
    stats = price_statistics(prices(spark, ("a", 1.0, 1.0), ("a", 1.0, 3.0)))
    assert rows(stats.select("std_price_peak_var")) == [(1.0,)]


@pytest.mark.parametrize("start, end, months", [
    ("2016-01-31", "2016-02-29", 0),
    ("2016-01-01", "2015-06-15", -6),
    ("2015-12-31", "2016-01-01", 0),
    ("2016-01-01", "2016-12-01", 11),
    ("2016-01-01", None, None),
])
def test_whole_months(spark, start, end, months):
    dates = spark.createDataFrame([(start, end)], "a string, b string")
    result = dates.select(whole_months(F.col("a").cast("timestamp"),
                                       F.col("b").cast("timestamp")))
    assert rows(result) == [(months,)]


def test_join_drops_unmatched_and_missing_ids(spark):
    price = prices(spark, ("a", 1.0, 1.0), ("only price", 1.0, 1.0), (None, 1.0, 1.0))
    client = spark.createDataFrame(
        [client_row("a"), client_row("only client"), client_row(None)], CLIENT_SCHEMA)
    assert rows(price_sensitivity_features(price, client).select("id")) == [("a",)]


def test_missing_dates_stay_a_group(spark):
    client = spark.createDataFrame(
        [client_row(), client_row(modified=dt.datetime(2015, 11, 1))], CLIENT_SCHEMA)
    result = price_sensitivity_features(prices(spark, ("a", 1.0, 1.0)), client)
    assert rows(result.select("months_since_modified"), "months_since_modified") == [
        (None,), (2,)]


def test_churn_needs_all_rows_of_the_group(spark):
    client = spark.createDataFrame(
        [client_row(churn=1, years=4), client_row(churn=0, years=5),
         client_row("b", churn=1)], CLIENT_SCHEMA)
    result = price_sensitivity_features(
        prices(spark, ("a", 1.0, 1.0), ("b", 1.0, 1.0)), client)
    assert rows(result.select("id", "tenure_years", "churn"), "id") == [("a", 4, 0), ("b", 4, 1)]


def join_first(spark, price, client):
    price.createOrReplaceTempView("price_data")
    client.createOrReplaceTempView("client_data")
    means = {
        "yearly_consumption": "round(avg(cons_12m))",
        "monthly_consumption": "floor(avg(cons_last_month))",
        "paid_consumption": "round(avg(imp_cons), 3)",
        "avg_price_peak_var": "round(avg(price_peak_var), 3)",
        "price_peak_off_peak_ratio_var":
            "round(avg(price_peak_var / nullif(price_off_peak_var, 0)), 3)",
        "std_price_off_peak_var": "round(stddev_pop(price_off_peak_var), 3)",
        "range_price_peak_var": "round(max(price_peak_var) - min(price_peak_var), 3)",
        "churn": "floor(avg(churn))",
    }
    measures = ", ".join(f"{sql} AS {name}" for name, sql in means.items())
    return spark.sql(f"""
        SELECT p.id, c.channel_sales,
               timestampdiff(MONTH, TIMESTAMP '2016-01-01', date_end) AS months_to_end,
               {measures}
        FROM price_data p JOIN client_data c ON p.id = c.id
        GROUP BY p.id, c.channel_sales, months_to_end""")


def test_aggregating_before_the_join_changes_nothing(spark):
    """Clients with several rows per group, and prices of very different multiplicity."""
    draw = random.Random(7)
    ids = [f"c{n}" for n in range(12)]
    client = spark.createDataFrame(
        [client_row(draw.choice(ids), draw.choice("xyz"), draw.randint(0, 1),
                    cons_12m=draw.uniform(0, 9e4), imp_cons=draw.uniform(0, 300),
                    cons_last_month=draw.uniform(0, 9e3)) for _ in range(60)], CLIENT_SCHEMA)
    price = prices(spark, *[(ids[min(int(draw.expovariate(0.4)), 11)],
                             draw.choice([0.0, draw.uniform(0.1, 0.2)]),
                             draw.uniform(0, 0.1)) for _ in range(300)])
    expected = join_first(spark, price, client)
    result = price_sensitivity_features(price, client).select(*expected.columns)
    assert rows(result, "id", "channel_sales") == rows(expected, "id", "channel_sales")


def test_feature_columns(spark):
    client = spark.createDataFrame([client_row()], CLIENT_SCHEMA)
    result = price_sensitivity_features(prices(spark, ("a", 1.0, 1.0)), client)
    assert result.columns == FEATURE_COLUMNS and len(FEATURE_COLUMNS) == 26


def test_distinct_pairs(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("b", None)],
                               "id string, cons_12m double")
    assert rows(client_consumption_distinct(df), "id", "cons_12m") == [
        ("a", 1.0), ("a", 2.0), ("b", None)]


def plain_changes(price):
    window = Window.partitionBy("id").orderBy("price_date")
    return price.select("id", "price_date", *[
        (F.col(c) - F.lag(c).over(window)).alias(f"{c}_change") for c in PRICE_COLUMNS])


def skewed_history(spark, n=1500):
    """One id with a third of the rows, missing ids with a fifth, clustered dates."""
    draw = random.Random(3)
    start = dt.datetime(2015, 1, 1)
    data = []
    for i in range(n):
        share = draw.random()
        id_ = "hot" if share < 0.34 else None if share < 0.54 else f"c{draw.randint(0, 40)}"
        when = start + dt.timedelta(seconds=i * i if i % 3 else i)
        # the hot id also has one row without a date
        data.append((id_, None if i == 777 else when,
                     *[draw.choice([None, draw.random()]) for _ in PRICE_COLUMNS]))
    data = [("hot", *row[1:]) if row[1] is None else row for row in data]
    schema = "id string, price_date timestamp, " + ", ".join(f"{c} double" for c in PRICE_COLUMNS)
    # (id, date) has to be unique
    return spark.createDataFrame(list({(r[0], r[1]): r for r in data}.values()), schema)


@pytest.mark.parametrize("pieces", [None, 2, 7, 40])
def test_cutting_hot_histories_changes_nothing(spark, pieces):
    price = skewed_history(spark).repartition(5).persist()
    expected = plain_changes(price)
    result = price_changes(price, pieces=pieces)
    assert rows(result, "id", "price_date") == rows(expected, "id", "price_date")


@pytest.mark.parametrize("order", [
    "string(price_date)", "unix_micros(price_date)", "struct('p', price_date)"])
def test_any_order_that_sorts_works_with_and_without_hot_ids(spark, order):
    price = skewed_history(spark, 400).withColumn("price_date", F.expr(order))
    plain, cut = (sorted(map(tuple, price_changes(price, pieces=p).drop("price_date").collect()),
                         key=repr) for p in (None, 8))
    assert plain == cut and len(cut) == price.count()


def peers_by_hand(data):
    """(id, day, change) with the last value of the previous different day."""
    lowest = (0, 0.0)
    by_id = {}
    for id_, day, value in data:
        by_id.setdefault(id_, {}).setdefault(day, []).append(value)
    for id_, days in by_id.items():
        before = None
        for day in sorted(days, key=lambda d: (d is not None, d or 0)):
            for value in days[day]:
                known = before is not None and value is not None
                yield id_, day, value - before if known else None
            before = max(days[day], key=lambda v: lowest if v is None else (1, v))


@pytest.mark.parametrize("pieces", [None, 3, 20])
def test_rows_of_one_date_are_peers(spark, pieces):
    draw = random.Random(8)
    data = [(draw.choice(["hot", "hot", "a", "b", None]), draw.choice([None, *range(12)]),
             draw.choice([None, *map(float, range(9))])) for _ in range(600)]
    data += [("one", 1, 5.0), ("none", None, 2.0), ("none", None, 3.0), ("gap", 1, None), ("gap", 2, 1.0)]
    frame = spark.createDataFrame(data, "id string, day int, price double")
    want = sorted(peers_by_hand(data), key=repr)
    for parts in (1, 7):
        got = price_changes(frame.repartition(parts), ["price"], order="day", pieces=pieces)
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_no_window_group_grows_with_the_hot_history(spark):
    price = skewed_history(spark)
    pieces = history_pieces(price, group_rows=100)
    assert pieces == -(-price.count() // 100) and history_pieces(price, group_rows=1000) is None
    sizes = (price.repartitionByRange(pieces, "id", "price_date")
             .groupBy(F.spark_partition_id()).count())
    assert sizes.agg(F.max("count")).first()[0] <= 200


def test_ordinary_histories_take_one_shuffle_and_sort(spark):
    price = skewed_history(spark)
    plan = price_changes(price)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and plan.count("Window ") == 2


@pytest.mark.parametrize("collation", ["UTF8_LCASE", "UNICODE_CI_AI"])
def test_ids_that_differ_in_case_meet(spark, small, collation):
    price, client = roles.price_role(spark, small), roles.client_role(spark, small)
    named = F.concat(F.lit("Ab"), F.col("id"))
    plain = price_sensitivity_features(price.withColumn("id", named), client.withColumn("id", named))
    upper = F.when(F.month("price_date") % 2 == 0, F.upper(named)).otherwise(F.lower(named))
    mixed = price_sensitivity_features(price.withColumn("id", upper),
                                       client.withColumn("id", named), collation=collation)
    assert rows(mixed, "id") == rows(plain, "id")
    apart = price_sensitivity_features(price.withColumn("id", upper), client.withColumn("id", named))
    assert apart.count() == 0


def test_unique_key_check(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "id int, price_date int")
    assert rows(repeated_keys(df, ["id", "price_date"])) == [(1, 2, 2)]
    assert require_unique(df.distinct(), ["id", "price_date"]).count() == 2
    with pytest.raises(ValueError, match="not unique"):
        require_unique(df, ["id", "price_date"])
