"""Order and part tables read in the roles of the client and price tables.

The tests, the benchmark and the registered queries use these: customers with their orders
play the clients, order lines by customer and month play the price history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwatt.operators.features import price_sensitivity_features
from keepwatt.operators.hash_split import hash_order

AS_OF = "1998-01-01"

# The columns read below. With given schemas no file is opened to plan a query.
TABLES = {
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_shipdate timestamp",
    "part": "p_partkey bigint, p_brand string, p_size int",
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{folder}/{table}.parquet")


def client_role(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer. Orders are aggregated before the join, so the join sees one row
    per customer on both sides. Money is summed as a decimal, which makes the sum exact."""
    orders = read(spark, folder, "orders")
    price = F.col("o_totalprice")
    total = F.sum(price.cast("decimal(18,2)")).cast("double")
    gas = F.sum(F.when(F.col("o_orderstatus") == "P", price).otherwise(F.lit(0.0))
                .cast("decimal(18,2)")).cast("double")
    per_customer = (
        orders.where(F.col("o_custkey").isNotNull())
        .groupBy(F.col("o_custkey").alias("id")).agg(
            F.min("o_orderdate").alias("date_activ"),
            F.max("o_orderdate").alias("date_end"),
            F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate")))
            .alias("date_modif_prod"),
            F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
            .alias("date_renewal"),
            total.alias("cons_12m"),
            gas.alias("cons_gas_12m"),
            F.max(price).alias("highest"),
            F.min(price).alias("lowest"),
            F.max(F.when(F.col("o_orderstatus") == "P", "t").otherwise("f")).alias("has_gas"),
        )
    )
    customer = read(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("channel_sales"),
        F.col("c_nationkey").alias("num_years_antig"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("churn"),
    )
    return customer.join(per_customer, "id").select(
        "id", "channel_sales", "num_years_antig",
        "date_activ", "date_end", "date_modif_prod", "date_renewal",
        "cons_12m", "cons_gas_12m",
        F.col("highest").alias("cons_last_month"),
        F.col("highest").alias("imp_cons"),
        F.col("highest").alias("net_margin"),
        (F.col("cons_12m") / 2).alias("forecast_cons_12m"),
        (F.col("cons_12m") / 2).alias("forecast_cons_year"),
        F.col("lowest").alias("forecast_meter_rent_12m"),
        F.col("lowest").alias("margin_net_pow_ele"),
        (F.col("highest") - F.col("lowest")).alias("margin_gross_pow_ele"),
        "has_gas", "churn",
    )


def price_role(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer and month, with the highest and lowest logarithmic prices."""
    unit = F.ln(F.col("l_extendedprice") / F.col("l_quantity"))
    lines = read(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        F.date_trunc("month", "l_shipdate").alias("price_date"),
        F.ln("l_extendedprice").alias("peak"),
        (F.col("l_tax") * unit).alias("off_peak"),
        (F.col("l_discount") * unit).alias("mid_peak"),
    )
    owners = read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("id"))
    bands = ("peak", "off_peak", "mid_peak")
    return (lines.join(owners, "order_key")
            .groupBy("id", "price_date")
            .agg(*[F.max(b).alias(f"price_{b}_var") for b in bands],
                 *[F.min(b).alias(f"price_{b}_fix") for b in bands]))


def feature_role(spark: SparkSession, folder: str) -> DataFrame:
    return price_sensitivity_features(price_role(spark, folder), client_role(spark, folder),
                                      as_of=AS_OF)


def price_line_role(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line, with the client and the month: dates of a client repeat."""
    unit = F.ln(F.col("l_extendedprice") / F.col("l_quantity"))
    owners = read(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    lines = read(spark, folder, "lineitem").withColumn("o_orderkey", F.col("l_orderkey"))
    return lines.join(owners, "o_orderkey").select(
        "id", F.date_trunc("month", "l_shipdate").alias("price_date"),
        F.ln("l_extendedprice").alias("price_peak_var"),
        (F.col("l_tax") * unit).alias("price_off_peak_var"),
        (F.col("l_discount") * unit).alias("price_mid_peak_var"))


def rule_role(spark: SparkSession, folder: str) -> DataFrame:
    """The feature table with a label that a forest can learn: a rule on the channel, turned
    over for one client in ten, chosen by a hash."""
    rule = F.col("channel_sales").isin("BUILDING", "MACHINERY").cast("bigint")
    return feature_role(spark, folder).withColumn(
        "churn", F.when(hash_order(["id"], 7) % 10 == 0, 1 - rule).otherwise(rule))


def channel_role(spark: SparkSession, folder: str) -> DataFrame:
    """Parts with a channel made of brand and size class: many channels, with equal counts."""
    return read(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat_ws("/", "p_brand", (F.col("p_size") % 4).cast("string")).alias("channel_sales"),
    )


def order_value_role(spark: SparkSession, folder: str) -> DataFrame:
    """Order values with the churn flag of the customer."""
    customer = read(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("churn"))
    return read(spark, folder, "orders").join(customer, "o_custkey").select(
        "o_orderkey", "o_totalprice", "churn")
