"""Client and price tables of a database to the stored feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keepwatt.operators.features import (
    DEFAULT_AS_OF, client_consumption_distinct, price_changes, price_sensitivity_features,
)
from keepwatt.sources.catalog import (
    read_features, read_table, register_tables, write_features,
)


def build_feature_table(spark: SparkSession, path: str, client_table: str = "client_data",
                        price_table: str = "price_data",
                        as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """Aggregate the two tables into the feature table, store it and return it."""
    features = price_sensitivity_features(
        read_table(spark, price_table), read_table(spark, client_table), as_of)
    write_features(features, path)
    return read_features(spark, path)


def price_change_table(spark: SparkSession, price_table: str = "price_data",
                       pieces: int | None = None) -> DataFrame:
    return price_changes(read_table(spark, price_table), pieces=pieces)


def register_views(spark: SparkSession, client_table: str = "client_data",
                   price_table: str = "price_data", as_of: str = DEFAULT_AS_OF) -> None:
    """Views for ``spark.sql``: ``describe_price`` (the features), ``price_change`` and
    ``client_consumption``. They are computed when queried; no job runs now."""
    client, price = read_table(spark, client_table), read_table(spark, price_table)
    register_tables(
        describe_price=price_sensitivity_features(price, client, as_of),
        price_change=price_changes(price),
        client_consumption=client_consumption_distinct(client),
    )
