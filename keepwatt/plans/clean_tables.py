"""Raw CSV tables to clean, typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keepwatt.operators.cleaning import clean_channel_sales, clean_datatypes
from keepwatt.schemas import CLIENT_SCHEMA, PRICE_SCHEMA
from keepwatt.sources.csv_tables import ROWS_PER_GZIP, load_table, write_csv

CLIENT_FLOATS = ["cons_12m", "cons_gas_12m", "cons_last_month", "forecast_cons_year"]
CLIENT_DATES = ["date_activ", "date_end", "date_modif_prod", "date_renewal"]


def clean_client(df: DataFrame, min_count: int = 20) -> DataFrame:
    """Channels first, since rare ones drop rows, then the types."""
    return clean_datatypes(
        clean_channel_sales(df, min_count=min_count),
        float_columns=CLIENT_FLOATS, int_columns=["channel_sales"],
        date_columns=CLIENT_DATES, bool_columns=["has_gas"])


def clean_price(df: DataFrame) -> DataFrame:
    return clean_datatypes(df, date_columns=["price_date"])


def build_client_table(spark: SparkSession, raw: str, clean: str) -> DataFrame:
    """Read, clean and store the client table; returns it as read back from the store."""
    result = clean_client(load_table(spark, raw, CLIENT_SCHEMA))
    write_csv(result, clean, rows_per_gzip=ROWS_PER_GZIP)
    return load_table(spark, clean, result.schema)


def build_price_table(spark: SparkSession, raw: str, clean: str) -> DataFrame:
    result = clean_price(load_table(spark, raw, PRICE_SCHEMA))
    write_csv(result, clean, rows_per_gzip=ROWS_PER_GZIP)
    return load_table(spark, clean, result.schema)
