"""Cleaning of the raw tables: rare sales channels and column types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwatt.functions import (
    cast_boolean_flag, cast_float, cast_int, cast_text, cast_timestamp,
)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-missing value of ``column``, as (column, n)."""
    return (df.where(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias("n")))


def channel_codes(df: DataFrame, column: str = "channel_sales",
                  min_count: int = 20) -> DataFrame:
    """(column, n, code) for every value with more than ``min_count`` rows.

    Codes rank the values by descending frequency from 0; equal counts share a code. The rank
    runs over the distinct counts, and k different counts need at least k(k+1)/2 rows of
    input, so even 10^12 rows cannot give that single-task sort more than 1.5 million numbers.
    """
    frequent = value_counts(df, column).where(F.col("n") > min_count)
    by_count = Window.orderBy(F.col("n").desc())
    ranks = frequent.select("n").distinct().select(
        "n", (F.row_number().over(by_count) - 1).alias("code"))
    return frequent.join(ranks, "n").select(column, "n", "code")


def clean_channel_sales(df: DataFrame, column: str = "channel_sales",
                        min_count: int = 20) -> DataFrame:
    """Keep rows whose channel has more than ``min_count`` rows and replace the channel name
    by its frequency rank. Rows without a channel are removed.

    One lazy join; adaptive execution broadcasts the codes if they turn out small. Otherwise
    the rebalanced codes are shuffled on their own, so that a hot channel's rows can be split.
    """
    codes = channel_codes(df, column, min_count).drop("n").hint("rebalance")
    return df.join(codes, column).withColumn(column, F.col("code")).select(*df.columns)


def clean_datatypes(df: DataFrame, float_columns: Sequence[str] | None = None,
                    int_columns: Sequence[str] | None = None,
                    str_columns: Sequence[str] | None = None,
                    date_columns: Sequence[str] | None = None,
                    bool_columns: Sequence[str] | None = None,
                    date_format: str | None = None, strict: bool = True) -> DataFrame:
    """Retype columns in one projection, in the order float, int, text, timestamp, boolean.

    A column in two lists gets both conversions, the later one on the earlier result.
    ``strict`` raises on text that does not convert and on missing integers; otherwise such
    values become NULL.
    """
    retyped = {}

    def apply(columns, convert):
        for name in columns or ():
            if name not in df.columns:
                raise ValueError(f"unknown column {name!r}")
            retyped[name] = convert(retyped.get(name, F.col(name)))

    apply(float_columns, lambda c: cast_float(c, strict))
    apply(int_columns, lambda c: cast_int(c, strict))
    apply(str_columns, cast_text)
    apply(date_columns, lambda c: cast_timestamp(c, date_format, strict))
    apply(bool_columns, cast_boolean_flag)
    return df.withColumns(retyped) if retyped else df
