"""Profiles of feature columns against churn: shares, ranges and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwatt.functions import churn_label
from keepwatt.schemas import NUMERIC_FEATURES


def churn_share(df: DataFrame, column: str, churn: str = "churn") -> DataFrame:
    """Rows per (category, churn) and their percentage within the category.

    The window sums the counted rows, two per category, never the input rows.
    """
    counts = (df.dropna(subset=[column, churn])
              .groupBy(column, churn).agg(F.count(F.lit(1)).alias("count")))
    in_category = F.sum("count").over(Window.partitionBy(column))
    return counts.select(
        column,
        churn_label(F.col(churn)).alias(churn),
        "count",
        (F.col("count") / in_category * 100).alias("percentage"),
    )


def number_sql(name: str) -> str:
    """The column as a double, with NaN treated as missing."""
    return f"nanvl(CAST(`{name}` AS DOUBLE), CAST(NULL AS DOUBLE))"


def one_row_per_column(columns: Sequence[str], fields: dict[str, str]) -> Column:
    """Turn one row with ``<column>__<suffix>`` values into one row per column."""
    rows = (", ".join([f"'{c}' AS column", *(f"`{c}__{suffix}` AS {name}"
                                             for name, suffix in fields.items())])
            for c in columns)
    return F.expr(f"inline(array({', '.join(f'struct({row})' for row in rows)}))")


def long_values(df: DataFrame, columns: Sequence[str], churn: str = "churn") -> DataFrame:
    """(column, churn, value) for the churn and no-churn rows; missing values are dropped."""
    pairs = ", ".join(f"struct('{c}' AS column, {number_sql(c)} AS value)" for c in columns)
    return (df.where(F.col(churn).isin(0, 1))
            .select(F.col(churn).cast("int").alias("churn"), F.expr(f"inline(array({pairs}))"))
            .where(F.col("value").isNotNull()))


def column_ranges(df: DataFrame, columns: Sequence[str] = tuple(NUMERIC_FEATURES),
                  steps: int = 100) -> DataFrame:
    """Lowest and highest value of each column and the step of a ``steps``-part slider."""
    bounds = []
    for c in columns:
        bounds += [F.expr(f"min({number_sql(c)}) AS `{c}__lo`"),
                   F.expr(f"max({number_sql(c)}) AS `{c}__hi`")]
    return (df.agg(*bounds).select(one_row_per_column(columns, {"min_value": "lo", "max_value": "hi"}))
            .withColumn("step", (F.col("max_value") - F.col("min_value")) / steps))


def _churn_edges(df: DataFrame, columns: Sequence[str], churn: str) -> DataFrame:
    """Histogram range of each column, one row per column, taken from the churn rows only."""
    bounds = []
    for c in columns:
        bounds += [F.expr(f"min({number_sql(c)}) FILTER (WHERE `{churn}` = 1) AS `{c}__lo`"),
                   F.expr(f"max({number_sql(c)}) FILTER (WHERE `{churn}` = 1) AS `{c}__hi`")]
    ranges = df.agg(*bounds).select(one_row_per_column(columns, {"lo": "lo", "hi": "hi"}))
    constant = F.col("lo") == F.col("hi")
    return ranges.select(
        "column",
        F.when(F.col("lo").isNull(), 0.0).when(constant, F.col("lo") - 0.5)
        .otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("hi").isNull(), 1.0).when(constant, F.col("hi") + 0.5)
        .otherwise(F.col("hi")).alias("hi"),
    )


def churn_histogram(df: DataFrame, columns: str | Sequence[str] = tuple(NUMERIC_FEATURES),
                    bins: int = 12, churn: str = "churn") -> DataFrame:
    """Equal-width histogram of the churn and no-churn rows, as percentages of each bin.

    All columns are binned in one pass over the rows; only (column, bin) counts are shuffled.
    The range comes from the churn rows, so no-churn values outside it are not counted. Bins
    include their left edge, the last one both edges. Empty bins appear with 0 percent.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    edges = _churn_edges(df, columns, churn)
    width = (F.col("hi") - F.col("lo")) / bins

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.col("hi")).otherwise(i * width + F.col("lo"))

    # arithmetic guess, then moved by one where rounding put the value beyond an edge
    guess = F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))
    bin_number = (F.when(F.col("value") < edge(F.col("guess")), F.col("guess") - 1)
                  .when((F.col("value") >= edge(F.col("guess") + 1))
                        & (F.col("guess") < bins - 1), F.col("guess") + 1)
                  .otherwise(F.col("guess")))
    # one row per profiled column, so the broadcast is bounded by the schema
    counted = (
        long_values(df, columns, churn)
        .join(F.broadcast(edges), "column")
        .where(F.col("value").between(F.col("lo"), F.col("hi")))
        .withColumn("guess", guess)
        .groupBy("column", bin_number.cast("int").alias("bin"))
        .agg(F.count_if(F.col("churn") == 1).alias("churn_count"),
             F.count_if(F.col("churn") == 0).alias("no_churn_count"))
    )
    all_bins = edges.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    churned = F.coalesce(F.col("churn_count"), F.lit(0))
    stayed = F.coalesce(F.col("no_churn_count"), F.lit(0))
    in_bin = F.greatest(churned + stayed, F.lit(1))
    return all_bins.join(counted, ["column", "bin"], "left").select(
        "column", "bin",
        ((edge(F.col("bin")) + edge(F.col("bin") + 1)) / 2).alias("bin_center"),
        churned.alias("churn_count"),
        stayed.alias("no_churn_count"),
        (churned / in_bin * 100).alias("churn_pct"),
        (stayed / in_bin * 100).alias("no_churn_pct"),
    )
