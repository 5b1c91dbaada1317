"""The profile of one chosen column, or of all columns in a few jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from keepwatt.operators.density import churn_kde
from keepwatt.operators.profiling import churn_histogram, churn_share, column_ranges
from keepwatt.schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES


def profile_column(df: DataFrame, column: str, bins: int = 12,
                   density_range: tuple[float, float] | None = None) -> dict[str, DataFrame]:
    """Share by category for a categorical column; range, histogram and density otherwise.

    Without ``density_range`` the density spans the whole range of the column.
    """
    if column in CATEGORICAL_FEATURES:
        return {"share": churn_share(df, column)}
    return {
        "range": column_ranges(df, [column]),
        "histogram": churn_histogram(df, column, bins),
        "density": churn_kde(df, {column: density_range}),
    }


def profile_all(df: DataFrame, bins: int = 12) -> dict[str, DataFrame]:
    """Shares of the categorical columns and one table each for all numeric columns."""
    numeric = [c for c in NUMERIC_FEATURES if c in df.columns]
    tables = {f"share_{c}": churn_share(df, c) for c in CATEGORICAL_FEATURES if c in df.columns}
    tables["ranges"] = column_ranges(df, numeric)
    tables["histograms"] = churn_histogram(df, numeric, bins)
    tables["densities"] = churn_kde(df, {c: None for c in numeric})
    return tables
