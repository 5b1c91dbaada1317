"""Catalog tables, database tables and the stored feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def use_database(spark: SparkSession, name: str) -> None:
    spark.catalog.setCurrentDatabase(name)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def register_tables(**tables: DataFrame) -> None:
    """Make DataFrames available to ``spark.sql`` under the given names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def largest_share(df: DataFrame, key: str) -> float:
    """Share of the rows that the most frequent value of ``key`` holds (0 without rows)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.sum("n").alias("rows"), F.max("n").alias("largest")).first()
    return top["largest"] / top["rows"] if top["rows"] else 0.0


def save_clustered(df: DataFrame, table: str, buckets: int, key: str = "id",
                   sort_by: Sequence[str] = (), path: str | None = None) -> None:
    """Store ``df`` as a table bucketed by ``key``.

    Grouping, windows and joins by ``key`` on such a table need no shuffle. But a bucket is
    read by one task, so a key that would fill more than an average bucket, as
    ``largest_share(df, key) * buckets > 1`` tells, calls for ``save_plain``.
    """
    # a task then holds whole buckets and writes one file for each
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet")
    writer = writer.bucketBy(buckets, key).sortBy(key, *sort_by)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def save_plain(df: DataFrame, table: str, path: str | None = None) -> None:
    """Store ``df`` as a table without buckets, whose rows are shuffled after partial
    aggregation; the way for tables with hot keys."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_database_table(spark: SparkSession, url: str, table: str, partition_column: str,
                        lower: int | str, upper: int | str, partitions: int,
                        properties: dict[str, str] | None = None) -> DataFrame:
    """Read a table over JDBC as ``partitions`` range queries on ``partition_column``.

    The bounds shape the ranges only; rows outside them are read as well.
    """
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                           upperBound=upper, numPartitions=partitions,
                           properties=properties or {})


def write_features(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
