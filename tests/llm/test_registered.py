"""Registered queries of the subpackage: against their SQL, or that they run over all rows."""

import duckdb
import pytest

import __spark_entry__ as registered

QUERIES, ORACLES = registered.queries(), registered.LLM_SQL
PER_DOCUMENT = {name for name in registered.LLM_QUERIES
                if name not in ("pipeline", "op5_decontamination", "op13_spelling_groups")}


def canonical(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("NULL" if row[i] is None else repr(row[i]) for i in order)
                  for row in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, small, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    result = QUERIES[name](spark, small)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert canonical(result.columns, result.collect()) == canonical(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(registered.LLM_QUERIES) - set(ORACLES)))
def test_rows(spark, small, name):
    n = QUERIES[name](spark, small).count()
    documents = spark.read.parquet(f"{small}/documents.parquet").count()
    assert n == documents if name in PER_DOCUMENT else n > 0
