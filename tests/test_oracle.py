"""Every registered query against its SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__ as registered

TABLES = ["customer", "orders", "lineitem", "part", "documents", "benchmark", "conversations"]
QUERIES = {name: query for name, query in registered.queries().items()
           if name not in registered.LLM_QUERIES}
ORACLES = {name: sql for name, sql in registered.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    return connection


def canonical(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("NULL" if row[i] is None else repr(row[i]) for i in order)
                  for row in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, small, name):
    result = QUERIES[name](spark, small)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert canonical(result.columns, result.collect()) == canonical(columns, cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert registered.entry(spark).count() > 0


MODEL_ROWS = {"forest_scores": 3, "forest_importance": 28, "forest_tuned": 50,
              "tuned_vs_custom": 6, "model_roundtrip": 150}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_of_models_on_labels_without_a_rule(spark, small, name):
    assert QUERIES[name](spark, small).count() == MODEL_ROWS[name]
