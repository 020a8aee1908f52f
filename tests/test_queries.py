"""Every registered query against DuckDB on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def _normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, sf_dir, name):
    df = contract.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    sql = contract.oracle_sql().get(name)
    if sql is not None:
        result = duck.sql(sql)
        assert _normal(df.columns, rows) == _normal(result.columns, result.fetchall())


def test_entry(spark, sf_dir):
    assert contract.entry(spark).columns == ["url", "title", "categories", "cited_by", "status"]


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
