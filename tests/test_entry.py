"""The driver's contract."""

import importlib.util

import __spark_entry__ as entry
from tablewright import catalog


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["c_custkey", "c_name", "n", "total", "top"] and df.count() > 0


def test_registered():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(catalog.QUERIES) <= set(queries) and len(catalog.QUERIES) > 100
    corpus = importlib.util.find_spec("tablewright.llm") and importlib.util.find_spec("corpus_pipeline")
    assert len(set(queries) - set(catalog.QUERIES)) == (11 if corpus else 0)
