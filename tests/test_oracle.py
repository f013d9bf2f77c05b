"""Every registered query against its SQL in a second engine: names, types, rows."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from panelspark.plans import catalog, oracle
from panelspark.sources.schemas import STAR
from helpers import rows

SQL_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def engine(sf_dir):
    con = duckdb.connect()
    for table in STAR:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracle.ORACLE)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", list(catalog.QUERIES))
def test_query_equals_sql(spark, sf_dir, engine, key):
    result = entry.queries()[key](spark, sf_dir)
    expected = engine.sql(entry.oracle_sql()[key])
    names = sorted(result.columns)
    assert names == sorted(expected.columns)
    types = dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert {f.name: SQL_TYPES[f.dataType.simpleString()] for f in result.schema} == types
    place = [expected.columns.index(n) for n in names]
    wanted = sorted((tuple(r[i] for i in place) for r in expected.fetchall()), key=repr)
    assert wanted, "the query must have something to compare"
    assert rows(result) == wanted


@pytest.mark.parametrize("missing", ["panelspark.llm", "corpus_pipeline", "ahocorasick", "public_tokenizers", "regex"])
def test_queries_without_the_text_operators(missing):
    """The panel's queries stay where the subpackage, or a library that only it needs, is absent."""
    code = f"""
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r} or name.startswith({missing!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as entry
from panelspark.plans import catalog
assert set(entry.queries()) == set(entry.oracle_sql()) == set(catalog.QUERIES)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["entity", "period", "gdp_ma"]
    assert result.count() > 0
