"""The registered SQL of the text operators, in a second engine."""

import duckdb
import pytest
from pyspark.sql import functions as F

from panelspark.llm import oracle, queries


@pytest.mark.parametrize("key", list(oracle.ORACLE))
def test_query_equals_sql(spark, sf_dir, key):
    engine = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    expected = engine.sql(oracle.ORACLE[key])
    names = sorted(expected.columns)
    result = queries.QUERIES[key](spark, sf_dir)
    assert sorted(result.columns) == names
    wanted = [tuple(r[expected.columns.index(n)] for n in names) for r in expected.fetchall()]
    got = [tuple(r) for r in result.select(*[F.col(n) for n in names]).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr) and wanted
