"""The SQL of the secret scans finds the spans of the made-up texts too."""

import duckdb
import pyarrow as pa
from cases import documents
from test_secret_scans import PEMS, ROWS

from panelspark.llm import oracle, queries


def test_sql_equals_the_scan_of_made_up_texts(spark, tmp_path):
    rows = ROWS + [p[:2] for p in PEMS if len(p[1]) < 200_000]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op9_secret_scans(spark, str(tmp_path))
    engine = duckdb.connect()
    engine.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    expected = engine.sql(oracle.SECRETS)
    names = expected.columns
    wanted = sorted(map(tuple, expected.fetchall()), key=repr)
    got = sorted((tuple(r) for r in found.select(*names).collect()), key=repr)
    for a, b in zip(got, wanted, strict=True):
        assert a == b
