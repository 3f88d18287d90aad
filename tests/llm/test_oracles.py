"""Every corpus query that SQL can express against its DuckDB oracle, on the smallest tables."""

import os

import duckdb
import pytest

from sectorlake.llm import queries
from tests.test_oracles import rows

FOLDER = os.environ.get("ORACLE_TABLES", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages conversations benchmark".split()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
