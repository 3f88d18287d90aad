"""Every reference query against its DuckDB oracle on the smallest tables."""

import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import sectorlake.plans as plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()
QUERIES, ORACLES = plans.load_reference_queries()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def shown(v):
        if pd.isna(v):
            return ""
        return f"{float(v) + 0.0:.5f}" if isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted(tuple(map(shown, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, oracle, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    want = oracle.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_all_have_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_checksums_are_zlibs(spark):
    import zlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert all(r["crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in QUERIES["crc_payload"](spark, FOLDER).collect())
