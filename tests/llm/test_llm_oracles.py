"""The queries that SQL expresses, against DuckDB on the smallest tables."""

import glob
import os

import pytest

from tokenledger.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cursor = con.execute(ORACLES[name])
    names, want = [d[0] for d in cursor.description], cursor.fetchall()
    got = QUERIES[name](spark, DATA).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
