"""Every registered query with SQL against DuckDB on the smallest tables, where these are there."""

import glob
import os

import pytest

from tokenledger.plans import ORACLES, QUERIES

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
SOME = sorted(ORACLES)


def rows(names, columns):
    order = sorted(names)
    return order, sorted((tuple(x for x in r) for r in zip(*(columns[names.index(c)] for c in order), strict=True)), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_equal(spark, duck, name):
    got = QUERIES[name](spark, DATA).toArrow()
    cursor = duck.execute(ORACLES[name])
    names, want = [d[0] for d in cursor.description], cursor.fetchall()
    assert rows(got.column_names, [c.to_pylist() for c in got.columns]) == rows(names, list(zip(*want, strict=True)) if want else [[]] * len(names))
