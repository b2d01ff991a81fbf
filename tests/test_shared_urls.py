"""Queries on probes where pages share URLs, and on part keys above a million, against their SQL in DuckDB."""

import os

import pytest

from tokenledger.plans import ORACLES, QUERIES

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
SHARED = ["AGG12_static_image_class", "STATE11_gate_release", "STATE12_probe_upsert", "STATE16_gateway_choice", "STATE1_viewability", "STATE2_viewability_feed", "STATE8_health_apply", "STATE9_health_sync", "STR8_viewability_feed"]
LARGE = ["MD6_overlay_artblocks"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A folder in which every page comes twice by its URL, so that each URL has two probes of other verdicts, gates and times, and in
    which some URLs are in no media row; and one whose part keys begin at 999,990."""
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    shared, large = tmp_path_factory.mktemp("shared"), tmp_path_factory.mktemp("large")
    read = lambda t: f"read_parquet('{DATA}/{t}.parquet')"
    for top, pages, part in (
        (shared, f"SELECT page_id, url, html FROM {read('pages')} UNION ALL SELECT page_id + n, url, html FROM {read('pages')}, (SELECT count(*) AS n FROM {read('pages')}) c", f"SELECT * FROM {read('part')} WHERE p_partkey < 30"),
        (large, f"SELECT * FROM {read('pages')}", f"SELECT * REPLACE (p_partkey + 999990 AS p_partkey) FROM {read('part')}"),
    ):
        duckdb.sql(f"COPY ({pages}) TO '{top}/pages.parquet'")
        duckdb.sql(f"COPY ({part}) TO '{top}/part.parquet'")
        duckdb.sql(f"COPY (SELECT * FROM {read('region')}) TO '{top}/region.parquet'")
    return {"shared": str(shared), "large": str(large)}


def check(spark, name, top):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "part", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{top}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    got = [tuple(r[c] for c in names) for r in QUERIES[name](spark, top).toArrow().to_pylist()]
    assert sorted(got, key=repr) == sorted(cursor.fetchall(), key=repr)


@pytest.mark.parametrize("name", SHARED)
def test_probes_that_share_a_url(spark, tables, name):
    check(spark, name, tables["shared"])


@pytest.mark.parametrize("name", LARGE)
def test_part_keys_above_a_million(spark, tables, name):
    check(spark, name, tables["large"])
