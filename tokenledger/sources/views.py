"""Ledger tables derived from the driver's tables, as SQL text in the dialects of Spark and DuckDB.

The two texts differ only where the dialects do; timestamps stay without a zone and sums are of integers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import of_rows

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "embeddings"]

DIALECTS = {
    "spark": {
        "day": lambda n: f"CAST(date_add(DATE'2020-01-01', CAST({n} AS INT)) AS TIMESTAMP_NTZ)",
        "json": lambda c, k: f"get_json_object({c}, '$.{k}')",
        "days_since": lambda c: f"datediff(CAST({c} AS DATE), DATE'1995-01-01')",
        "bits": "aggregate(sequence(0, 62), CAST(0 AS BIGINT), (a, i) -> a + CASE WHEN embedding[i] > 0 THEN shiftleft(CAST(1 AS BIGINT), i) ELSE CAST(0 AS BIGINT) END) + CASE WHEN embedding[63] > 0 THEN -9223372036854775807 - 1 ELSE 0 END",
        "ntz": lambda c: f"CAST({c} AS TIMESTAMP_NTZ)",
    },
    "duckdb": {
        "day": lambda n: f"CAST(DATE '2020-01-01' + CAST({n} AS INTEGER) AS TIMESTAMP)",
        "json": lambda c, k: f"json_extract_string({c}, '$.{k}')",
        "days_since": lambda c: f"(CAST({c} AS DATE) - DATE '1995-01-01')",
        "bits": "CAST(list_sum(list_transform(range(63), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT) + CASE WHEN embedding[64] > 0 THEN -9223372036854775807 - 1 ELSE 0 END",
        "ntz": lambda c: f"CAST({c} AS TIMESTAMP)",
    },
}

#: View -> (views and tables that it reads, text).
VIEWS = {
    "ledger": """
      SELECT event_id, token_id, CASE WHEN token_id % 4 = 3 THEN 'tezos:mainnet' ELSE 'eip155:1' END AS chain,
             'k' || CAST(token_id % 10 AS STRING_) AS contract, event_type,
             CASE WHEN event_type IN ('transfer', 'burn') THEN previous END AS from_address,
             CASE WHEN event_type IN ('mint', 'transfer') THEN owner END AS to_address,
             quantity, 'tx' || CAST(event_id AS STRING_) AS tx_hash, CAST(floor(event_id / 3) AS BIGINT) AS block_number,
             event_id % 3 AS tx_index, ts
      FROM (
        SELECT *, lag(owner) OVER (PARTITION BY token_id, owned ORDER BY event_id) AS previous FROM (
          SELECT event_id, CAST({json:props,k} AS BIGINT) AS token_id, 'u' || CAST(user_id AS STRING_) AS owner, {ntz:ts} AS ts,
                 CASE event_type WHEN 'signup' THEN 'mint' WHEN 'purchase' THEN 'transfer' WHEN 'error' THEN 'burn' ELSE 'metadata_update' END AS event_type,
                 event_type IN ('signup', 'purchase', 'error') AS owned, CAST(floor(value) AS BIGINT) AS quantity
          FROM events) e) p""",
    "holdings": """
      SELECT l_partkey AS token_id, 'c' || CAST(o_custkey AS STRING_) AS address,
             CAST(l_quantity AS BIGINT) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS delta,
             l_shipdate, l_orderkey, l_linenumber, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS price
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "transfers": """
      SELECT l_partkey AS token_id, 's' || CAST(l_suppkey AS STRING_) AS from_address, 'c' || CAST(o_custkey AS STRING_) AS to_address,
             CAST(l_quantity AS BIGINT) AS quantity, CAST({days_since:l_shipdate} AS BIGINT) AS block_number, l_orderkey AS tx_index,
             CAST(l_linenumber AS BIGINT) AS log_index, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, l_suppkey AS supp
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "token_dim": """
      SELECT p_partkey AS token_id, 'eip155:1' AS chain, 'erc721' AS standard, '0x' || substr(md5(p_brand), 1, 32) || 'abcdEF01' AS contract,
             CAST(p_partkey AS STRING_) AS number, 'u' || CAST(p_partkey % 150 AS STRING_) AS current_owner, p_size % 11 = 0 AS burned,
             p_size % 5 <> 0 AS is_viewable, CASE WHEN p_size % 7 = 0 THEN 'spam' ELSE 'none' END AS moderation_status,
             {day:p_partkey % 900} AS created_at, p_brand AS brand, p_size AS size, p_name AS name
      FROM part""",
    "release_dim": """
      SELECT p_partkey AS token_id, CAST(substr(p_brand, 7) AS BIGINT) AS release_id, p_brand AS vendor_release_id,
             CASE WHEN p_size % 2 = 0 THEN 'artblocks' ELSE 'fxhash' END AS vendor,
             CASE WHEN p_brand LIKE '%5' THEN NULL ELSE lower(replace(p_brand, '#', '-')) END AS slug,
             CAST(floor(p_partkey / 25) AS BIGINT) + 1 AS mint_number
      FROM part""",
    "balances": """
      SELECT token_id * 10000000000 + CAST(substr(address, 2) AS BIGINT) AS id, token_id, address AS owner_address, CAST(sum(delta) AS BIGINT) AS quantity
      FROM holdings GROUP BY token_id, address HAVING sum(delta) > 0""",
    "media": """
      SELECT t.p_partkey * 4 + s.ix AS id, t.p_partkey AS token_id, p.url AS media_url, md5(p.url) AS url_hash,
             CASE s.ix WHEN 0 THEN 'metadata_image' WHEN 1 THEN 'metadata_animation' WHEN 2 THEN 'enrichment_image' ELSE 'enrichment_animation' END AS media_source,
             CASE (t.p_size + s.ix) % 3 WHEN 0 THEN 'healthy' WHEN 1 THEN 'broken' ELSE 'unknown' END AS health_status,
             {day:(t.p_partkey + s.ix) % 60} AS last_checked_at,
             CASE WHEN (t.p_size + s.ix) % 3 = 1 THEN CASE (t.p_partkey + s.ix) % 4 WHEN 0 THEN 'render_blank' WHEN 1 THEN 'http_status' WHEN 2 THEN 'render_stalled' END END AS failure_reason,
             CASE (t.p_partkey + s.ix) % 8 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/html; charset=utf-8' WHEN 3 THEN 'image/bmp' WHEN 4 THEN 'video/mp4' WHEN 5 THEN 'audio/mpeg' WHEN 6 THEN 'text/html' END AS content_type
      FROM part t CROSS JOIN (SELECT 0 AS ix UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) s
      CROSS JOIN (SELECT count(*) AS n FROM pages) c
      JOIN pages p ON p.page_id = (t.p_partkey * 4 + s.ix) % c.n
      WHERE (t.p_partkey + s.ix) % 3 <> 0""",
    "probes": """
      SELECT md5(url) AS url_hash, url AS media_url, page_id % 11 = 0 AS health_gated, page_id % 4 AS consecutive_failures,
             CASE WHEN page_id % 5 <> 0 THEN {day:page_id % 30} END AS captured_at, {day:page_id % 45} AS next_check_at,
             CASE page_id % 3 WHEN 0 THEN 'rendered_ok' WHEN 1 THEN 'blank' ELSE 'stalled' END AS verdict, page_id * 7919 AS phash
      FROM pages WHERE page_id % 7 <> 4""",
    "verdicts": """
      SELECT p_partkey AS token_id, CASE s.ix WHEN 0 THEN 'opensea' WHEN 1 THEN 'objkt' ELSE 'fxhash' END AS source,
             CASE WHEN (p_partkey * 7 + s.ix) % 4 = 0 THEN 'spam' ELSE 'none' END AS verdict,
             {day:(p_partkey + s.ix * 3) % 40} AS last_checked_at, {day:(p_partkey * 3 + s.ix) % 80} AS next_check_at, (p_partkey + s.ix) % 5 AS consecutive_failures
      FROM part CROSS JOIN (SELECT 0 AS ix UNION ALL SELECT 1 UNION ALL SELECT 2) s WHERE (p_partkey + s.ix) % 2 = 0""",
    "attempts": """
      SELECT o_orderkey AS id, 'c' || CAST(o_custkey AS STRING_) AS address, 'eip155:1' AS chain,
             CASE WHEN o_orderkey % 7 = 0 THEN 'running' WHEN o_orderkey % 11 = 0 THEN 'paused' WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'completed' ELSE 'canceled' END AS status, {ntz:o_orderdate} AS ended_at
      FROM orders""",
    "watched": """
      SELECT 'u' || CAST(c_custkey % 150 AS STRING_) AS address, CASE WHEN c_custkey % 2 = 0 THEN 'eip155:1' ELSE 'tezos:mainnet' END AS chain,
             c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey * 10 END AS min_block,
             CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey * 10 + 500 END AS max_block, c_nationkey AS quota, c_custkey % 30 AS used,
             {day:c_custkey % 20} AS quota_reset_at
      FROM customer""",
    "metadata": """
      SELECT p_partkey AS token_id, CASE WHEN p_size % 6 = 0 THEN '' WHEN p_size % 6 = 1 THEN NULL WHEN p_size % 6 = 2 THEN ' [WAITING to be signed] ' ELSE p_name END AS name,
             'https://media.example.org/' || CAST(p_partkey % 90 AS STRING_) AS image_url,
             CASE WHEN p_size % 15 = 0 THEN 'ipfs://QmdGV3UqJqX4v5x9nFcDYeekCEAm3SDXUG5SHdjKQKn4Pe/i' WHEN p_size % 3 = 0 THEN 'https://media.example.org/a' || CAST(p_partkey % 40 AS STRING_) END AS animation_url,
             CASE WHEN p_partkey % 3 = 0 THEN 'erc721' ELSE 'fa2' END AS standard, CASE WHEN p_size % 4 = 0 THEN 'Waiting to be SIGNED by fxhash signer.' ELSE p_type END AS description, p_brand AS contract, p_type AS deployer, p_size AS size
      FROM part""",
    "overlay": """
      SELECT p_partkey AS token_id, CASE p_size % 3 WHEN 0 THEN 'artblocks' WHEN 1 THEN 'objkt' ELSE 'opensea' END AS vendor,
             CASE WHEN p_size % 2 = 0 THEN upper(p_name) END AS name,
             CASE WHEN p_size % 5 = 0 THEN 'https://vendor.example.org/' || CAST(p_partkey % 70 AS STRING_) END AS image_url,
             CASE WHEN p_size % 7 = 0 THEN 'https://vendor.example.org/a' || CAST(p_partkey % 30 AS STRING_) END AS animation_url,
             CAST(NULL AS STRING_) AS description, CASE WHEN p_size % 8 = 0 THEN p_type ELSE '' END AS artist
      FROM part WHERE p_partkey % 3 <> 0""",
    "hashes": """
      SELECT vec_id, label, {bits} AS hash FROM embeddings""",
    "wide_ledger": """
      SELECT event_id, token_id, chain, contract, event_type, from_address, to_address,
             CASE event_id % 7 WHEN 0 THEN '9223372036854775808' WHEN 1 THEN '18446744073709551615' WHEN 2 THEN '18446744073709551617'
                  WHEN 3 THEN '115792089237316195423570985008687907853269984665640564039457584007913129639935' ELSE CAST(quantity AS STRING_) END AS quantity,
             tx_hash, block_number, tx_index, ts
      FROM ledger""",
    "clients": """
      SELECT r_regionkey AS client_id, r_name AS name, CASE r_regionkey WHEN 0 THEN '*' WHEN 1 THEN 'mint' WHEN 2 THEN 'burn,transfer' WHEN 3 THEN 'transfer' ELSE 'mint' END AS filters,
             r_regionkey <> 4 AS is_active FROM region""",
}


#: Views that read another view.
BELOW = {"balances": ["holdings"], "wide_ledger": ["ledger"]}


def text(name: str, dialect: str) -> str:
    """The view's SQL in a dialect."""
    d = DIALECTS[dialect]
    sql = VIEWS[name].replace("STRING_", "STRING" if dialect == "spark" else "VARCHAR").replace("{bits}", d["bits"])
    return re.sub(r"\{(day|json|days_since|ntz):([^{}]*)\}", lambda m: d[m[1]](*(m[2].split(",") if m[1] == "json" else [m[2]])), sql)


def needs(names: list[str]) -> list[str]:
    """The views in the order in which they build on one another."""
    out: list[str] = []
    for n in names:
        for x in BELOW.get(n, []) + [n]:
            if x not in out:
                out.append(x)
    return out


def with_views(names: list[str], sql: str) -> str:
    """DuckDB SQL over the views: the views as common tables, then the query."""
    ctes = ",\n".join(f"{n} AS ({text(n, 'duckdb')})" for n in needs(names))
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    return f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"


#: What a view's tables are dealt by where they are large (`of_rows`), so that a task's memory doesn't grow with them.
DEALT = {"holdings": {"lineitem": ["l_orderkey"], "orders": ["o_orderkey"]}, "transfers": {"lineitem": ["l_orderkey"], "orders": ["o_orderkey"]}, "balances": {"holdings": ["token_id", "address"]}}

_schemas: dict[tuple[str, str], StructType] = {}
_rows: dict[tuple[str, str], int] = {}


class Views:
    """The views of one folder as DataFrames; `v.ledger` is the view, `v.table("part")` a table. Each table's files are
    listed once, however many of the views read it, and its schema is looked up once an application."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.read = spark, sf_dir.rstrip("/"), {}

    def table(self, name: str) -> DataFrame:
        if name not in self.read:
            path = f"{self.dir}/{name}.parquet"
            key = (self.spark.sparkContext.applicationId, path)
            self.read[name] = self.spark.read.schema(_schemas[key]).parquet(path) if key in _schemas else self.spark.read.parquet(path)
            _schemas[key] = self.read[name].schema
        return self.read[name]

    def rows(self, name: str) -> int:
        """The table's number of rows, from its files' footers, counted once an application."""
        key = (self.spark.sparkContext.applicationId, f"{self.dir}/{name}.parquet")
        if key not in _rows:
            _rows[key] = self.table(name).count()
        return _rows[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        sql, used = text(name, "spark"), {}
        for t in (*TABLES, "holdings", "ledger"):
            if t != name and re.search(rf"(FROM|JOIN) {t}\b", sql):
                used[f"t_{t}"] = getattr(self, t) if t in VIEWS else self.table(t)
                if t in DEALT.get(name, {}):  # all of these have a row a line item at most
                    used[f"t_{t}"] = of_rows(used[f"t_{t}"], DEALT[name][t], self.rows("lineitem"))
                sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{t_{t}}}", sql)
        return self.spark.sql(sql, **used)
