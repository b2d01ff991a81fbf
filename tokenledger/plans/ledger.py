"""Queries on holdings, owners and the order of events."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.values import size_order
from ..operators import events as E
from ..operators import holdings as H
from ..sources.views import Views
from .decoding import WIDE_QUANTITY, wide_logs
from .registry import query

ORDER = ["block_number", "tx_index", "event_id"]
BY_TX = ["block_number", "tx_index", "log_index", "supp", "price", "quantity"]
DELTAS = """d AS (
  SELECT token_id, from_address AS address, -quantity AS delta, block_number FROM ledger WHERE event_type <> 'metadata_update' AND from_address IS NOT NULL
  UNION ALL SELECT token_id, to_address, quantity, block_number FROM ledger WHERE event_type <> 'metadata_update' AND to_address IS NOT NULL)"""


@query("AGG1_replay_balances", "transfers", """
WITH d AS (SELECT token_id, from_address AS address, -quantity AS delta FROM transfers UNION ALL SELECT token_id, to_address, quantity FROM transfers)
SELECT token_id, address, CAST(sum(delta) AS BIGINT) AS quantity FROM d GROUP BY token_id, address HAVING sum(delta) > 0""")
def agg1(v: Views):
    return H.replay_balances(v.transfers.withColumn("event_type", F.lit("transfer")), v.rows("lineitem"))


@query("AGG2_owner_balance", "ledger", f"WITH {DELTAS} SELECT token_id, CAST(greatest(sum(delta), 0) AS BIGINT) AS quantity FROM d WHERE address = 'u7' GROUP BY token_id")
def agg2(v: Views):
    return H.owner_balance(v.ledger, "u7")


def wide(sql: str) -> str:
    """SQL on the ledger as SQL on the ledger whose quantities are decimal text of up to 256 bits."""
    sql = re.sub(r"\bledger\b", "wide_ledger", sql).replace("-quantity AS delta", "-CAST(quantity AS BIGNUM) AS delta").replace("to_address, quantity", "to_address, CAST(quantity AS BIGNUM)")
    return re.sub(r"CAST\(((?:greatest|sum)\(.*?\)+?) AS BIGINT\) AS (quantity|q)\b", r"CAST(\1 AS VARCHAR) AS \2", sql)


ZERO = "CAST(0 AS BIGNUM)"


@query("AGG1_replay_balances_wide", "wide_ledger", f"WITH {wide(DELTAS)} SELECT token_id, address, CAST(sum(delta) AS VARCHAR) AS quantity FROM d GROUP BY token_id, address HAVING sum(delta) > {ZERO}")
def agg1_wide(v: Views):
    """Quantities of 2^63, 2^64 - 1, 2^64 + 1 and 2^256 - 1 among small ones; so in all queries named wide."""
    return H.replay_balances(v.wide_ledger)


@query("AGG1_replay_decoded_wide", "transfers", f"""
WITH q AS (SELECT token_id, from_address, to_address, {WIDE_QUANTITY} AS quantity FROM transfers), d AS (
  SELECT token_id, from_address AS address, -CAST(quantity AS BIGNUM) AS delta FROM q UNION ALL SELECT token_id, to_address, CAST(quantity AS BIGNUM) FROM q)
SELECT CAST(token_id AS VARCHAR) AS token_id, '0x00000000' || substr(md5(address), 1, 32) AS address, CAST(sum(delta) AS VARCHAR) AS quantity FROM d GROUP BY token_id, d.address HAVING sum(delta) > {ZERO}""")
def agg1_decoded(v: Views):
    """Balances replayed from raw logs, whose words hold numbers of up to 256 bits."""
    return H.replay_balances(E.decode_1155_single(wide_logs(v), text=False).withColumnRenamed("token_number", "token_id"), v.rows("lineitem"))


@query("AGG2_owner_balance_wide", "wide_ledger", f"WITH {wide(DELTAS)} SELECT token_id, CAST(greatest(sum(delta), {ZERO}) AS VARCHAR) AS quantity FROM d WHERE address = 'u7' GROUP BY token_id")
def agg2_wide(v: Views):
    return H.owner_balance(v.wide_ledger, "u7")


@query("AGG3_token_owner", "ledger", """
SELECT token_id, arg_max(coalesce(to_address, ''), event_id) AS owner, arg_max(event_type, event_id) = 'burn' AS burned FROM ledger WHERE event_type <> 'metadata_update' GROUP BY token_id""")
def agg3(v: Views):
    return H.last_owner(v.ledger, ORDER).withColumn("owner", F.coalesce("owner", F.lit("")))


# Tokens of one chain are fa2; contract k4 is configured as erc1155, the other even ones are erc721.
STANDARD = "CASE WHEN token_id % 4 = 3 THEN 'fa2' WHEN token_id % 2 = 0 THEN 'erc721' ELSE 'erc1155' END"
MODEL = f"CASE WHEN contract = 'k4' THEN 'erc1155' ELSE {STANDARD} END"


def with_standards(v: Views, wide: bool = False):
    return (v.wide_ledger if wide else v.ledger).withColumn("standard", F.expr(STANDARD))


@query("AGG4_owned_tokens", "ledger", f"""
WITH m AS (SELECT *, {MODEL} AS standard FROM ledger WHERE event_type <> 'metadata_update' AND (from_address = 'u7' OR to_address = 'u7')), s AS (
  SELECT token_id, arg_max(coalesce(to_address = 'u7', false), event_id) AS held, arg_max(block_number, event_id) AS last_block FROM m WHERE standard = 'erc721' GROUP BY token_id), n AS (
  SELECT token_id, sum(CASE WHEN to_address = 'u7' THEN quantity ELSE 0 END - CASE WHEN from_address = 'u7' THEN quantity ELSE 0 END) AS quantity, max(block_number) AS last_block FROM m WHERE standard <> 'erc721' GROUP BY token_id)
SELECT token_id, CAST(1 AS BIGINT) AS quantity, last_block FROM s WHERE held UNION ALL SELECT token_id, CAST(quantity AS BIGINT), last_block FROM n WHERE quantity > 0""")
def agg4(v: Views):
    configured = v.ledger.where("contract = 'k4'").select(F.upper("contract").alias("contract"), F.lit("erc1155").alias("standard")).distinct()
    return H.owned_tokens(with_standards(v), "u7", ORDER, configured)


@query("AGG4_owned_tokens_wide", "wide_ledger", f"""
WITH m AS (SELECT *, {MODEL} AS standard FROM wide_ledger WHERE event_type <> 'metadata_update' AND (from_address = 'u7' OR to_address = 'u7')), s AS (
  SELECT token_id, arg_max(coalesce(to_address = 'u7', false), event_id) AS held, arg_max(block_number, event_id) AS last_block FROM m WHERE standard = 'erc721' GROUP BY token_id), n AS (
  SELECT token_id, sum(CASE WHEN to_address = 'u7' THEN CAST(quantity AS BIGNUM) ELSE {ZERO} END) - sum(CASE WHEN from_address = 'u7' THEN CAST(quantity AS BIGNUM) ELSE {ZERO} END) AS quantity, max(block_number) AS last_block FROM m WHERE standard <> 'erc721' GROUP BY token_id)
SELECT token_id, '1' AS quantity, last_block FROM s WHERE held UNION ALL SELECT token_id, CAST(quantity AS VARCHAR), last_block FROM n WHERE quantity > {ZERO}""")
def agg4_wide(v: Views):
    configured = v.ledger.where("contract = 'k4'").select(F.upper("contract").alias("contract"), F.lit("erc1155").alias("standard")).distinct()
    return H.owned_tokens(with_standards(v, wide=True), "u7", ORDER, configured)


STATE = f"""{DELTAS}, b AS (SELECT token_id, address, sum(delta) AS q FROM d GROUP BY token_id, address), k AS (
  SELECT token_id, count(CASE WHEN q > 0 THEN 1 END) AS n, CAST(sum(CASE WHEN q > 0 THEN q ELSE 0 END) AS BIGINT) AS q FROM b GROUP BY token_id), o AS (
  SELECT token_id, {STANDARD} AS standard, arg_max(coalesce(to_address, ''), event_id) AS receiver, arg_max(event_type, event_id) = 'burn' AS gone FROM ledger WHERE event_type <> 'metadata_update' GROUP BY token_id), s AS (
  SELECT token_id, CASE WHEN standard = 'erc721' AND NOT gone THEN receiver END AS owner, CASE WHEN standard = 'erc721' THEN gone ELSE coalesce(n, 0) = 0 END AS burned,
         CASE WHEN standard = 'erc721' THEN CASE WHEN gone THEN 0 ELSE 1 END ELSE coalesce(n, 0) END AS holders, CASE WHEN standard = 'erc721' THEN CASE WHEN gone THEN 0 ELSE 1 END ELSE coalesce(q, 0) END AS held
  FROM o LEFT JOIN k USING (token_id))"""


@query("AGG5_burned_flag", "ledger", f"WITH {STATE} SELECT token_id, burned FROM s")
def agg5(v: Views):
    return H.token_state(with_standards(v), ORDER).select("token_id", "burned")


@query("AGG6_token_state_build", "ledger", f"""
WITH {STATE}, e AS (SELECT token_id, count(*) AS events, max(ts) AS last_provenance_timestamp FROM ledger GROUP BY token_id)
SELECT token_id, owner, burned, CAST(holders AS BIGINT) AS holders, CAST(held AS BIGINT) AS held, events, last_provenance_timestamp FROM s JOIN e USING (token_id)""")
def agg6(v: Views):
    """Every token's owner, burned flag, holders, quantity held and last event, from its whole log."""
    ev = with_standards(v)
    seen = ev.groupBy("token_id").agg(F.count("*").alias("events"), F.max("ts").alias("last_provenance_timestamp"))
    return H.token_state(ev, ORDER).join(seen, "token_id")


WIDE_STATE = f"""{wide(DELTAS)}, b AS (SELECT token_id, address, sum(delta) AS q FROM d GROUP BY token_id, address), k AS (
  SELECT token_id, count(*) AS n, CAST(sum(q) AS VARCHAR) AS q FROM b WHERE q > {ZERO} GROUP BY token_id), o AS (
  SELECT token_id, {STANDARD} AS standard, arg_max(coalesce(to_address, ''), event_id) AS receiver, arg_max(event_type, event_id) = 'burn' AS gone FROM wide_ledger WHERE event_type <> 'metadata_update' GROUP BY token_id), s AS (
  SELECT token_id, CASE WHEN standard = 'erc721' AND NOT gone THEN receiver END AS owner, CASE WHEN standard = 'erc721' THEN gone ELSE n IS NULL END AS burned,
         CASE WHEN standard = 'erc721' THEN CASE WHEN gone THEN 0 ELSE 1 END ELSE coalesce(n, 0) END AS holders, CASE WHEN standard = 'erc721' THEN CASE WHEN gone THEN '0' ELSE '1' END ELSE coalesce(q, '0') END AS held
  FROM o LEFT JOIN k USING (token_id))"""


@query("AGG5_burned_flag_wide", "wide_ledger", f"WITH {WIDE_STATE} SELECT token_id, burned FROM s")
def agg5_wide(v: Views):
    return H.token_state(with_standards(v, wide=True), ORDER).select("token_id", "burned")


@query("AGG6_token_state_wide", "wide_ledger", f"WITH {WIDE_STATE} SELECT token_id, owner, burned, CAST(holders AS BIGINT) AS holders, held FROM s")
def agg6_wide(v: Views):
    return H.token_state(with_standards(v, wide=True), ORDER)


@query("AGG7_last_provenance_time", "ledger", "SELECT token_id, max(ts) AS last_provenance_timestamp FROM ledger GROUP BY token_id")
def agg7(v: Views):
    return H.last_provenance(v.ledger)


@query("AGG8_ownership_provenance", "ledger", f"""
WITH {DELTAS}, b AS (SELECT token_id, address FROM d GROUP BY token_id, address HAVING sum(delta) > 0), r AS (
  SELECT token_id, to_address, ts, tx_index, event_type, row_number() OVER (PARTITION BY token_id, to_address ORDER BY event_id DESC) AS k FROM ledger WHERE to_address IS NOT NULL)
SELECT r.token_id, to_address AS owner_address, ts AS last_timestamp, tx_index AS last_tx_index, event_type AS last_event_type FROM r JOIN b ON r.token_id = b.token_id AND b.address = to_address WHERE k = 1""")
def agg8(v: Views):
    return H.ownership_provenance(v.ledger, H.replay_balances(v.ledger).withColumnRenamed("address", "owner_address"), ORDER)


@query("AGG9_owner_token_counts", "token_dim ledger", f"""
WITH {DELTAS}, o AS (SELECT token_id, address AS owner FROM d GROUP BY token_id, address HAVING sum(delta) > 0 UNION SELECT token_id, current_owner FROM token_dim)
SELECT owner, count(*) AS total, count(CASE WHEN is_viewable THEN 1 END) AS viewable FROM o JOIN token_dim USING (token_id) GROUP BY owner""")
def agg9(v: Views):
    return H.token_counts(v.token_dim, H.replay_balances(v.ledger).withColumnRenamed("address", "owner_address"))


@query("AGG10_owner_token_cids", "balances token_dim", "SELECT DISTINCT chain || ':' || standard || ':' || contract || ':' || number AS cid FROM balances JOIN token_dim USING (token_id) WHERE owner_address = 'c7' AND quantity > 0")
def agg10(v: Views):
    held = H.replay_balances(v.holdings.select("token_id", F.lit(None).cast("string").alias("from_address"), F.col("address").alias("to_address"), F.col("delta").alias("quantity"), F.lit("transfer").alias("event_type")).where("to_address = 'c7'"))
    return held.join(v.token_dim, "token_id").select(F.concat_ws(":", "chain", "standard", "contract", "number").alias("cid")).distinct()


@query("AGG11_group_counts", "balances", """
SELECT token_id, owner_address, quantity, total FROM (
  SELECT *, count(*) OVER (PARTITION BY token_id) AS total, row_number() OVER (PARTITION BY token_id ORDER BY owner_address) AS k FROM balances) x WHERE k <= 2""")
def agg11(v: Views):
    return H.group_counts(v.balances, "token_id", [F.col("owner_address")], 2).select("token_id", "owner_address", "quantity", "total")


@query("AGG15_failure_streak", "attempts", """
WITH a AS (SELECT * FROM attempts WHERE status IN ('completed', 'failed', 'canceled')), r AS (SELECT address, max(CASE WHEN status <> 'failed' THEN id END) AS reset FROM a GROUP BY address)
SELECT a.chain, a.address, arg_max(status, id) AS status, arg_max(ended_at, id) AS ended_at, count(CASE WHEN status = 'failed' AND id > coalesce(reset, -1) THEN 1 END) AS streak
FROM a JOIN r USING (address) GROUP BY a.chain, a.address""")
def agg15(v: Views):
    return H.failure_streak(v.attempts)


@query("QRY14_retry_at", "attempts", """
WITH a AS (SELECT * FROM attempts WHERE status IN ('completed', 'failed', 'canceled')), r AS (SELECT address, max(CASE WHEN status <> 'failed' THEN id END) AS reset FROM a GROUP BY address), s AS (
SELECT a.address, arg_max(status, id) AS status, count(CASE WHEN status = 'failed' AND id > coalesce(reset, -1) THEN 1 END) AS streak FROM a JOIN r USING (address) GROUP BY a.address)
SELECT address, status, streak, CAST(CASE status WHEN 'completed' THEN 300 WHEN 'failed' THEN least(3600, 60 * power(2, least(greatest(streak - 1, 0), 30))) ELSE 0 END AS BIGINT) AS wait_seconds FROM s""")
def qry14(v: Views):
    return H.retry_at(H.failure_streak(v.attempts), 300, 60, 3600).select("address", "status", "streak", "wait_seconds")


@query("AGG16_scan_chunk_info", "ledger", "SELECT to_address AS owner, min(block_number) AS min_block, max(block_number) AS max_block, array_to_string(list_sort(list(token_id)), ',') AS tokens FROM ledger WHERE to_address IS NOT NULL GROUP BY to_address")
def agg16(v: Views):
    rows = v.ledger.where("to_address is not null").select(F.col("to_address").alias("owner"), F.col("block_number").alias("block"), "token_id")
    return H.chunk_info(rows, "owner").withColumn("tokens", F.array_join(F.col("tokens").cast("array<string>"), ","))


@query("WIN1_dedupe_logs", "transfers", "SELECT block_number, tx_index, log_index, count(*) AS n FROM (SELECT DISTINCT block_number, tx_index, log_index FROM transfers) t GROUP BY ALL")
def win1(v: Views):
    return H.dedupe_logs(v.transfers).groupBy("block_number", "tx_index", "log_index").agg(F.count("*").alias("n"))


FIRST = "tx_hash, token_id, coalesce(from_address, ''), coalesce(to_address, ''), event_type"


@query("WIN2_dedupe_ownership_events", "ledger", f"""
WITH x AS (SELECT event_id, block_number AS tx_hash, token_id, from_address, to_address, event_type FROM ledger), r AS (
  SELECT *, row_number() OVER (PARTITION BY {FIRST} ORDER BY event_id) AS k FROM x)
SELECT event_id, token_id, event_type FROM r WHERE k = 1 OR event_type = 'metadata_update'""")
def win2(v: Views):
    return H.dedupe_ownership(v.ledger.withColumn("tx_hash", F.col("block_number")), [F.col("event_id")]).select("event_id", "token_id", "event_type")


@query("WIN3_unique_provenance", "ledger", f"""
WITH x AS (SELECT event_id, floor(event_id / 300) AS tx_hash, token_id % 5 AS token_id, 'u' || (event_id % 2) AS from_address, CASE WHEN event_id % 3 > 0 THEN 'u9' END AS to_address, event_type FROM ledger), r AS (
  SELECT *, row_number() OVER (PARTITION BY {FIRST} ORDER BY event_id) AS k FROM x)
SELECT event_id, token_id, event_type FROM r WHERE k = 1 OR from_address IS NULL OR to_address IS NULL""")
def win3(v: Views):
    rows = v.ledger.select("event_id", F.floor(F.col("event_id") / 300).alias("tx_hash"), (F.col("token_id") % 5).alias("token_id"), F.concat(F.lit("u"), F.col("event_id") % 2).alias("from_address"), F.when(F.col("event_id") % 3 > 0, "u9").alias("to_address"), "event_type")
    return H.unique_provenance(rows, [F.col("event_id")]).select("event_id", "token_id", "event_type")


@query("WIN4_latest_per_key", "ledger", "SELECT event_id, token_id, to_address FROM (SELECT *, row_number() OVER (PARTITION BY token_id, to_address ORDER BY ts DESC, tx_index DESC, event_id DESC) AS k FROM ledger WHERE to_address IS NOT NULL) x WHERE k = 1")
def win4(v: Views):
    return H.latest_per_key(v.ledger.where("to_address is not null"), [F.desc("ts"), F.desc("tx_index"), F.desc("event_id")], multi=True).select("event_id", "token_id", "to_address")


TIMELINE = "t AS (SELECT * FROM (SELECT token_id, to_address AS owner, ts AS acquired_at, lead(ts) OVER (PARTITION BY token_id ORDER BY event_id) AS released_at FROM ledger WHERE event_type <> 'metadata_update') x WHERE owner IS NOT NULL)"


@query("WIN5_ownership_timeline", "ledger", f"WITH {TIMELINE} SELECT token_id, owner, acquired_at, released_at FROM t")
def win5(v: Views):
    return H.ownership_timeline(v.ledger, [F.col("event_id")])


@query("WIN5_owner_as_of", "ledger", f"WITH {TIMELINE}, q AS (SELECT token_id, ts AS asked FROM ledger WHERE event_type = 'metadata_update') SELECT q.token_id, asked AS \"at\", owner FROM q LEFT JOIN t ON q.token_id = t.token_id AND asked >= acquired_at AND (released_at IS NULL OR asked < released_at)")
def win5_as_of(v: Views):
    times = v.ledger.where("event_type = 'metadata_update'").select("token_id", F.col("ts").alias("at"))
    return H.owner_as_of(H.ownership_timeline(v.ledger, [F.col("event_id")]), times)


@query("WIN7_topn_owners", "balances", "SELECT token_id, owner_address, quantity, total FROM (SELECT *, count(*) OVER (PARTITION BY token_id) AS total, row_number() OVER (PARTITION BY token_id ORDER BY quantity DESC, owner_address) AS k FROM balances) x WHERE k <= 3")
def win7(v: Views):
    return H.group_counts(v.balances, "token_id", [F.desc("quantity"), F.col("owner_address")], 3).select("token_id", "owner_address", "quantity", "total")


@query("WIN8_topn_provenance", "ledger", "SELECT token_id, event_id, total FROM (SELECT *, count(*) OVER (PARTITION BY token_id) AS total, row_number() OVER (PARTITION BY token_id ORDER BY ts DESC NULLS FIRST, tx_index DESC NULLS FIRST, event_id DESC) AS k FROM ledger) x WHERE k <= 5")
def win8(v: Views):
    return H.group_counts(v.ledger, "token_id", [F.desc_nulls_first("ts"), F.desc_nulls_first("tx_index"), F.desc("event_id")], 5).select("token_id", "event_id", "total")


PROVENANCE = "op AS (SELECT token_id, to_address AS owner_address, max(event_id) AS id, max(ts) AS last_timestamp, arg_max(tx_index, event_id) AS last_tx_index FROM ledger WHERE to_address IS NOT NULL GROUP BY token_id, to_address)"


def provenance_rows(v: Views):
    return v.ledger.where("to_address is not null").groupBy("token_id", F.col("to_address").alias("owner_address")).agg(F.max("event_id").alias("id"), F.max("ts").alias("last_timestamp"), F.max_by("tx_index", "event_id").alias("last_tx_index"))


@query("WIN9_topn_owner_provenance", "ledger", f"WITH {PROVENANCE} SELECT token_id, owner_address, id, total FROM (SELECT *, count(*) OVER (PARTITION BY token_id) AS total, row_number() OVER (PARTITION BY token_id ORDER BY last_timestamp DESC, id DESC) AS k FROM op) x WHERE k <= 4")
def win9(v: Views):
    return H.group_counts(provenance_rows(v), "token_id", [F.desc("last_timestamp"), F.desc("id")], 4).select("token_id", "owner_address", "id", "total")


@query("WIN10_latest_for_owners", "ledger", f"WITH {PROVENANCE} SELECT token_id, arg_max(owner_address, id) AS owner_address, max(last_timestamp) AS last_timestamp FROM op WHERE owner_address IN ('u1', 'u2', 'u3', 'u5', 'u8') GROUP BY token_id")
def win10(v: Views):
    rows = provenance_rows(v).where(F.col("owner_address").isin("u1", "u2", "u3", "u5", "u8"))
    return H.first_per_key(rows, ["token_id"], [F.desc("last_timestamp"), F.desc("id")]).select("token_id", "owner_address", "last_timestamp")


BLOCKS = "b AS (SELECT to_address AS owner, block_number AS block, count(*) AS n FROM ledger WHERE to_address IS NOT NULL GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY owner ORDER BY block) AS upto FROM b)"


def received(v: Views):
    return v.ledger.where("to_address is not null").select(F.col("to_address").alias("owner"), F.col("block_number").alias("block"), "token_id")


@query("WIN11_block_aligned_batches", "ledger", f"""
WITH RECURSIVE {BLOCKS}, r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY block) AS k FROM c), w AS (
  SELECT owner, block, n, k, CAST(0 AS BIGINT) AS batch, n AS held FROM r WHERE k = 1
  UNION ALL
  SELECT r.owner, r.block, r.n, r.k, CASE WHEN w.held >= CASE WHEN w.batch = 0 THEN 3 ELSE 7 END THEN w.batch + 1 ELSE w.batch END,
         CASE WHEN w.held >= CASE WHEN w.batch = 0 THEN 3 ELSE 7 END THEN r.n ELSE w.held + r.n END
  FROM w JOIN r ON r.owner = w.owner AND r.k = w.k + 1)
SELECT owner, block, n, batch FROM w""")
def win11(v: Views):
    return H.block_batches(received(v), 3, 7)


@query("WIN12_quota_cut", "ledger", f"WITH {BLOCKS} SELECT owner, max(block) AS last_block, CAST(max(upto) AS BIGINT) AS tokens FROM (SELECT *, CAST(substr(owner, 2) AS BIGINT) % 20 AS quota FROM c) x WHERE quota > 0 AND (upto <= quota OR upto = n) GROUP BY owner")
def win12(v: Views):
    rows = received(v)
    quota = rows.select("owner").distinct().withColumn("quota", F.expr("cast(substr(owner, 2) as bigint) % 20"))
    return H.quota_cut(rows, quota)


def replayed(way: str) -> str:
    """Held sets by the running state of each token and owner, read one way."""
    cut = "min" if way == "ASC" else "max"
    state = "to_me" if way == "ASC" else "first_value(to_me) OVER w"
    lo, hi = ("lo", "coalesce(cut, hi)") if way == "ASC" else ("coalesce(cut, lo)", "hi")
    return f"""
WITH d AS (
  SELECT token_id, {STANDARD} AS standard, from_address AS address, -quantity AS delta, 0 AS to_me, block_number, event_id * 2 AS event_id FROM ledger WHERE event_type <> 'metadata_update' AND from_address IS NOT NULL
  UNION ALL SELECT token_id, {STANDARD}, to_address, quantity, 1, block_number, event_id * 2 + 1 FROM ledger WHERE event_type <> 'metadata_update' AND to_address IS NOT NULL), g AS (
  SELECT address, token_id, standard, block_number, sum(delta) AS delta, arg_max(to_me, event_id) AS to_me FROM d GROUP BY ALL), a AS (
  SELECT *, CASE WHEN standard = 'erc721' THEN {state} = 1 ELSE sum(delta) OVER w > 0 END AS held FROM g WINDOW w AS (PARTITION BY address, token_id ORDER BY block_number {way} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), c AS (
  SELECT *, CAST(held AS INTEGER) - coalesce(CAST(lag(held) OVER (PARTITION BY address, token_id ORDER BY block_number {way}) AS INTEGER), 0) AS change FROM a), p AS (
  SELECT address, block_number, sum(change) AS change FROM c GROUP BY ALL), h AS (
  SELECT address, block_number, sum(change) OVER (PARTITION BY address ORDER BY block_number {way}) AS n, lead(block_number) OVER (PARTITION BY address ORDER BY block_number {way}) AS more FROM p), k AS (
  SELECT address, {cut}(CASE WHEN n >= 4 AND more IS NOT NULL THEN block_number END) AS cut, min(block_number) AS lo, max(block_number) AS hi FROM h GROUP BY address), r AS (
  SELECT address, {lo} AS from_block, {hi} AS to_block FROM k), s AS (
  SELECT c.address AS owner, token_id, last(held ORDER BY block_number {way}) AS held, max(block_number) AS last_block, from_block, to_block FROM c JOIN r ON c.address = r.address AND block_number BETWEEN from_block AND to_block GROUP BY ALL)
SELECT owner, token_id, last_block, from_block, to_block FROM s WHERE held"""


@query("WIN13_replay_with_limit", "ledger", replayed("ASC"))
def win13(v: Views):
    return H.replay_with_limit(with_standards(v), 4)


@query("WIN13_replay_newest_first", "ledger", replayed("DESC"))
def win13_newest(v: Views):
    return H.replay_with_limit(with_standards(v), 4, descending=True)


@query("WIN13_replay_wide", "wide_ledger", wide(replayed("ASC")).replace("sum(delta) OVER w > 0", f"sum(delta) OVER w > {ZERO}"))
def win13_wide(v: Views):
    return H.replay_with_limit(with_standards(v, wide=True), 4)


@query("WIN7_topn_owners_wide", "wide_ledger", f"""
WITH {wide(DELTAS)}, b AS (SELECT token_id, address AS owner_address, sum(delta) AS quantity FROM d GROUP BY token_id, address HAVING sum(delta) > {ZERO})
SELECT token_id, owner_address, CAST(quantity AS VARCHAR) AS quantity, total FROM (
  SELECT *, count(*) OVER (PARTITION BY token_id) AS total, row_number() OVER (PARTITION BY token_id ORDER BY quantity DESC, owner_address) AS k FROM b) x WHERE k <= 3""")
def win7_wide(v: Views):
    b = H.replay_balances(v.wide_ledger).withColumnRenamed("address", "owner_address")
    return H.group_counts(b, "token_id", [F.desc(size_order(b, "quantity")), F.col("owner_address")], 3).select("token_id", "owner_address", "quantity", "total")


@query("WIN14_scan_windows", "watched", "SELECT id, lo, least(lo + 199, max_block) AS hi FROM (SELECT id, max_block, unnest(range(min_block, max_block + 1, 200)) AS lo FROM watched WHERE min_block IS NOT NULL) x")
def win14(v: Views):
    return H.scan_windows(v.watched.where("min_block is not null"), 200).select("id", "lo", "hi")
