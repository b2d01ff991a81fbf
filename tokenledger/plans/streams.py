"""Streaming queries: the event table is read as a stream, and what the stream wrote is the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.views import Views
from ..streaming import jobs as J
from .registry import query
from ..session import scratch_dir
from .states import VIEWABLE, S

RAW = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
KIND = "CASE event_type WHEN 'signup' THEN 'mint' WHEN 'purchase' THEN 'transfer' WHEN 'error' THEN 'burn' ELSE 'metadata_update' END"


def event_stream(v: Views) -> DataFrame:
    s = v.spark.readStream.schema(RAW).parquet(f"{v.dir}/events.parque[t]")  # a pattern, as the table may be one file
    token = F.get_json_object("props", "$.k").cast("bigint")
    return s.select("event_id", F.col("ts").cast("timestamp").alias("at"), token.alias("token_id"), F.concat(F.lit("u"), "user_id").alias("owner"), F.expr(KIND).alias("event_type"), F.floor(F.col("event_id") / 3).cast("bigint").alias("block_number"), (F.col("event_id") % 3).alias("tx_index"), F.when(token % 4 == 3, "tezos:mainnet").otherwise("eip155:1").alias("chain"), F.floor("value").cast("bigint").alias("quantity"))


@query("STR1_ordered_ingest", "ledger", "SELECT event_id, chain, block_number FROM ledger WHERE chain <> 'eip155:1' OR block_number >= 1000")
def str1(v: Views):
    cursors = v.spark.createDataFrame([("eip155:1", 1000)], "chain string, block_number long")
    path = f"{scratch_dir(v.spark)}/ingest-{uuid.uuid4().hex}"
    return J.OrderedIngest(v.spark, path, cursors).run(event_stream(v)).select("event_id", "chain", "block_number")


@query("STR1_ordered_ingest_batches", "ledger", """
WITH m AS (SELECT max(block_number) AS last FROM ledger)
SELECT event_id, chain, block_number FROM ledger, m WHERE block_number >= last // 4""")
def str1_batches(v: Views):
    """Blocks in three batches, each run twice; the third starts below the cursor, and what is below it is dropped."""
    rows = v.ledger.select("event_id", "chain", "block_number", "tx_index")
    last = rows.agg(F.max("block_number")).first()[0] or 0
    cursors = rows.select("chain").distinct().withColumn("block_number", F.lit(last // 4).cast("long"))
    path, half = job_path(v, "ingest"), F.lit(last // 2)
    head = rows.where(F.col("block_number") <= half).groupBy("chain").agg(F.max("block_number").alias("head"))
    after = rows.where(F.col("block_number") > half)
    again = rows.join(head, "chain").where("block_number < head").drop("head")  # all below the cursor that the first batch left
    for k, part in enumerate([rows.where(F.col("block_number") <= half), again, after]):
        for _ in range(2):
            J.OrderedIngest(v.spark, path, cursors).batch(part, k)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return J.BatchTables(v.spark, path).all("events", schema).select("event_id", "chain", "block_number")


@query("STR2_event_job_dedupe", "ledger", "SELECT chain, 't' || CAST(block_number AS VARCHAR) AS tx_hash, tx_index AS log_index, event_id FROM ledger")
def str2(v: Views):
    """Every event comes twice."""
    s = event_stream(v).unionByName(event_stream(v)).select("at", "chain", F.concat(F.lit("t"), "block_number").alias("tx_hash"), F.col("tx_index").alias("log_index"), "event_id")
    return J.run_available(J.dedupe_stream(s, "at", "7 days", ["chain", "tx_hash", "log_index"]).drop("at"), "dedupe")


def job_path(v: Views, name: str) -> str:
    return f"{scratch_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


def in_runs(v: Views, rows: DataFrame, place: str, job: Callable[[DataFrame, str], DataFrame], runs: int = 3) -> DataFrame:
    """What a job, of a stream and a folder, writes in several runs of one stream: each finds the next part of rows by place, and goes on from the state
    and the checkpoint that the run before it left."""
    path, last = job_path(v, "runs"), rows.agg(F.max(place)).first()[0] or 0
    for k in range(runs):
        rows.where(F.col(place).between(k * (last // runs + 1), (k + 1) * (last // runs + 1) - 1)).write.mode("append").parquet(f"{path}/in")
        out = job(v.spark.readStream.schema(rows.schema).parquet(f"{path}/in"), path)
    return out


@query("STR3_two_feed_level_align", "ledger", """
WITH f AS (SELECT chain, block_number AS level, CASE WHEN event_type = 'metadata_update' THEN 'metadata' ELSE 'transfer' END AS feed, event_id AS id, to_address FROM ledger), h AS (
  SELECT chain, min(head) AS least FROM (SELECT chain, feed, max(level) AS head FROM f GROUP BY chain, feed) x GROUP BY chain HAVING count(*) = 2), l AS (
  SELECT f.chain, level, row_number() OVER (PARTITION BY f.chain ORDER BY level DESC) AS k FROM (SELECT DISTINCT chain, level FROM f) f JOIN h ON f.chain = h.chain WHERE level >= least)
SELECT f.chain, f.level, feed, id, CASE WHEN f.level < least THEN 'aligned' ELSE 'overflow' END AS reason
FROM f JOIN h ON f.chain = h.chain LEFT JOIN l ON f.chain = l.chain AND f.level = l.level WHERE f.level < least OR k > 2""")
def str3(v: Views):
    s = event_stream(v)
    feeds = s.select("chain", F.when(F.col("event_type") == "metadata_update", "metadata").otherwise("transfer").alias("feed"), F.col("block_number").alias("level"), F.col("event_id").alias("id"), F.col("owner").alias("payload"))
    return J.LevelAlign(v.spark, job_path(v, "align"), 2, 3_600).run(feeds).select("chain", "level", "feed", "id", "reason")


@query("STR3_level_align_batches", "ledger", """
WITH f AS (SELECT chain, block_number AS level, CASE WHEN event_type = 'metadata_update' THEN 'metadata' ELSE 'transfer' END AS feed, event_id AS id FROM ledger), n AS (SELECT max(level) // 2 AS half FROM f)
SELECT chain, level, feed, id, CASE WHEN level <= half THEN 'timeout' ELSE 'overflow' END AS reason FROM f, n
WHERE feed = 'transfer' AND (level <= half OR level < (SELECT max(level) FROM f g WHERE g.chain = f.chain AND g.feed = 'transfer'))""")
def str3_batches(v: Views):
    """Transfers of lower levels, which time out as their metadata doesn't come; transfers of higher ones, of which all but the
    highest are too many; then metadata of levels that have gone out, which is dropped. Each batch runs twice, the second time
    at another hour."""
    rows = v.ledger.select("chain", F.when(F.col("event_type") == "metadata_update", "metadata").otherwise("transfer").alias("feed"), F.col("block_number").alias("level"), F.col("event_id").alias("id"), F.lit("").alias("payload"))
    half = F.lit((v.ledger.agg(F.max("block_number")).first()[0] or 0) // 2)
    moves, none = rows.where("feed = 'transfer'"), rows.where("false")
    top = moves.groupBy("chain").agg(F.max("level").alias("top"))
    sealed = moves.join(top, "chain").where("level < top").groupBy("chain").agg(F.max("level").alias("sealed"))
    late = rows.where("feed = 'metadata'").join(sealed, "chain").where("level <= sealed").drop("sealed")
    path = job_path(v, "align")
    wide, narrow = J.LevelAlign(v.spark, path, 1 << 40, 60), J.LevelAlign(v.spark, path, 1, 60)
    for k, (job, part, now) in enumerate([(wide, moves.where(F.col("level") <= half), 0), (wide, none, 61), (narrow, moves.where(F.col("level") > half), 70), (narrow, late, 80)]):
        job.batch(part, k, now=now)
        job.batch(part, k, now=now + 3_600)
    return J.BatchTables(v.spark, path).all("released", f"{J.FEED}, reason string").select("chain", "level", "feed", "id", "reason")


@query("STR4_backfill_handoff", "ledger", "SELECT event_id AS id, block_number AS level, chain FROM ledger")
def str4(v: Views):
    """History reaches block 2000 in one feed and 1900 in the other; live rows begin at 200. Each row comes once."""
    rows = v.ledger.select("chain", F.col("event_id").alias("id"), F.col("block_number").alias("level"), "event_type")
    transfers, metadata = rows.where("event_type <> 'metadata_update' and level <= 2000").drop("event_type"), rows.where("event_type = 'metadata_update' and level <= 1900").drop("event_type")
    live = event_stream(v).where("block_number >= 200").select("chain", F.col("event_id").alias("id"), F.col("block_number").alias("level"))
    past, now = J.backfill_handoff(transfers, metadata, live)
    return past.unionByName(J.run_available(now, "live"))


@query("STR5_idle_flush", "ledger", """
WITH cut AS (SELECT max(event_id) // 2 AS half FROM ledger), f AS (SELECT max(block_number) AS block FROM ledger, cut WHERE event_id <= half AND chain = 'eip155:1'), h AS (
  SELECT max(CASE WHEN chain = 'eip155:1' THEN block_number END) AS one, max(CASE WHEN chain <> 'eip155:1' THEN block_number END) AS other FROM ledger)
SELECT chain, block_number, event_id AS id, CASE WHEN chain = 'eip155:1' THEN block_number = f.block AND event_id <= half ELSE block_number = other END AS flushed FROM ledger l, cut, f, h
WHERE chain <> 'eip155:1' OR block_number < one OR block_number = f.block AND event_id <= half""")
def str5(v: Views):
    """Half of the events; a minute later those of one chain, so that the other chain's head is flushed; then the other chain's,
    with the first one's last head, while its own is held."""
    job, half = J.IdleFlush(v.spark, job_path(v, "idle"), idle=30), F.lit((v.ledger.agg(F.max("event_id")).first()[0] or 0) // 2)
    rows = v.ledger.select("chain", "block_number", F.col("event_id").alias("id"))
    late = rows.where(F.col("id") > half)
    for k, part in enumerate([rows.where(F.col("id") <= half), late.where("chain <> 'eip155:1'"), late.where("chain = 'eip155:1'")]):
        job.batch(part, k, now=60 * k)
    return job.blocks()


@query("STR6_running_holdings", "", """
WITH l AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS token_id, 'u' || user_id AS owner, 'u' || (user_id * 7 % 150) AS sender, CAST(floor(value) AS BIGINT) AS quantity, event_type FROM events WHERE event_type IN ('signup', 'error', 'purchase')), d AS (
  SELECT token_id, owner AS address, event_id, CASE event_type WHEN 'error' THEN -quantity ELSE quantity END AS delta FROM l WHERE event_type <> 'purchase' OR owner <> sender
  UNION ALL SELECT token_id, sender, event_id, -quantity FROM l WHERE event_type = 'purchase' AND owner <> sender), r AS (
  SELECT *, sum(delta) OVER (PARTITION BY token_id, address ORDER BY event_id) AS after FROM d)
SELECT token_id, address, event_id, CAST(after AS BIGINT) AS quantity, CASE WHEN after - delta <= 0 AND after > 0 THEN 'acquired' WHEN after - delta > 0 AND after <= 0 THEN 'released' END AS kind FROM r""")
def str6(v: Views):
    """Mints, burns and transfers; the sender of a transfer is made from its receiver."""
    s = event_stream(v).where("event_type in ('mint', 'burn', 'transfer')")
    sender = F.concat(F.lit("u"), F.substring("owner", 2, 18).cast("bigint") * 7 % 150)
    sides = s.select("token_id", "event_id", F.when(F.col("event_type") == "burn", F.col("owner")).when(F.col("event_type") == "transfer", sender).alias("from_address"), F.when(F.col("event_type") != "burn", F.col("owner")).alias("to_address"), "quantity")
    return J.RunningHoldings(v.spark, job_path(v, "holdings")).run(sides)


@query("STR6_running_holdings_wide", "wide_ledger", """
WITH l AS (SELECT event_id, token_id, address, delta FROM (
  SELECT event_id, token_id, coalesce(to_address, from_address) AS address, CASE WHEN to_address IS NULL THEN -CAST(quantity AS BIGNUM) ELSE CAST(quantity AS BIGNUM) END AS delta, event_type FROM wide_ledger) x WHERE event_type IN ('mint', 'burn') AND address IS NOT NULL), r AS (
  SELECT *, sum(delta) OVER (PARTITION BY token_id, address ORDER BY event_id) AS after FROM l), b AS (
  SELECT *, after > CAST(0 AS BIGNUM) AS now, coalesce(lag(after > CAST(0 AS BIGNUM)) OVER (PARTITION BY token_id, address ORDER BY event_id), false) AS was FROM r)
SELECT token_id, address, event_id, CAST(after AS VARCHAR) AS quantity, CASE WHEN now AND NOT was THEN 'acquired' WHEN was AND NOT now THEN 'released' END AS kind FROM b""")
def str6_wide(v: Views):
    """Mints and burns with quantities of up to 256 bits."""
    rows = v.wide_ledger.where("event_type in ('mint', 'burn')").select("token_id", "event_id", "from_address", "to_address", "quantity")
    return in_runs(v, rows, "event_id", lambda s, path: J.RunningHoldings(v.spark, path).run(s))


GATES = """
WITH o AS (SELECT CAST(token_id AS VARCHAR) AS url_hash, event_id AS id, CASE event_type WHEN 'mint' THEN 'ok' WHEN 'burn' THEN 'known' WHEN 'transfer' THEN 'blank' ELSE 'none' END AS outcome FROM ledger), s AS (
  SELECT *, count(CASE WHEN outcome = 'ok' THEN 1 END) OVER (PARTITION BY url_hash ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM o), f AS (
  SELECT *, count(CASE WHEN outcome IN ('known', 'blank') THEN 1 END) OVER (PARTITION BY url_hash, run ORDER BY id) AS failures FROM s), g AS (
  SELECT url_hash, run, min(id) AS id FROM f WHERE outcome = 'known' OR (outcome = 'blank' AND failures >= 2) GROUP BY url_hash, run)
SELECT url_hash, id, 'gate' AS change FROM g UNION ALL SELECT s.url_hash, s.id, 'release' FROM s JOIN g ON s.url_hash = g.url_hash AND s.run = g.run WHERE outcome = 'ok'"""


@query("STR7_render_gate_machine", "ledger", GATES)
def str7(v: Views):
    s = event_stream(v)
    outcome = F.expr("CASE event_type WHEN 'mint' THEN 'rendered_ok' WHEN 'burn' THEN 'known_bad_fingerprint' WHEN 'transfer' THEN 'blank' ELSE 'no_evidence' END")
    seen = s.select(F.col("token_id").cast("string").alias("url_hash"), F.col("event_id").alias("id"), "at", outcome.alias("outcome"))
    return J.run_available(J.render_gates(seen, J.GateConfig()), "gates")


@query("STR7_render_gate_restarts", "ledger", GATES)
def str7_runs(v: Views):
    """The same in three runs, each from the state before."""
    outcome = F.expr("CASE event_type WHEN 'mint' THEN 'rendered_ok' WHEN 'burn' THEN 'known_bad_fingerprint' WHEN 'transfer' THEN 'blank' ELSE 'no_evidence' END")
    seen = v.ledger.select(F.col("token_id").cast("string").alias("url_hash"), F.col("event_id").alias("id"), F.col("event_id").alias("at"), outcome.alias("outcome"))
    return in_runs(v, seen, "id", lambda s, path: J.run_available(J.render_gates(s, J.GateConfig()), "runs", top=path))


@query("STR7_render_gates_batch", "ledger", GATES)
def str7_batch(v: Views):
    """The same over whole histories, without a stream."""
    outcome = F.expr("CASE event_type WHEN 'mint' THEN 'rendered_ok' WHEN 'burn' THEN 'known_bad_fingerprint' WHEN 'transfer' THEN 'blank' ELSE 'no_evidence' END")
    seen = v.ledger.select(F.col("token_id").cast("string").alias("url_hash"), F.col("event_id").alias("id"), F.col("event_id").alias("at"), outcome.alias("outcome"))
    return J.render_gates_batch(seen, J.GateConfig())


@query("STR8_change_feed_out", "ledger clients", "SELECT event_id, client_id FROM ledger, clients WHERE is_active AND (filters = '*' OR list_contains(string_split(filters, ','), event_type))")
def str8(v: Views):
    clients = v.clients.withColumn("filters", F.split("filters", ","))
    return J.run_available(J.change_feed(event_stream(v).select("event_id", "event_type"), clients).select("event_id", "client_id"), "feed")


@query("STR8_viewability_feed", "media probes token_dim clients", f"WITH {VIEWABLE} SELECT client_id, token_id FROM c, clients WHERE was <> is_viewable AND is_active AND filters = '*'")
def str8_batch(v: Views):
    """Viewability changes, as they are found in media and probes, to the clients that ask for them."""
    clients = v.clients.withColumn("filters", F.split("filters", ","))
    changes = S.change_rows(S.viewability(v.token_dim, v.media, v.probes), "viewability_changed", F.col("is_viewable").cast("string"), F.expr("TIMESTAMP_NTZ'2020-02-10 00:00:00'"))
    return J.change_feed(changes, clients).select("client_id", "token_id")
