"""Operators on small fixtures, and properties of replays."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tokenledger.functions import uris, values
from tokenledger.operators import events as E
from tokenledger.operators import holdings as H
from tokenledger.operators import selection, sinks
from tokenledger.operators import state as S
from tokenledger.plans.tokens import TokenQuery
from tokenledger.sources import tables as T
from tokenledger.streaming import jobs as J

EVENT = "event_id long, token_id long, event_type string, from_address string, to_address string, quantity long, tx_hash string, block_number long, tx_index long, ts timestamp_ntz"


def log(spark, *rows):
    at = dt.datetime(2024, 1, 1)
    kind = lambda a, b: "mint" if a is None else "burn" if b is None else "transfer"
    return spark.createDataFrame([(i, t, kind(a, b), a, b, q, f"t{i}", i // 2, i % 2, at + dt.timedelta(hours=i)) for i, (t, a, b, q) in enumerate(rows)], EVENT)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_replay_conserves_supply(spark):
    ev = log(spark, (1, None, "a", 5), (1, "a", "b", 2), (2, None, "b", 1), (1, "b", None, 1), (2, "b", "a", 1))
    assert found(H.replay_balances(ev)) == [(1, "a", 3), (1, "b", 1), (2, "a", 1)]
    minted = ev.where("event_type = 'mint'").agg(F.sum("quantity")).first()[0] - ev.where("event_type = 'burn'").agg(F.sum("quantity")).first()[0]
    assert H.replay_balances(ev).agg(F.sum("quantity")).first()[0] == minted
    assert found(H.owner_balance(ev, "b")) == [(1, 1), (2, 0)]
    assert found(H.last_owner(ev, ["block_number", "tx_index"]).select("token_id", "owner", "burned")) == [(1, None, True), (2, "a", False)]


ORDER = ["block_number", "tx_index", "event_id"]


@pytest.mark.parametrize("standard", ["erc721", "erc1155"])
def test_replay_with_a_high_limit_keeps_all(spark, standard):
    ev = log(spark, (1, None, "a", 1), (1, "a", "b", 1), (1, "b", "a", 1), (2, None, "a", 1), (3, None, "a", 1)).withColumn("standard", F.lit(standard))
    owned = found(H.owned_tokens(ev, "a", ORDER).select("token_id"))
    assert [x for x in found(H.replay_with_limit(ev, 1000).select("token_id", "owner")) if x[1] == "a"] == [(t, "a") for (t,) in owned] and len(owned) == 3
    cut = [tuple(r) for r in H.replay_with_limit(ev, 2).collect() if r.owner == "a"]
    assert sorted(cut) == [("a", 1, 1, 0, 1), ("a", 2, 1, 0, 1)]  # both events of block 1 are in


def plain_replay(rows, owner, limit, descending):
    """The log read one event after the other: (held tokens, from_block, to_block)."""
    own = sorted(((b, i, t, s, f == owner, to == owner, q) for i, (t, s, f, to, q, b) in enumerate(rows) if owner in (f, to)), reverse=descending)
    state, net, newest = {}, {}, {}
    lo, hi = min(x[0] for x in own), max(x[0] for x in own)
    for k, (b, i, t, s, gone, come, q) in enumerate(own):
        if s == "erc721":
            if t not in newest or (b, i) > newest[t]:
                newest[t] = (b, i)
                state[t] = come
        else:
            net[t] = net.get(t, 0) + q * (come - gone)
            state[t] = net[t] > 0
        ends = k + 1 == len(own) or own[k + 1][0] != b
        if ends and sum(state.values()) >= limit and k + 1 < len(own):
            lo, hi = (b, hi) if descending else (lo, b)
            break
    return {t for t, held in state.items() if held}, lo, hi


@pytest.mark.parametrize("descending", [False, True])
def test_replay_against_a_loop(spark, descending):
    import random

    r = random.Random(11)
    rows = []
    for i in range(160):
        t = r.randrange(12)
        a, b = r.sample(["a", "b", "c", None], 2)
        rows.append((t, "erc721" if t % 2 else "erc1155", a, b, r.choice([0, 1, 2]), i // 3))
    ev = spark.createDataFrame([(i, t, "transfer", a, b, q, f"t{i}", blk, i % 3, None, s) for i, (t, s, a, b, q, blk) in enumerate(rows)], EVENT + ", standard string")
    for limit in (1, 3, 5, 50):
        got = H.replay_with_limit(ev, limit, descending).collect()
        for owner in "abc":
            tokens, lo, hi = plain_replay(rows, owner, limit, descending)
            assert {x.token_id for x in got if x.owner == owner} == tokens
            assert {(x.from_block, x.to_block) for x in got if x.owner == owner} <= {(lo, hi)}


def test_ownership_models(spark):
    ev = log(spark, (1, None, "a", 5), (1, "a", "b", 1), (2, None, "a", 5), (2, "a", "b", 1), (3, None, "a", 1), (3, "a", None, 1), (4, None, "a", 1), (4, "a", None, 1))
    ev = ev.withColumn("standard", F.when(F.col("token_id") % 2 == 1, "erc721").otherwise("fa2")).withColumn("contract", F.concat(F.lit("K"), "token_id"))
    assert found(H.owned_tokens(ev, "a", ORDER).select("token_id", "quantity")) == [(2, 4)]
    configured = spark.createDataFrame([("k1", "erc1155")], "contract string, standard string")
    assert found(H.owned_tokens(ev, "a", ORDER, configured).select("token_id", "quantity")) == [(1, 4), (2, 4)]
    assert found(H.token_state(ev, ORDER)) == [(1, "b", False, 1, 1), (2, None, False, 2, 5), (3, None, True, 0, 0), (4, None, True, 0, 0)]


def test_batch_offsets_beyond_the_data_are_left_out(spark):
    word = lambda n: f"{n:064x}"
    body = [word(2), word(7), word(9), word(2), word(1), word(1)]
    rows = [(i, ["0x" + "0" * 64] * 4, "0x" + word(a) + word(b) + "".join(body)) for i, (a, b) in enumerate([(64, 160), (2**64 + 64, 160), (64, 161), (64, 2**200), (2**59, 160), (64, 32 * 8)])]
    df = spark.createDataFrame(rows, "log_index long, topics array<string>, data string").withColumn("topics", F.array(F.lit(E.TRANSFER_BATCH), F.lit("0x" + "0" * 64), F.lit("0x" + "0" * 64), F.lit("0x" + "1" * 64)))
    df = df.withColumns({"address": F.lit("0xab"), "block_number": F.lit(1), "tx_hash": F.lit("t"), "tx_index": F.lit(1), "block_time": F.lit(None).cast("timestamp")})
    assert found(E.decode_1155_batch(df).select("log_index", "token_number", "quantity")) == [(0, "7", "1"), (0, "9", "1")]


def test_feed_alternates_and_timeline(spark):
    ev = log(spark, (1, None, "a", 1), (1, "a", "b", 1), (1, "b", "a", 1), (1, "a", None, 1))
    feed = found(S.feed_721(ev, ["block_number", "tx_index"]).select("owner", "event_id", "kind"))
    assert feed == [("a", 0, "acquired"), ("a", 1, "released"), ("a", 2, "acquired"), ("a", 3, "released"), ("b", 1, "acquired"), ("b", 2, "released")]
    timeline = H.ownership_timeline(ev, [F.col("event_id")])
    assert found(timeline.select("owner")) == [("a",), ("a",), ("b",)]
    asked = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 1, 30)), (1, dt.datetime(2024, 1, 1, 9))], "token_id long, at timestamp_ntz")
    assert [r.owner for r in H.owner_as_of(timeline, asked).orderBy("at").collect()] == ["b", None]


def test_null_parties_are_exempt(spark):
    ev = log(spark, (1, "a", "b", 1), (1, "a", "b", 1), (1, None, None, 1), (1, None, None, 1)).withColumn("tx_hash", F.lit("t"))
    assert H.unique_provenance(ev, [F.col("event_id")]).count() == 3


@pytest.mark.parametrize(("hex_", "number"), [("0", "0"), ("ff", "255"), ("f" * 64, str(2**256 - 1)), (hex(2**64)[2:], str(2**64)), (hex(10**38)[2:], str(10**38)), ("", None), ("zz", None)])
def test_hex_to_decimal(spark, hex_, number):
    assert spark.createDataFrame([(hex_,)], "h string").select(E.hex_to_decimal(F.col("h"))).first()[0] == number


def test_limb_sums(spark):
    top = 2**256 - 1
    rows = [("a", str(top), 1), ("a", str(top), -1), ("a", "7", 1), ("b", "5", -1), ("b", str(10**30), -1), ("c", str(top), -1), ("d", str(10**26), 1), ("d", "1", -1)]
    df = spark.createDataFrame(rows, "k string, n string, s int").withColumn("l", values.limbs(F.col("n"), F.col("s")))
    got = {r.k: r.total for r in values.sum_limbs(df, ["k"], "l", "total").collect()}
    assert got == {"a": "7", "b": str(-(10**30) - 5), "c": str(-top), "d": str(10**26 - 1)}


def test_data_uris(spark):
    rows = [("data:,a%20b",), ("data:image/png;base64,aGk=",), ("data:text/html;charset=utf-8,<p>",), ("nope",)]
    d = uris.parse_data_uri(F.col("u"))
    got = spark.createDataFrame(rows, "u string").select(d["mime"], d["base64"], d["data"]).collect()
    assert [tuple(r) for r in got] == [("text/plain", False, bytearray(b"a b")), ("image/png", True, bytearray(b"hi")), ("text/html", False, bytearray(b"<p>")), (None, None, None)]


def test_content_verdicts(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452")
    rows = [(1, "image/png", png + b"\0\0\0\0\0\0\0\1", None), (2, "image/png", png + b"\0\0\0\2\0\0\0\1", None), (3, "image/png", b"<html>", None), (4, "text/html", b"<title>Index of /x", None), (5, "text/html", b"", None), (6, "text/html", b"abc", 9)]
    got = found(S.content_verdict(spark.createDataFrame(rows, "id int, declared string, body binary, length long"), []).select("id", "verdict"))
    assert [x[1] for x in got] == ["bad_container", "healthy", "type_mismatch", "listing", "empty", "truncated"]


def test_sinks_are_idempotent(spark):
    t = spark.createDataFrame([(1, 10), (2, 20)], "id int, v int")
    s = spark.createDataFrame([(2, 21), (3, 30)], "id int, v int")
    once = sinks.upsert(t, s, ["id"], ["v"])
    assert found(once) == found(sinks.upsert(once, s, ["id"], ["v"])) == [(1, 10), (2, 21), (3, 30)]
    kept = sinks.insert_ignore(t, s, ["id"])
    assert found(kept) == found(sinks.insert_ignore(kept, s, ["id"])) == [(1, 10), (2, 20), (3, 30)]
    assert found(sinks.upsert(t, s, ["id"], ["v"], "old.v > 20")) == [(1, 10), (2, 20), (3, 30)]


def test_batches_and_quota(spark):
    owned = spark.createDataFrame([("a", b, t) for t, b in enumerate([1, 1, 1, 2, 3, 3, 4])], "owner string, block long, token_id long")
    assert [r.batch for r in H.block_batches(owned, 2, 3).orderBy("block").collect()] == [0, 1, 1, 2]
    quota = spark.createDataFrame([("a", 2)], "owner string, quota int")
    assert found(H.quota_cut(owned, quota)) == [("a", 1, 3)]


def test_neighbours_miss_none(spark):
    import random

    random.seed(4)
    known = [(k, random.getrandbits(63)) for k in range(20)]
    hashes = [(i, known[i % 20][1] ^ sum(1 << b for b in random.sample(range(63), i % 9))) for i in range(200)]
    got = dict(found(selection.hash_neighbours(spark.createDataFrame(hashes, "id long, hash long"), spark.createDataFrame(known, "position int, bits long"), 6)))
    want = {i: min(p for p, b in known if bin(h ^ b).count("1") <= 6) for i, h in hashes if any(bin(h ^ b).count("1") <= 6 for _, b in known)}
    assert got == want


def test_query_rules():
    with pytest.raises(ValueError):
        TokenQuery(sort_by="mint_number")
    with pytest.raises(ValueError):
        TokenQuery(limit=0)


def test_registries(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"name": "P", "url": "u", "chains": {"eip155:1": {"collection_addresses": ["0xAB"], "deployer_addresses": ["0xCD"]}}}]')
    assert found(T.load_publishers(spark, str(tmp_path / "p.json")).select("kind", "key")) == [("collection", "0xab"), ("deployer", "0xcd")]
    (tmp_path / "b.json").write_text('{"eip155:1": ["0xAB", "0xEF"], "tezos:mainnet": []}')
    assert found(T.load_blacklist(spark, str(tmp_path / "b.json"))) == [("eip155:1", "0xab"), ("eip155:1", "0xef")]


@pytest.mark.parametrize(("shadow", "want"), [(False, [(2, "gate"), (4, "release"), (6, "gate")]), (True, [])])
def test_gates_stream_equals_batch(spark, tmp_path, shadow, want):
    outcomes = ["rendered_ok", "blank", "blank", "no_evidence", "rendered_ok", "no_evidence", "known_bad_fingerprint"]
    rows = spark.createDataFrame([("u", i, i, x) for i, x in enumerate(outcomes)], "url_hash string, id long, at long, outcome string")
    rows.write.parquet(str(tmp_path / "in"))
    config = J.GateConfig(shadow=shadow)
    assert found(J.render_gates_batch(rows, config).select("id", "change")) == want
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert found(J.run_available(J.render_gates(stream, config), "gates").select("id", "change")) == want


@pytest.mark.parametrize("failures", [1, 2, 3])
def test_gate_windows_equal_the_steps(spark, failures):
    import random

    rng, config, rows, want = random.Random(failures), J.GateConfig(failures_to_gate=failures), [], []
    for url in [None, *(f"u{i}" for i in range(30))]:
        state = {"failures": 0, "gated": False}
        for at in range(rng.randrange(25)):
            outcome = rng.choices(["rendered_ok", "blank", "stalled", "no_evidence", "known_bad_fingerprint", None], [3, 5, 3, 3, 1, 1])[0]
            rows.append((url, len(rows), at // 2, outcome))
            state, change = J.gate_step(state, outcome, config)
            want += [(url, rows[-1][1], change)] if change else []
    df = spark.createDataFrame(rows, "url_hash string, id long, at long, outcome string")
    key = lambda r: (r[0] or "", r[1])
    assert sorted((tuple(r) for r in J.render_gates_batch(df.repartition(5), config).collect()), key=key) == sorted(want, key=key)
    assert J.render_gates_batch(df.limit(0), config).count() == 0


def test_jpeg_segments(spark):
    ok = bytes.fromhex("FFD8FFFFE000044A46FFD0FFDA0008")
    rows = [(1, ok), (2, ok[:4]), (3, bytes.fromhex("FFD8FFE000044A4612345678")), (4, bytes.fromhex("FFD8FFE000010000"))]
    df = spark.createDataFrame(rows, "id int, body binary").withColumn("declared", F.lit("image/jpeg")).withColumn("length", F.lit(None).cast("long"))
    assert [x[1] for x in found(S.content_verdict(df, []).select("id", "verdict"))] == ["healthy", "healthy", "bad_container", "bad_container"]


def test_all_gates_go_in_batches(spark):
    probes = spark.createDataFrame([(f"h{i}", i < 5) for i in range(8)], "url_hash string, health_gated boolean")
    health = spark.createDataFrame([(i, 100 + i, f"h{i}", "metadata_image", "healthy" if i % 2 else "broken") for i in range(8)], "id int, token_id int, url_hash string, media_source string, health_status string")
    tokens = spark.createDataFrame([(100 + i, i == 1) for i in range(8)], "token_id int, is_viewable boolean")
    probes, health, changes = S.release_all_gates(probes, health, tokens, 3)
    assert probes.where("health_gated").count() == 2 and found(health.where("health_status = 'unknown'").select("id")) == [(0,), (1,), (2,)]
    assert found(changes) == [(101, True, False)]
    probes, health, _ = S.release_all_gates(probes, health, tokens, 3)
    assert probes.where("health_gated").count() == 0


def test_ingest_that_runs_twice_and_restarts(spark, tmp_path):
    events = lambda *rows: spark.createDataFrame(rows, "chain string, block_number long, tx_index long")
    start = spark.createDataFrame([("a", 2)], "chain string, block_number long")
    batches = [events(("a", 1, 0), ("a", 2, 0), ("a", 4, 0), ("b", 1, 0)), events(("a", 3, 0), ("a", 4, 1), ("b", 0, 0), ("b", 5, 0)), events(("a", 5, 0), ("b", 5, 1))]
    schema = "chain string, block_number long, tx_index long"
    path = str(tmp_path / "ingest")
    for k, batch in enumerate(batches):
        for _ in range(2):
            J.OrderedIngest(spark, path, start).batch(batch, k)  # a new object each time: nothing is kept in memory
    want = [("a", 2, 0), ("a", 4, 0), ("a", 4, 1), ("a", 5, 0), ("b", 1, 0), ("b", 5, 0), ("b", 5, 1)]
    assert found(J.BatchTables(spark, path).all("events", schema)) == want
    J.OrderedIngest(spark, path, start).batch(batches[1], 1)
    assert found(J.BatchTables(spark, path).all("events", schema)) == want


def test_levels_wait_overflow_and_time_out(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([("c", level, feed, i, "") for i, (feed, level) in x], J.FEED)
    job = J.LevelAlign(spark, str(tmp_path / "align"), 2, 60)
    batches = [(rows((1, ("transfer", 1)), (2, ("transfer", 2))), 0), (rows((3, ("metadata", 2)), (4, ("transfer", 1))), 10), (rows((5, ("transfer", 5)), (6, ("transfer", 6)), (7, ("transfer", 7))), 20), (rows((8, ("transfer", 9)), (9, ("metadata", 1))), 100)]
    for k, (batch, now) in enumerate(batches):
        for _ in range(2):
            job.batch(batch, k, now)
    got = found(J.BatchTables(spark, job.path).all("released", f"{J.FEED}, reason string").select("id", "reason"))
    # 4 comes in the batch that seals its level, 9 after that
    assert got == [(1, "aligned"), (2, "overflow"), (3, "overflow"), (4, "aligned"), (5, "overflow"), (6, "timeout"), (7, "timeout")]


def test_levels_time_out_by_their_first_row_and_rows_are_removed(spark, tmp_path, monkeypatch):
    """Rows are read from the batches in which they came; a batch's time is that of its first run; old versions go."""
    monkeypatch.setattr(J, "KEEP", 1)
    job = J.LevelAlign(spark, str(tmp_path / "align"), 10, 60)
    rows = lambda *x: spark.createDataFrame([("c", level, "transfer", i, "") for i, level in x], J.FEED)
    none = spark.createDataFrame([], J.FEED)
    tables = J.BatchTables(spark, job.path)
    for k, (batch, now) in enumerate([(rows((1, 1), (2, 2)), 0), (rows((3, 2), (4, 3)), 30), (none, 61), (none, 62), (none, 95), (none, 96), (none, 97)]):
        job.batch(batch, k, now)
        job.batch(batch, k, now + 1000)
        got = found(tables.all("released", f"{J.FEED}, reason string").select("id", "reason"))
        assert got == [(i, "timeout") for i in ((), (), (1, 2, 3), (1, 2, 3), (1, 2, 3, 4), (1, 2, 3, 4), (1, 2, 3, 4))[k]]
    assert tables.versions("arrived") == [5, 6] and tables.versions("levels") == [4, 5, 6] and tables.versions("released") == list(range(7))


def test_idle_blocks_are_flushed(spark, tmp_path):
    job = J.IdleFlush(spark, str(tmp_path / "idle"), idle=60)
    rows = lambda *x: spark.createDataFrame(list(x), J.BLOCK)
    batches = [
        (rows(("a", 1, 1), ("a", 2, 2), ("b", 1, 3)), 0, [("a", 1, 1, False)]),
        (rows(("b", 1, 4)), 50, []),
        (rows(), 70, [("a", 2, 2, True)]),  # b had a row since
        (rows(("a", 2, 5)), 80, []),  # a late row of a flushed block
        (rows(("a", 3, 6)), 100, [("a", 2, 5, False)]),
        (rows((J.CLOCK, 0, 0)), 200, [("a", 3, 6, True), ("b", 1, 3, True), ("b", 1, 4, True)]),
    ]
    want = []
    for k, (batch, now, out) in enumerate(batches):
        want += out
        for late in (0, 10_000):  # each batch twice, the second time at another hour, by another object
            J.IdleFlush(spark, job.path, idle=60).batch(batch, k, now + late)
        assert found(job.blocks()) == sorted(want)
    J.IdleFlush(spark, job.path, idle=60).batch(batches[2][0], 2, 1e9)
    assert found(job.blocks()) == sorted(want)


def test_a_running_job_flushes_without_new_rows(spark, tmp_path):
    import time

    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], J.BLOCK)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    job = J.IdleFlush(spark, str(tmp_path / "idle"), idle=1)
    query = job.start(spark.readStream.schema(J.BLOCK).parquet(str(tmp_path / "in")), every="1 second")
    try:
        end = time.time() + 60
        while time.time() < end and job.blocks().count() < 2:
            time.sleep(0.5)
    finally:
        query.stop()
    assert found(job.blocks()) == [("a", 1, 1, False), ("a", 2, 2, True)]


WIDE_EVENT = EVENT.replace("quantity long", "quantity string")
TOP = 2**256 - 1


def wide_log(spark, *rows):
    return log(spark, *((t, a, b, 0) for t, a, b, _ in rows)).drop("quantity").join(spark.createDataFrame([(i, q if q is None else str(q)) for i, (*_, q) in enumerate(rows)], "event_id long, quantity string"), "event_id")


def test_wide_quantities_are_exact(spark):
    ev = wide_log(spark, (1, None, "a", TOP), (1, None, "a", 2**64 + 1), (1, "a", "b", 2**63), (1, "b", "c", 2**63), (2, None, "a", 2**64 - 1), (2, "a", None, 2**64 - 1), (3, None, "b", None), (3, "c", "b", 5), (3, None, "b", "x"))
    total = TOP + 2**64 + 1 - 2**63
    assert found(H.replay_balances(ev)) == [(1, "a", str(total)), (1, "c", str(2**63)), (3, "b", "6")]
    assert found(H.owner_balance(ev, "a")) == [(1, str(total)), (2, "0")]
    assert found(H.owner_balance(ev, "c")) == [(1, str(2**63)), (3, "0")]
    many = ev.withColumn("standard", F.lit("erc1155"))
    assert found(H.owned_tokens(many, "a", ORDER).select("token_id", "quantity")) == [(1, str(total))]
    assert found(H.token_state(many, ORDER).select("token_id", "burned", "holders", "held")) == [(1, False, 2, str(TOP + 2**64 + 1)), (2, True, 0, "0"), (3, False, 1, "6")]
    per_event = values.totalled(H.signed_deltas(ev), ["token_id", "address", "event_id"], "delta", "delta")
    feed = S.feed_multi(per_event, ["event_id"]).where("token_id = 2").select("event_id", "address", "after", "kind")
    assert found(feed) == [(4, "a", str(2**64 - 1), "acquired"), (5, "a", "0", "released")]
    held = H.replay_with_limit(many, 10)
    assert found(held.select("owner", "token_id")) == [("a", 1), ("b", 3), ("c", 1)]


def test_wide_deltas_are_applied(spark):
    b = spark.createDataFrame([(1, "a", str(2**64)), (2, "a", "7")], "token_id long, owner_address string, quantity string")
    d = spark.createDataFrame([(1, "a", str(-(2**64) + 1)), (2, "a", "-7"), (3, "b", str(TOP)), (4, "b", "-1")], "token_id long, owner_address string, delta string")
    assert found(S.apply_transfers(b, d)) == [(1, "a", "1"), (3, "b", str(TOP))]


def test_wide_order_and_sign(spark):
    df = spark.createDataFrame([("9",), ("10",), (str(TOP),), ("0",)], "q string")
    assert [r.q for r in df.orderBy(F.desc(values.size_order(df, "q"))).collect()] == [str(TOP), "10", "9", "0"]
    assert found(df.where(values.above_zero(df, "q"))) == [("10",), (str(TOP),), ("9",)]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tokenledger.session import scratch_dir

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://m:7077"))
    with pytest.raises(RuntimeError):
        scratch_dir(bare)


def test_levels_align(spark, tmp_path):
    rows = [("c", "transfer", 1, 1, "a"), ("c", "metadata", 1, 2, "b"), ("c", "transfer", 2, 3, "c"), ("c", "metadata", 3, 4, "d"), ("c", "transfer", 3, 5, "e")]
    df = spark.createDataFrame(rows, "chain string, feed string, level long, id long, payload string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = J.LevelAlign(spark, str(tmp_path / "align"), 10, 60).run(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    assert found(out.select("level", "feed", "id")) == [(1, "metadata", 2), (1, "transfer", 1), (2, "transfer", 3)]


def parts_of(path):
    """Files of each partition folder, by name."""
    import pathlib

    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}


def test_sinks_write_the_touched_buckets_only(spark, tmp_path):
    rows = [(k, f"o{k % 3}", k) for k in range(200)] + [(7, "more", 1)] * 50
    df = spark.createDataFrame(rows, "token_id long, owner_address string, quantity long")
    table = sinks.BucketedTable(spark, str(tmp_path / "t"), "token_id", buckets=16).create(df)
    bucket = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in (3, 7, 500)], "token_id long").selectExpr("token_id", "pmod(xxhash64(token_id), 16)").collect()}
    before = parts_of(table.path)
    table.replace_group(spark.createDataFrame([(7, "x", 5), (7, "y", 6)], df.schema))
    after = parts_of(table.path)
    changed = {f.split("/")[0] for f in before.keys() ^ after.keys()} | {f.split("/")[0] for f in before.keys() & after.keys() if before[f] != after[f]}
    assert changed == {f"bucket={bucket[7]}"}
    assert found(table.read([7])) == [(7, "x", 5), (7, "y", 6)] and table.read().count() == 201
    table.upsert(spark.createDataFrame([(3, "o0", 99), (500, "new", 1)], df.schema), ["token_id", "owner_address"], ["quantity"], "old.quantity < 50")
    assert found(table.read([3])) == [(3, "o0", 99)] and found(table.read([500])) == [(500, "new", 1)]
    assert {f.split("/")[0] for f in parts_of(table.path).keys() ^ after.keys()} == {f"bucket={bucket[3]}", f"bucket={bucket[500]}"}
    table.insert_ignore(spark.createDataFrame([(3, "o0", 1), (3, "o9", 2)], df.schema), ["token_id", "owner_address"])
    assert found(table.read([3])) == [(3, "o0", 99), (3, "o9", 2)] and table.read().count() == 203
    table.replace_group(df.limit(0))
    assert table.read().count() == 203
    assert "bucket" in table.read([7])._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]


def test_log_scans_read_their_folders_only(spark, tmp_path):
    logs = spark.createDataFrame([("0xA", [sig, "0x1"], "0x", block, f"t{block}", 0, 0, None) for block in range(0, 1000, 10) for sig in (E.TRANSFER, E.URI)] + [("0xA", [], "0x", 55, "t", 0, 1, None)], "address string, topics array<string>, data string, block_number long, tx_hash string, tx_index int, log_index int, block_time timestamp")
    table = T.LogTable(spark, str(tmp_path / "logs"), width=100)
    table.append(logs.where("block_number < 500"))
    table.append(logs.where("block_number >= 500"))
    some = table.scan([E.TRANSFER], 150, 349)
    assert sorted(r.block_number for r in some.collect()) == list(range(150, 350, 10)) and some.columns == logs.columns
    read = {r[0].split("/logs/")[1].split("/part")[0] for r in some.select(F.input_file_name()).distinct().collect()}
    assert read == {f"block_range={k}/signature={E.TRANSFER}" for k in (1, 2, 3)}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "block_range" in plan.split("PartitionFilters")[1]
    assert table.scan([E.TRANSFER, E.URI], 0, 999).count() == 200 and table.scan(["0xother"], 0, 999).count() == 0


def test_batches_against_a_fold(spark):
    import random

    r = random.Random(2)
    owned = [(o, b) for o in "abcd" for b in r.sample(range(400), {"a": 1, "b": 7, "c": 60, "d": 150}[o]) for _ in range(r.choice([1, 1, 2, 3, 9]))]
    got = found(H.block_batches(spark.createDataFrame(owned, "owner string, block long"), 3, 7))
    want = []
    for o in "abcd":
        batch, held, most = 0, 0, 3
        for b in sorted({b for x, b in owned if x == o}):
            n = owned.count((o, b))
            want.append((o, b, n, batch))
            held += n
            if held >= most:
                batch, held, most = batch + 1, 0, 7
    assert got == sorted(want)
    plan = H.block_batches(spark.createDataFrame(owned, "owner string, block long"), 3, 7)._jdf.queryExecution().toString()
    assert "Pandas" not in plan
    assert H.block_batches(spark.createDataFrame([], "owner string, block long"), 3, 7).count() == 0


def test_owner_as_of_against_an_interval_join(spark):
    import random

    r = random.Random(8)
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    spans = []
    for token in range(3):
        times = sorted(r.choices(range(200), k=30))
        for a, b in zip(times, [*times[1:], None], strict=True):
            if r.random() < 0.8:
                spans.append((token, r.choice("abc"), at(a), None if b is None else at(b)))
    asked = [(t, at(h)) for t in range(4) for h in range(-5, 230, 3)] + [(0, at(50))]
    timeline = spark.createDataFrame(spans, "token_id long, owner string, acquired_at timestamp_ntz, released_at timestamp_ntz")
    times = spark.createDataFrame(asked, "token_id long, at timestamp_ntz")
    want = sorted((t, h, next((o for x, o, a, b in spans if x == t and a <= h and (b is None or h < b)), None)) for t, h in asked)
    for unit in ("day", "hour", "year"):
        assert sorted(found(H.owner_as_of(timeline, times, unit)), key=repr) == sorted(want, key=repr)


def test_render_verdicts_by_each_fingerprints_distance(spark):
    import random

    r = random.Random(1)
    bits = [r.getrandbits(63) for _ in range(6)]
    known = [(b, d) for b, d in zip(bits, (0, 3, 7, 15, 16, 40), strict=True)]
    captures = []
    for k in range(400):
        b = r.choice(bits)
        for i in r.sample(range(63), r.choice([0, 1, 3, 4, 7, 8, 15, 16, 17, 30])):
            b ^= 1 << i
        captures.append((k, b, r.choice([0.001, 0.5])))
    got = found(S.render_verdict(spark.createDataFrame(captures, "id long, hash long, variance double"), spark.createDataFrame(known, "bits long, max_distance int"), 0.01))
    want = sorted((k, "known_bad_fingerprint" if any(bin(h ^ b).count("1") <= d for b, d in known) else "blank" if x < 0.01 else "rendered_ok") for k, h, x in captures)
    assert got == want


@pytest.mark.parametrize(("hex_", "whole"), [("FFD8", True), ("FFD8FFFFFFE00004AAAAFFDA", True), ("FFD8FFFFFFE00004AAAAFFDA00", True), ("FFD8FF01FFD0FFD7FFE00002FFDA0000", True), ("FFD8FFE00001FFDA0000", False), ("FFD8FFE00003AA00FFDA0000", False), ("FFD8FFE0FFFFAA", True), ("FFD80FFFDA000000", False), ("FFD8FFE00004FFFFFFE10004FFFF00000000", False)])
def test_jpeg_walk(spark, hex_, whole):
    df = spark.createDataFrame([(bytes.fromhex(hex_),)], "b binary")
    assert df.select(S.jpeg_segments(F.col("b"))).first()[0] is whole
    assert "Python" not in df.select(S.jpeg_segments(F.col("b")))._jdf.queryExecution().toString()


def test_canonical_json(spark):
    from tokenledger.operators.metadata import canonical_json

    rows = ['{"b": 1, "a": {"z": [1, {"y": 2, "x": null}], "é": "ü\\n"}}', '{ "a":{"é":"ü\\u000a","z":[1.0,{"x":null,"y":2}]},"b":1 }', "[]", " 5 ", '"x"', "nope", "", None, '{"a":1,"a":2}', '{"b":true,"B":false,"aa":0}']
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, j string").orderBy("i").select(canonical_json(F.col("j"))).collect()]
    assert got[0] == got[1] and got[0].startswith('{"a":{"z":[1,{"x":null,"y":2}],"é":') and got[0].endswith(',"b":1}')
    assert got[2:9] == ["[]", "5", '"x"', None, None, None, None] and got[9] == '{"B":false,"aa":0,"b":true}'


def test_expansion_of_a_page(spark):
    from tokenledger.plans.tokens import expand, page_ids

    t = dt.datetime(2024, 1, 1)
    tokens = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "token_id long, label string")
    tables = {
        "balances": spark.createDataFrame([(1, "a", "5"), (1, "b", str(2**70)), (1, "c", "40"), (9, "d", "1")], "token_id long, owner_address string, quantity string"),
        "events": spark.createDataFrame([(1, 1, "mint", t), (1, 2, "transfer", t), (2, 3, "mint", None)], "token_id long, event_id long, event_type string, ts timestamp_ntz"),
        "ownership": spark.createDataFrame([(1, "a", 1, t, 0), (1, "b", 2, t, 1), (2, "b", 3, t, 0)], "token_id long, owner_address string, id long, last_timestamp timestamp_ntz, last_tx_index long"),
        "metadata": spark.createDataFrame([(1, "m", "data:x", "u/a", "art"), (3, "n", "u/n", None, None)], "token_id long, name string, image_url string, animation_url string, artist string"),
        "enrichment": spark.createDataFrame([(1, "e", "", "data:y", "")], "token_id long, name string, image_url string, animation_url string, artist string"),
        "health": spark.createDataFrame([(3, "metadata_image", "broken", "u/n"), (9, "metadata_image", "healthy", "u/9")], "token_id long, media_source string, health_status string, media_url string"),
    }
    md5 = lambda x: __import__("hashlib").md5(x.encode()).hexdigest()
    tables["assets"] = spark.createDataFrame([(md5("data:y"), {"public": "cdn/y"}), (md5("u/a"), {"public": "cdn/a"}), (md5("u/n"), {})], "source_url_hash string, variant_urls map<string,string>")
    kinds = ["owners", "provenance_events", "owner_provenances", "metadata", "enrichment_source", "display", "media_asset"]
    for ids in (None, page_ids(tokens), [1, 2, 3]):
        one, two, three = (r.asDict(recursive=True) for r in expand(tokens, kinds, tables, 2, ["b"], ids).orderBy("token_id").collect())
        assert [o["owner_address"] for o in one["owners"]] == ["b", "c"] and one["owners_total"] == 3 and one["label"] == "x"
        assert [e["event_id"] for e in one["provenance_events"]] == [2, 1] and one["provenance_events_total"] == 2
        assert [o["owner_address"] for o in one["owner_provenances"]] == ["b"] and one["owner_provenances_total"] == 1
        assert (one["metadata"]["name"], one["enrichment_source"]["name"]) == ("m", "e")
        assert one["display"] == {"name": "e", "description": None, "image_url": "", "animation_url": "cdn/y", "artist": "art"}
        assert one["media_asset"] == sorted([md5("data:y"), md5("u/a")])
        assert two["owners"] is None and two["owners_total"] is None and two["display"] is None and two["media_asset"] is None and len(two["provenance_events"]) == 1
        assert three["display"]["image_url"] is None and three["media_asset"] == [md5("u/n")]
    assert expand(tokens, ["metadata"], tables, 2).columns == ["token_id", "label", "metadata"]
    assert page_ids(tokens, 2) is None
    with pytest.raises(ValueError):
        expand(tokens, ["media_asset"], tables, 2)


def test_a_sync_reads_its_days_and_buckets_only(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [(d * 10 + k, k, o, "acquired", at(d), at(d)) for d in range(1, 11) for k, o in enumerate(["a", "b", "c", None])]
    feed = spark.createDataFrame(rows, "id long, token_id long, owner_address string, event_type string, occurred_at timestamp_ntz, created_at timestamp_ntz")
    table = T.FeedTable(spark, str(tmp_path / "feed"), buckets=8)
    table.append(feed.where("id < 50"))
    table.append(feed.where("id >= 50"))
    some = table.since("a", F.lit(at(8)))
    assert found(some.select("id")) == [(d * 10 + k,) for d in (8, 9, 10) for k in (0, 3)]
    read = {r[0].split("/feed/")[1].split("/part")[0] for r in some.select(F.input_file_name()).distinct().collect()}
    assert len(read) == 6 and all(x.split("day=2024-01-")[1][:2] in ("08", "09", "10") for x in read)
    assert "PartitionFilters" in some._jdf.queryExecution().executedPlan().toString()
    balances = spark.createDataFrame([(3, "a", 1), (2, "b", 1)], "token_id long, owner_address string, quantity long")
    page = S.sync(some, balances, "a", F.lit(at(8)), 80, 3).collect()
    assert [(r.id, r.has_more, r.next_id) for r in page] == [(83, True, 93), (90, True, 93), (93, True, 93)]
