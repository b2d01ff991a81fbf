"""What keeps queries' tasks, shuffles and tables in bounds as the tables grow."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tokenledger.plans import QUERIES

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_json_of_parts_is_spread(spark):
    assert QUERIES["MD6_overlay_opensea"](spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_rows_decide_about_tasks(spark):
    from tokenledger.session import by_rows

    df = by_rows(spark.range(10), ["id"], 3)
    assert df.rdd.getNumPartitions() == 4 and sorted(r.id for r in df.collect()) == list(range(10))


@pytest.mark.parametrize("name", ["EVT3_explode_erc1155_batch", "EVT4_decode_metadata_update", "EVT5_decode_configured_event", "SRC3_merge_owner_specs", "FLT1_on_decoded_events", "AGG1_replay_decoded_wide"])
def test_logs_are_not_stored(spark, name):
    read = QUERIES[name](spark, DATA).inputFiles()
    assert read and all(f"{DATA}/" in f for f in read)


def test_batches_are_read_step_by_step(spark):
    """What is read from the data is computed by generators, and isn't repeated in conditions."""
    plan = QUERIES["EVT3_explode_erc1155_batch"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("conv(") < 12


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_holdings_by_batches_and_buckets(spark, tmp_path, kind):
    """Balances after each event, of holders whose events are in many buckets and batches, against plain sums. Each batch runs twice."""
    import random

    from tokenledger.streaming import jobs as J

    draw = random.Random(5)
    unit = 1 if kind == "bigint" else 2**200 + 1
    cast = (lambda x: x) if kind == "bigint" else (lambda x: None if x is None else str(x))
    events = [(draw.choice([1, 2, None]), k, draw.choice(["a", "b", None]), draw.choice(["a", "b", "c", None]), draw.choice([None, -unit, 0, unit, 2 * unit])) for k in range(120)]
    schema = f"token_id bigint, event_id bigint, from_address string, to_address string, quantity {kind}"
    job = J.RunningHoldings(spark, str(tmp_path / "holdings"), span=8)
    for k in range(6):
        part = spark.createDataFrame([(*e[:4], cast(e[4])) for e in events[k * 20 : k * 20 + 20]], schema)
        for _ in range(2):
            job.batch(part, k)
    held, want = {}, []
    for token, k, sender, receiver, q in events:
        for who, sign in ((sender, -1), (receiver, 1)) if sender != receiver else ():
            if who is not None:
                was = held.get((token, who), 0)
                now = held[token, who] = was + sign * (q or 0)
                want.append((token, who, k, cast(now), "acquired" if now > 0 >= was else "released" if was > 0 >= now else None))
    assert sorted(map(tuple, job.changes(kind).collect()), key=repr) == sorted(want, key=repr)


def test_sales_are_shuffled_by_a_short_key(spark):
    """A sale's contract, transaction and seller are long; what is shuffled for the join with its logs is 16 bytes of them."""
    plan = QUERIES["EVT13_repair_sale_burn"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__sale" in plan and "hashpartitioning(contract" not in plan


def test_sales_meet_the_logs_of_their_own_seller(spark):
    """The first log of value 0 or 1 decides; a sale without a seller has no buyer, and texts that join to the same are told apart."""
    from tokenledger.operators import events as E

    address = lambda c: "0x" + c * 40
    log = lambda tx, seller, buyer, at, value: ("0xC", [E.TRANSFER, "0x" + "0" * 24 + seller * 40, "0x" + "0" * 24 + buyer * 40], "0x" + f"{value:064x}", tx, at)
    logs = spark.createDataFrame([log("t1", "a", "b", 2, 1), log("t1", "a", "c", 1, 0), log("t1", "a", "d", 0, 2), log("t1", "e", "f", 0, 0), log("t2", "a", "e", 0, 0)], "address string, topics array<string>, data string, tx_hash string, log_index int")
    sales = [("0xc", "t1", address("a"), None, 1), ("0xc", "t1", address("e"), None, 2), ("0xc", "t2", address("a"), address("b"), 3), ("0xc", "t2", None, None, 4), ("0xd", "t1", address("a"), None, 5), ("0xc", "t1", address("a"), None, 6)]
    events = spark.createDataFrame([(*s[:4], "transfer", s[4]) for s in sales], "contract string, tx_hash string, from_address string, to_address string, event_type string, id int")
    done, none = E.repair_sales(events, logs)
    assert sorted((r.id, r.to_address) for r in done.collect()) == [(1, address("c")), (2, address("f")), (3, address("b")), (6, address("c"))]
    assert sorted(r.id for r in none.collect()) == [4, 5]


def test_logs_of_an_owner_are_found_once(spark):
    """They are a table of known size, which both joins of recovered sales read."""
    files = QUERIES["EVT14_recover_corrupt_sales"](spark, DATA).inputFiles()
    assert any("/owner-logs-" in f for f in files)


def test_a_bound_of_rows_decides_about_tasks(spark):
    """Tables that all cores together have room for stay as they are."""
    from tokenledger.session import of_rows

    cores = spark.sparkContext.defaultParallelism
    df = spark.range(100)
    assert of_rows(df, ["id"], 100, 10).rdd.getNumPartitions() == 10 and of_rows(df, ["id"], 10 * cores, 10) is df
    assert sorted(r.id for r in of_rows(df, ["id"], 100, 10).collect()) == list(range(100))


@pytest.mark.parametrize("name", ["AGG1_replay_balances", "QRY3_token_expand"])
def test_sums_of_many_line_items_are_dealt_by_rows(spark, monkeypatch, name):
    """Line items and orders for their join, and what is summed by token and address; the rows are the same."""
    from tokenledger import session

    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = rows(QUERIES[name](spark, DATA))
    monkeypatch.setattr(session.of_rows, "__defaults__", (500,))
    got = QUERIES[name](spark, DATA)
    assert got._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 3
    assert rows(got) == want


def test_replayed_logs_run_compiled(spark):
    """sums of 256-bit numbers need no decimals, and no method of theirs is too large (8,000 bytes) for the JVM to compile."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES["AGG1_replay_decoded_wide"](spark, DATA)._jdf.queryExecution().executedPlan()
        code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000
    assert not re.search(r"sum\(\w+(#\d+)?\.(low|mid|high)", plan.toString())


def test_nines(spark):
    """Hex digits as nines, their text and signed sums, against Python's integers."""
    import random

    from tokenledger.functions import values as V

    draw = random.Random(3)
    numbers = [0, 1, 10**9 - 1, 10**9, 2**52 - 1, 2**52, 2**63, 2**64 - 1, 10**77, 2**256 - 1] + [draw.getrandbits(draw.randint(1, 256)) for _ in range(300)]
    rows = [(k, f"{n:064x}") for k, n in enumerate(numbers)] + [(-1, "zz" + "0" * 62), (-2, "0" * 63), (-3, None)]
    df = V.nines_of_hex(spark.createDataFrame(rows, "k int, h string"), "h", "q")
    assert {r.k: r.t for r in df.select("k", V.digits("q").alias("t")).collect()} == {k: str(n) for k, n in enumerate(numbers)} | {-1: None, -2: None, -3: None}

    each = df.where("k >= 0").select((F.col("k") % 70).alias("g"), F.when(F.col("k") % 3 > 0, V.signed(df, "q")).otherwise(V.signed(df, "q", -1)).alias("q"))
    sums = V.totalled(each, ["g"], "q", "q")
    want: dict[int, int] = {}
    for k, n in enumerate(numbers):
        want[k % 70] = want.get(k % 70, 0) + (n if k % 3 else -n)
    got = {r.g: (r.q, r.above) for r in V.shown(sums.withColumn("above", V.above_zero(sums, "q")), "q").collect()}
    assert got == {g: (str(n), n > 0) for g, n in want.items()}


def test_replay_of_nines(spark):
    """Balances are the same of nines as of text; a value that isn't hex counts as 1, as a missing quantity does."""
    from tokenledger.operators import events as E
    from tokenledger.operators import holdings as H

    party = lambda c: "0x" + "0" * 24 + c * 40
    rows = [(["0x" + "0" * 64, party(a), party(b)], f"0x{t:064x}{q}") for t, a, b, q in [(1, "a", "b", f"{2**256 - 1:064x}"), (1, "a", "b", f"{5:064x}"), (1, "b", "c", f"{2**64:064x}"), (2**200, "a", "c", "z" * 64), (3, "0", "a", f"{7:064x}")]]
    logs = spark.createDataFrame([("0xAB", [E.TRANSFER_SINGLE, *t], d, 1, "t", 1, k) for k, (t, d) in enumerate(rows)], "address string, topics array<string>, data string, block_number bigint, tx_hash string, tx_index int, log_index int").withColumn("block_time", F.lit(None).cast("timestamp"))
    replay = lambda text: sorted(tuple(r) for r in H.replay_balances(E.decode_1155_single(logs, text).withColumnRenamed("token_number", "token_id")).collect())
    address = lambda c: "0x" + c * 40
    assert replay(False) == replay(True) == sorted([("1", address("b"), str(2**256 + 4 - 2**64)), ("1", address("c"), str(2**64)), (str(2**200), address("c"), "1"), ("3", address("a"), "7")])


def test_log_texts_are_made_where_they_are_written(spark, monkeypatch):
    """rows are sorted into folders before their logs are made, and nothing is shuffled by folder."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans, parquet = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), parquet(self, path, *a, **b))[1])
    QUERIES["SRC2_raw_log_scan"](spark, DATA)
    (plan,) = [p for p in plans if "block_range" in p]
    assert not re.search(r"Exchange hashpartitioning\(block_range", plan)
    assert plan.rindex("md5(") < plan.index("Sort [block_range")


def test_made_logs_are_as_appended_ones(spark, tmp_path):
    from tokenledger.sources import tables as T

    rows = spark.range(400).select((F.col("id") * 3).alias("block_number"), F.when(F.col("id") % 3 > 0, "0xs").otherwise("0xt").alias("signature"), F.col("id").cast("string").alias("tx_hash"), F.lit(0).alias("log_index"), F.lit("0xA").alias("address"))
    log = [F.array("signature", F.concat(F.lit("0x"), F.hex("block_number"))).alias("topics"), *(F.col(c) for c in ("block_number", "tx_hash", "log_index", "address"))]
    made, appended = (T.LogTable(spark, str(tmp_path / x), width=250) for x in ("made", "appended"))
    for part in (rows.where("block_number < 600"), rows.where("block_number >= 600")):
        made.append_made(part, log)
        appended.append(part.select(*log))
    found = lambda table, *a: sorted(map(tuple, table.scan(*a).collect()))
    assert found(made, ["0xs", "0xt"], 0, 1200) == found(appended, ["0xs", "0xt"], 0, 1200) and len(found(made, ["0xs", "0xt"], 0, 1200)) == 400
    assert found(made, ["0xs"], 240, 700) == found(appended, ["0xs"], 240, 700) == sorted((["0xs", f"0x{b:X}"], b, str(b // 3), 0, "0xA") for b in range(240, 701, 3) if b % 9)
    read = made.scan(["0xs"], 240, 700).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("/made/")[1].split("/part")[0] for r in read} == {f"block_range={k}/signature=0xs" for k in (0, 1, 2)}


def test_packed_addresses(spark):
    """replayed logs' addresses are shuffled as bytes, and any text comes back as it was."""
    from tokenledger.functions.identity import packed, unpacked

    texts = ["0x" + "0af9" * 10, "0x" + "0AF9" * 10, "0x", "0xa", "0xzz", "ab", "", "tz1VSUr8wwNhLAzempoch5d6hLRiTh8Cjcjb", "0X12", "é0"]
    found, text = packed(F.col("a"))
    rows = spark.createDataFrame([(t,) for t in texts], "a string").select("a", found.alias("b"), text.alias("t")).withColumn("back", unpacked(F.col("b"), F.col("t"))).collect()
    assert all(r.back == r.a and (r.b is None) != (r.t is None) for r in rows) and [r.a for r in rows if r.b is not None] == texts[:1] + texts[2:3] and len(rows[0].b) == 20
    plan = QUERIES["AGG1_replay_decoded_wide"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(token_id#\d+, __bytes#\d+, __text#\d+", plan)


def test_nines_of_very_many(spark):
    """sums as large as bigints hold are carried without loss."""
    from tokenledger.functions import values as V

    least, most = -(2**63), 2**63 - 1
    sums = [(least,) + (0,) * 8, (0, least) + (0,) * 7, (most,) + (0,) * 8, (least,) * 8 + (1,), (most,) * 8 + (-1,), (least + 1, 5, -7, most - 10**10, 0, 0, -1, 0, 0), (10**9, -1) + (0,) * 7, (-1,) + (0,) * 8]
    # a carry into a part that is full would overflow, so these have room for it
    sums = [tuple(max(min(x, most - 10**10), least + 10**10) if k else x for k, x in enumerate(row)) for row in sums]
    df = spark.createDataFrame([(k, row) for k, row in enumerate(sums)], f"k int, q struct<{', '.join(f'{n}: bigint' for n in V.NINES)}>")
    carried = V.carried(df, "q")
    got = {r.k: (r.q, r.above) for r in V.shown(carried.withColumn("above", V.above_zero(carried, "q")), "q").collect()}
    want = {k: sum(x * 10 ** (9 * i) for i, x in enumerate(row)) for k, row in enumerate(sums)}
    assert got == {k: (str(n), n > 0) for k, n in want.items()}
