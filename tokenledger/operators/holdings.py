"""Balances, owners and the order of events: aggregations and windows over an event log.

An event has token_id, event_type, from_address, to_address, quantity, tx_hash, block_number, tx_index, ts and event_id,
the order in which events were taken in. Quantities are bigints, or decimal text of up to 256 bits as decoding gives them, or
nines; balances are bigints, or text where quantities are text or nines, whose sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.identity import is_none_address, packed, unpacked
from ..session import by_rows, of_rows, written

OWNERSHIP = ["mint", "transfer", "burn"]


def signed_deltas(events: DataFrame) -> DataFrame:
    """Two rows an event: the sender loses and the receiver gains; rows of nobody are left out. A missing quantity is 1. delta is
    a bigint, or limbs where quantities are text, or nines where they are nines."""
    own = events.where(F.col("event_type").isin(OWNERSHIP)).withColumn("__q", F.coalesce(F.col("quantity"), V.one(events, "quantity")))
    sides = F.array(F.struct(F.col("from_address").alias("address"), V.signed(own, "__q", -1).alias("delta")), F.struct(F.col("to_address").alias("address"), V.signed(own, "__q").alias("delta")))
    own = own.withColumn("side", F.explode(sides)).drop("__q")
    return own.select("*", "side.address", "side.delta").drop("side").where(~is_none_address(F.col("address")))


def net(deltas: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Sums above zero of deltas per key, as quantity, with other aggregates."""
    sums = V.totalled(deltas, keys, "delta", "quantity", *more)
    return V.shown(sums.where(V.above_zero(sums, "quantity")), "quantity", above=True)


def replay_balances(events: DataFrame, rows: int | None = None) -> DataFrame:
    """AGG1: balances above zero of each token and address. rows is a bound of the number of events, where one is known: of many,
    a task then sums a bounded number (`of_rows`). Addresses of decoded logs, whose quantities are nines, are shuffled as bytes."""
    deltas, key = signed_deltas(events), ["token_id", "address"]
    if V.kind_of(deltas, "delta") == "nines":
        found, text = packed(F.col("address"))
        deltas, key = deltas.select("token_id", found.alias("__bytes"), text.alias("__text"), "delta"), ["token_id", "__bytes", "__text"]
    sums = net(deltas if rows is None else of_rows(deltas, key, 2 * rows), key)
    return sums if "address" in key else sums.select("token_id", unpacked(F.col("__bytes"), F.col("__text")).alias("address"), "quantity")


def owner_balance(events: DataFrame, owner: str) -> DataFrame:
    """AGG2: one owner's net quantity of each token, zero at least. The owner's filter comes before the sums."""
    mine = events.where((F.col("from_address") == owner) | (F.col("to_address") == owner))
    sums = V.totalled(signed_deltas(mine).where(F.col("address") == owner), ["token_id"], "delta", "quantity")
    zero = F.lit(0) if V.kind_of(sums, "quantity") == "bigint" else F.lit("0")
    out = V.shown(sums.withColumn("__above", V.above_zero(sums, "quantity")), "quantity")
    return out.select("token_id", F.when(F.col("__above"), F.col("quantity")).otherwise(zero).alias("quantity"))


def last_owner(events: DataFrame, order: list[str]) -> DataFrame:
    """AGG3: the receiver of each token's last ownership event (null after a burn)."""
    own = events.where(F.col("event_type").isin(OWNERSHIP))
    last = F.max_by(F.struct("to_address", "event_type"), F.struct(*order))
    return own.groupBy("token_id").agg(last.alias("last")).select("token_id", F.col("last.to_address").alias("owner"), (F.col("last.event_type") == "burn").alias("burned"))


SINGLE_OWNER = ["erc721"]  # token standards of which one address holds a token; of others, several may


def with_standard(events: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """events with the standard of configured contracts (contract, standard) in place of their own."""
    if configured is None:
        return events
    known = configured.select(F.lower("contract").alias("__c"), F.col("standard").alias("__s"))
    return events.join(known, F.lower("contract") == F.col("__c"), "left").withColumn("standard", F.coalesce("__s", "standard")).drop("__c", "__s")


def owned_tokens(events: DataFrame, owner: str, order: list[str], configured: DataFrame | None = None) -> DataFrame:
    """AGG4: tokens that one owner holds, with the block of their last change and the quantity.

    Of single-owner standards the token's last transfer from or to the owner decides, and the quantity is 1; of the others
    the net quantity. Configured contracts have the model of their configured standard.
    """
    mine = with_standard(events.where(F.col("event_type").isin(OWNERSHIP) & ((F.col("from_address") == owner) | (F.col("to_address") == owner))), configured)
    single = F.col("standard").isin(SINGLE_OWNER)
    last = mine.where(single).groupBy("token_id").agg(F.max_by(F.struct(F.coalesce(F.col("to_address") == owner, F.lit(False)).alias("held"), "block_number"), F.struct(*order)).alias("last"))
    many = net(signed_deltas(mine.where(~single)).where(F.col("address") == owner), ["token_id"], F.max("block_number").alias("last_block"))
    one = last.where("last.held").select("token_id", F.lit(1).cast(dict(many.dtypes)["quantity"]).alias("quantity"), F.col("last.block_number").alias("last_block"))
    return one.unionByName(many)


def token_state(events: DataFrame, order: list[str]) -> DataFrame:
    """AGG5: owner, burned, holders and held of each token with an ownership event, by its standard.

    Single-owner tokens belong to the receiver of the last ownership event and are burned if that is a burn; they have one
    holder of one. Others have no one owner, and are burned when no balance above zero is left.
    """
    last = events.where(F.col("event_type").isin(OWNERSHIP)).groupBy("token_id").agg(F.max_by(F.struct("to_address", "event_type", "standard"), F.struct(*order)).alias("last"))
    left = V.totalled(signed_deltas(events.where(~F.col("standard").isin(SINGLE_OWNER))), ["token_id", "address"], "delta", "q")
    left = left.where(V.above_zero(left, "q"))
    left = V.shown(V.totalled(left, ["token_id"], "q", "sum", F.count("*").alias("n")), "sum")
    amount = "string" if dict(left.dtypes)["sum"] == "string" else "long"
    met = last.join(left, "token_id", "left")
    single, n = F.col("last.standard").isin(SINGLE_OWNER), F.coalesce("n", F.lit(0))
    burned = F.when(single, F.col("last.event_type") == "burn").otherwise(n == 0)
    one = F.when(burned, 0).otherwise(1).cast("long")
    return met.select("token_id", F.when(single & ~burned, F.col("last.to_address")).alias("owner"), burned.alias("burned"), F.when(single, one).otherwise(n).alias("holders"), F.when(single, one.cast(amount)).otherwise(F.coalesce("sum", F.lit(0).cast(amount))).cast(amount).alias("held"))


def last_provenance(events: DataFrame) -> DataFrame:
    """AGG7: time of each token's last event."""
    return events.groupBy("token_id").agg(F.max("ts").alias("last_provenance_timestamp"))


def ownership_provenance(events: DataFrame, balances: DataFrame, order: list[str]) -> DataFrame:
    """AGG8: of each current owner of a token the last event that brought it there."""
    inbound = events.where(~is_none_address(F.col("to_address"))).groupBy("token_id", F.col("to_address").alias("owner_address"))
    last = inbound.agg(F.max_by(F.struct("ts", "tx_index", "event_type"), F.struct(*order)).alias("e"))
    return last.join(balances.select("token_id", "owner_address"), ["token_id", "owner_address"]).select("token_id", "owner_address", F.col("e.ts").alias("last_timestamp"), F.col("e.tx_index").alias("last_tx_index"), F.col("e.event_type").alias("last_event_type"))


def token_counts(tokens: DataFrame, balances: DataFrame, distinct: bool = True) -> DataFrame:
    """AGG9: for each owner the tokens held or currently owned, and the viewable ones among them.

    With distinct=False a token counts once for each of its balance rows where it is owned by current_owner.
    """
    held = balances.where(V.above_zero(balances, "quantity")).select("token_id", F.col("owner_address").alias("owner"))
    current = tokens.select("token_id", F.col("current_owner").alias("owner"))
    if not distinct:
        rows = balances.select("token_id", F.col("owner_address").alias("holder")).groupBy("token_id").agg(F.count("*").alias("rows"))
        current = current.join(rows, "token_id", "left").withColumn("n", F.coalesce("rows", F.lit(1))).drop("rows")
        both = held.join(current.select("token_id", "owner"), ["token_id", "owner"], "left_anti").withColumn("n", F.lit(1)).unionByName(current)
        return both.join(tokens.select("token_id", "is_viewable"), "token_id").groupBy("owner").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("is_viewable"), F.col("n")).otherwise(0)).alias("viewable"))
    both = held.unionByName(current).distinct().join(tokens.select("token_id", "is_viewable"), "token_id")
    return both.groupBy("owner").agg(F.count("*").alias("total"), F.count_if(F.col("is_viewable")).alias("viewable"))


def group_counts(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in order, with the key's number of rows (AGG11, WIN7-9).

    The numbers are sums that start before the shuffle, and so does the ranking, which sends n rows a key and task at most.
    """
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)
    return first.join(rows.groupBy(key).agg(F.count("*").alias("total")), key)


def dedupe_logs(logs: DataFrame) -> DataFrame:
    """WIN1: one row per block, transaction and log index. Few logs are equal, so none are looked for before the shuffle, and a
    task has a bounded number of them, however many there are (`by_rows`)."""
    key = ["block_number", "tx_index", "log_index"]
    return by_rows(logs, key).dropDuplicates(key)


def first_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def dedupe_ownership(events: DataFrame, order: list[Column]) -> DataFrame:
    """WIN2: the first ownership event of each (transaction, token, sender, receiver, type); other events stay."""
    own = F.col("event_type").isin(OWNERSHIP)
    first = first_per_key(events.where(own), ["tx_hash", "token_id", "from_address", "to_address", "event_type"], order)
    return first.unionByName(events.where(~own))


def unique_provenance(events: DataFrame, order: list[Column]) -> DataFrame:
    """WIN3: the first row of each key; rows with a null sender or receiver are never equal to another."""
    exempt = F.col("from_address").isNull() | F.col("to_address").isNull()
    first = first_per_key(events.where(~exempt), ["tx_hash", "token_id", "from_address", "to_address", "event_type"], order)
    return first.unionByName(events.where(exempt))


def latest_per_key(events: DataFrame, order: list[Column], multi: bool = False) -> DataFrame:
    """WIN4: each token's last event, or each receiver's of a token."""
    return first_per_key(events, ["to_address", "token_id"] if multi else ["token_id"], order)


def ownership_timeline(events: DataFrame, order: list[Column]) -> DataFrame:
    """WIN5: the intervals in which each owner held a token (single-owner tokens); the last one is open."""
    own = events.where(F.col("event_type").isin(OWNERSHIP))
    w = Window.partitionBy("token_id").orderBy(*order)
    spans = own.select("token_id", F.col("to_address").alias("owner"), F.col("ts").alias("acquired_at"), F.lead("ts").over(w).alias("released_at"))
    return spans.where(~is_none_address(F.col("owner")))


def owner_as_of(timeline: DataFrame, times: DataFrame, unit: str = "day") -> DataFrame:
    """The owner at each (token_id, at), null where nobody held the token.

    Starts and ends of intervals and the times asked are one union, cut in buckets of a unit of time. What a bucket begins
    with is the last change of the buckets before it, from one row a token and bucket; within a bucket the last change
    before each time decides. So a token with very many changes or times is spread over its buckets.
    """
    spans = timeline.where("released_at is null or released_at > acquired_at")
    edge = lambda at, owner, place: spans.select("token_id", F.col(at).alias("at"), owner.alias("owner"), F.lit(place).alias("place"))
    # an interval that begins where another ends comes after it, and a time asked after both
    changes = edge("acquired_at", F.col("owner"), 1).unionByName(edge("released_at", F.lit(None).cast("string"), 0).where("at is not null"))
    changes = changes.withColumn("bucket", F.date_trunc(unit, "at"))
    asked = times.select("token_id", "at", F.lit(None).cast("string").alias("owner"), F.lit(2).alias("place")).withColumn("bucket", F.date_trunc(unit, "at"))
    ends = changes.groupBy("token_id", "bucket").agg(F.max_by(F.struct("owner"), F.struct("at", "place")).alias("end"))
    carried = ends.unionByName(asked.select("token_id", "bucket").distinct().withColumn("end", F.lit(None).cast(ends.schema["end"].dataType)))
    carried = carried.groupBy("token_id", "bucket").agg(F.first("end", True).alias("end"))
    before = Window.partitionBy("token_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("token_id", "bucket", F.last("end", True).over(before).alias("begin"))
    rows = changes.unionByName(asked).withColumn("change", F.when(F.col("place") < 2, F.struct("owner")))
    within = Window.partitionBy("token_id", "bucket").orderBy("at", "place").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("last", F.last("change", True).over(within)).where("place = 2")
    return found.join(carried, ["token_id", "bucket"]).select("token_id", "at", F.coalesce("last", "begin")["owner"].alias("owner"))


def block_counts(owned: DataFrame) -> DataFrame:
    """Tokens per owner and block with the running total."""
    w = Window.partitionBy("owner").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return owned.groupBy("owner", "block").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(w))


def block_batches(owned: DataFrame, first: int, following: int) -> DataFrame:
    """WIN11: batches of each owner's tokens in block order, first of `first` tokens, then of `following`, that never
    split a block: a batch ends with the block that fills it.

    A batch is known by the number of tokens before it. From each such number the next batch begins at the least running
    total that is a batch's size further on; batches from the first on are then numbered by following these jumps in
    doubled strides, so n batches take log2(n) joins.
    """
    counted = written(block_counts(owned).select("owner", "block", "n", "upto"), "block-counts")
    totals = counted.select("owner", F.col("upto").alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("from"))
    # totals at or above a number come before it in falling order; the last one seen is the least
    seen = Window.partitionBy("owner").orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, 0)

    def jumps(starts: DataFrame, size: int) -> DataFrame:
        asked = starts.select("owner", (F.col("from") + size).alias("at"), F.lit(1).alias("asks"), "from")
        both = totals.unionByName(asked).withColumn("to", F.last(F.when(F.col("asks") == 0, F.col("at")), True).over(seen))
        return both.where("asks = 1 and to is not null").select("owner", "from", "to")

    begin = jumps(counted.select("owner").distinct().withColumn("from", F.lit(0).cast("long")), first)
    reached = written(begin.select("owner", F.col("to").alias("from"), F.lit(1).cast("long").alias("batch")), "reached")
    stride, jump = 1, written(jumps(counted.select("owner", F.col("upto").alias("from")), following), "jumps")
    while True:
        further = reached.join(jump, ["owner", "from"]).select("owner", F.col("to").alias("from"), (F.col("batch") + stride).alias("batch"))
        further = written(further, "further")
        if further.isEmpty():
            break
        reached = written(reached.unionByName(further), "reached")
        jump = written(jump.join(jump.select("owner", F.col("from").alias("to"), F.col("to").alias("end")), ["owner", "to"]).select("owner", "from", F.col("end").alias("to")), "jumps")
        stride *= 2
    upto = Window.partitionBy("owner").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    begun = counted.withColumn("from", F.col("upto") - F.col("n")).join(reached, ["owner", "from"], "left")
    return begun.select("owner", "block", "n", F.coalesce(F.last("batch", True).over(upto), F.lit(0)).alias("batch"))


def quota_cut(owned: DataFrame, quota: DataFrame) -> DataFrame:
    """WIN12: the longest run of whole blocks within each owner's quota; a first block above it is taken whole."""
    counted = block_counts(owned).join(quota, "owner")
    first = F.col("upto") == F.col("n")
    return counted.where((F.col("quota") > 0) & ((F.col("upto") <= F.col("quota")) | first)).groupBy("owner").agg(F.max("block").alias("last_block"), F.max("upto").alias("tokens"))


def replay_with_limit(events: DataFrame, limit: int, descending: bool = False) -> DataFrame:
    """WIN13: each owner's events read block by block, oldest or newest first, up to the first block end at which the tokens
    held reach the limit while there are more to read. Returns owner, token_id and last_block of the tokens held by then,
    and the range from_block to to_block that was read.

    A single-owner token is held after a transfer to the owner; newest first, its newest transfer decides and older ones
    are passed over. Of others the sum of quantities read so far decides. Whether a token is held changes with its own
    rows only, so the number held is a running sum of these changes.
    """
    single = F.col("standard").isin(SINGLE_OWNER)
    sides = signed_deltas(events).withColumn("to_me", (F.col("address") == F.col("to_address")).cast("int"))
    place = F.struct("block_number", "tx_index", "event_id", F.coalesce("to_me", F.lit(0)))
    rows = V.totalled(sides, ["address", "token_id", "block_number"], "delta", "delta", F.max_by(F.coalesce("to_me", F.lit(0)), place).alias("to_me"), F.first("standard").alias("standard"))
    way = F.desc("block_number") if descending else F.asc("block_number")
    one = Window.partitionBy("address", "token_id").orderBy(way)
    upto = one.rowsBetween(Window.unboundedPreceding, 0)
    decides = F.first("to_me").over(upto) if descending else F.col("to_me")
    rows = V.running(rows.withColumn("__decides", decides == 1), "delta", "__sum", upto)
    rows = rows.withColumn("held", F.when(single, F.col("__decides")).otherwise(V.above_zero(rows, "__sum"))).drop("__decides", "__sum")
    rows = rows.withColumn("change", F.col("held").cast("int") - F.coalesce(F.lag("held").over(one).cast("int"), F.lit(0)))
    whole = Window.partitionBy("address").orderBy(way)
    blocks = rows.groupBy("address", "block_number").agg(F.sum("change").alias("change"))
    blocks = blocks.withColumn("n", F.sum("change").over(whole.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("block_number").over(whole))
    full = F.when((F.col("n") >= limit) & F.col("next").isNotNull(), F.col("block_number"))
    cut = blocks.groupBy("address").agg((F.max if descending else F.min)(full).alias("cut"), F.min("block_number").alias("lo"), F.max("block_number").alias("hi"))
    cut = cut.select("address", *((F.coalesce("cut", "lo").alias("from_block"), F.col("hi").alias("to_block")) if descending else (F.col("lo").alias("from_block"), F.coalesce("cut", "hi").alias("to_block"))))
    read = rows.join(cut, "address").where(F.col("block_number").between(F.col("from_block"), F.col("to_block")))
    after = F.max_by if not descending else F.min_by  # the state after the last block that was read
    held = read.groupBy("address", "token_id", "from_block", "to_block").agg(after("held", "block_number").alias("held"), F.max("block_number").alias("last_block"))
    return held.where("held").select(F.col("address").alias("owner"), "token_id", "last_block", "from_block", "to_block")


def scan_windows(ranges: DataFrame, width: int) -> DataFrame:
    """WIN14: fixed windows (lo, hi) over each row's min_block to max_block."""
    start = F.explode(F.sequence("min_block", "max_block", F.lit(width)))
    return ranges.withColumn("lo", start).withColumn("hi", F.least(F.col("lo") + width - 1, F.col("max_block")))


def chunk_info(tokens: DataFrame, key: str) -> DataFrame:
    """AGG16: block range and sorted token list of each batch."""
    return tokens.groupBy(key).agg(F.min("block").alias("min_block"), F.max("block").alias("max_block"), F.sort_array(F.collect_list("token_id")).alias("tokens"))


def failure_streak(jobs: DataFrame) -> DataFrame:
    """AGG15: each address's latest ended job, and its failures since the last success or cancel. Running and paused jobs
    don't count."""
    jobs = jobs.where(F.col("status").isin("completed", "failed", "canceled"))
    reset = F.max(F.when(F.col("status").isin("completed", "canceled"), F.col("id"))).over(Window.partitionBy("chain", "address"))
    return jobs.withColumn("reset", F.coalesce(reset, F.lit(-1))).groupBy("chain", "address").agg(F.max_by(F.struct("status", "ended_at"), "id").alias("last"), F.count_if((F.col("status") == "failed") & (F.col("id") > F.col("reset"))).alias("streak")).select("chain", "address", F.col("last.status").alias("status"), F.col("last.ended_at").alias("ended_at"), "streak")


def retry_at(streaks: DataFrame, cooldown: int, base: int, cap: int) -> DataFrame:
    """QRY14: when an address may be scanned again, in seconds from its last job's end: a cooldown after success, doubled
    waits up to a cap after failures, no wait after a cancel."""
    wait = F.when(F.col("status") == "completed", F.lit(cooldown)).when(F.col("status") == "failed", F.least(F.lit(cap), (F.lit(base) * F.pow(F.lit(2), F.least(F.greatest(F.col("streak") - 1, F.lit(0)), F.lit(30)))).cast("long"))).otherwise(F.lit(0))
    return streaks.withColumn("wait_seconds", wait.cast("long"))
