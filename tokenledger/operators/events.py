"""Chain logs and feeds decoded to one event form, in column expressions.

A log has address, topics (hex texts), data (hex text), block_number, tx_hash, tx_index, log_index and block_time. An
event has contract, token_number (decimal text), event_type, from_address, to_address, quantity (decimal text) and the
log's place and time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import ZERO_ADDRESS, cid_valid, event_type, is_none_address, normalise_address
from ..functions.values import nines_of_hex, once
from ..session import written

# Hashes of event signatures.
TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
TRANSFER_SINGLE = "0xc3d58168c5ae7397731d063d5bbf3d657854427343f4c083240f7aacaa2d0f62"
TRANSFER_BATCH = "0x4a39dc06d4c0dbc64b70af90fd698a233a518aa5d07e595d983b8c0526c8f7fb"
URI = "0x6bb7ff708619ba0610cba295a58592e0451dee2622938c8755667688daf3529b"
METADATA_UPDATE = "0xf8e1a15aba9398e019f0b49df1a4fde98ee17ae345cb5f6b5e2c27f5033e8ce7"
BATCH_METADATA_UPDATE = "0x6bd5c950a8d8df17f772f5af37cb3655737899cbf903264b9795592da439661c"

PLACE = ["block_number", "tx_hash", "tx_index", "log_index", "block_time"]


def topic(i: int) -> Column:
    return F.get("topics", i)


def topic_address(i: int) -> Column:
    return F.lower(F.concat(F.lit("0x"), F.substring(topic(i), 27, 40)))


def word(data: Column, i: Column | int) -> Column:
    """The i-th 32-byte word of hex data after 0x, without a prefix; null where the data is shorter."""
    at = (F.lit(i) if isinstance(i, int) else i) * 64
    found = F.substr(data, (at + 3).cast("int"), F.lit(64))
    return F.when(F.length(found) == 64, found)


def hex_to_decimal(hex_: Column) -> Column:
    """Decimal text of up to 64 hex digits; null for what isn't. Numbers below 2^60, whose first 49 digits are zeros, are read
    at once; only others are read 32 bits at a time into three limbs of 26 decimal digits."""
    wide = F.when(F.length(hex_) == 64, hex_).otherwise(F.when(F.length(hex_).between(1, 63), F.lpad(hex_, 64, "0")))
    small = F.substring(wide, 1, 49) == "0" * 49
    return F.when(F.unhex(wide).isNotNull(), F.when(small, F.conv(F.substring(wide, 50, 15), 16, 10)).otherwise(_wide(F.lower(wide))))


def _wide(digits: Column) -> Column:
    chunks = lambda d: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(F.substr(d, k * 8 + 1, F.lit(8)), 16, 10).cast("decimal(38,0)"))
    dec = lambda c: c.cast("decimal(38,0)")
    base, shift = F.lit("1" + "0" * 26).cast("decimal(27,0)"), F.lit(1 << 32).cast("decimal(10,0)")
    zero = dec(F.lit(0))

    def step(acc: Column, c: Column) -> Column:
        low = dec(acc["l"] * shift) + c
        mid = dec(acc["m"] * shift) + dec((dec(low) - dec(low % base)) / base)
        more = dec((dec(mid) - dec(mid % base)) / base)
        return F.struct(dec(low % base).alias("l"), dec(mid % base).alias("m"), dec(dec(acc["h"] * shift) + more).alias("h"))

    n = F.transform(F.array(digits), lambda d: F.aggregate(chunks(d), F.struct(zero.alias("l"), zero.alias("m"), zero.alias("h")), step))
    text = F.transform(n, lambda x: F.concat(x["h"].cast("string"), F.lpad(x["m"].cast("string"), 26, "0"), F.lpad(x["l"].cast("string"), 26, "0")))
    return F.regexp_replace(text[0], "^0+(?=.)", "")


def _event(logs: DataFrame, sender: Column, receiver: Column, number: Column, quantity: Column) -> DataFrame:
    return logs.select(F.lower("address").alias("contract"), number.alias("token_number"), event_type(sender, receiver).alias("event_type"), sender.alias("from_address"), receiver.alias("to_address"), quantity.alias("quantity"), *PLACE)


def decode_721(logs: DataFrame) -> DataFrame:
    """EVT1: transfers with four topics; those with three are of fungible tokens and left out."""
    own = logs.where((topic(0) == TRANSFER) & (F.size("topics") == 4))
    return _event(own, topic_address(1), topic_address(2), hex_to_decimal(F.substring(topic(3), 3, 64)), F.lit("1"))


def decode_1155_single(logs: DataFrame, text: bool = True) -> DataFrame:
    """EVT2: sender and receiver in topics 2 and 3, token and value in the data; shorter data is left out. Without `text`, quantity
    is nines instead of decimal text, for sums."""
    own = logs.where((topic(0) == TRANSFER_SINGLE) & (F.size("topics") == 4) & (F.length("data") >= 130))
    own = _step(own, sender=topic_address(2), receiver=topic_address(3), number=F.substring("data", 3, 64), value=F.substring("data", 67, 64))
    own = own if text else nines_of_hex(own, "__value", "__value")
    return _event(own, F.col("__sender"), F.col("__receiver"), hex_to_decimal(F.col("__number")), hex_to_decimal(F.col("__value")) if text else F.col("__value"))


def decode_1155_batch(logs: DataFrame) -> DataFrame:
    """EVT3: a row for each pair of the two arrays in the data. Arrays of unequal lengths, cut short, or at an offset that isn't
    a whole word or doesn't fit in 60 bits are left out."""
    data = F.col("data")
    number = lambda w: F.when(F.substring(w, 1, 49) == "0" * 49, F.conv(F.substring(w, 50, 15), 16, 10).try_cast("bigint"))
    own = logs.where((topic(0) == TRANSFER_BATCH) & (F.size("topics") == 4)).withColumn("__size", F.length(data))
    # each step is a generator of a row, so that what it reads from the data is read once, and not again for each use
    own = _step(own, a=word(data, 0), b=word(data, 1))
    own = _step(own, a=number(F.col("__a")), b=number(F.col("__b"))).where("__a % 32 = 0 and __b % 32 = 0 and __size >= 2 + 2 * greatest(__a, __b) + 64")
    own = _step(own, a=F.expr("__a div 32"), b=F.expr("__b div 32"), n=F.expr("substr(data, int(2 * __a + 3), 64)"), m=F.expr("substr(data, int(2 * __b + 3), 64)"))
    own = _step(own, n=number(F.col("__n")), m=number(F.col("__m")))
    whole = own.where("__n = __m and __n between 1 and (__size - 2) div 64 and __size >= 2 + 64 * (greatest(__a, __b) + 1 + __n)")
    pairs = F.expr("transform(sequence(1L, __n), k -> struct(substr(data, int(64 * (__a + k) + 3), 64) AS x, substr(data, int(64 * (__b + k) + 3), 64) AS y))")
    each = whole.select("address", "topics", *PLACE, F.inline(pairs))
    return _event(each, topic_address(2), topic_address(3), hex_to_decimal(F.col("x")), hex_to_decimal(F.col("y")))


def _step(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with the columns __name, each computed once a row."""
    return once(rows, **{f"__{k}": c for k, c in columns.items()})


def decode_metadata(logs: DataFrame) -> DataFrame:
    """EVT4: metadata updates of one token or a range, the numbers in data or topics, and URI events; malformed ones are left out."""
    data = F.col("data")
    first = F.when(F.size("topics") > 1, F.substring(topic(1), 3, 64)).otherwise(word(data, 0))
    last = F.when(topic(0) == BATCH_METADATA_UPDATE, F.when(F.size("topics") > 2, F.substring(topic(2), 3, 64)).otherwise(word(data, 1)))
    own = logs.where(topic(0).isin(METADATA_UPDATE, BATCH_METADATA_UPDATE, URI))
    ok = first.isNotNull() & ((topic(0) != BATCH_METADATA_UPDATE) | last.isNotNull())
    return own.where(ok).select(F.lower("address").alias("contract"), hex_to_decimal(first).alias("token_number"), F.when(last.isNotNull(), hex_to_decimal(last)).alias("to_token_number"), F.lit("metadata_update").alias("event_type"), *PLACE)


def decode_configured(logs: DataFrame, config: DataFrame) -> DataFrame:
    """EVT5: legacy events by configuration rows (contract, topic0, from_topic, to_topic, number_topic, number_word): a topic
    index for each part, or a data word for the number; a missing index is nobody."""
    c = config.select(F.lower("contract").alias("__c"), F.col("topic0").alias("__t"), "from_topic", "to_topic", "number_topic", "number_word")
    met = logs.join(c, (F.lower("address") == F.col("__c")) & (topic(0) == F.col("__t")))
    at = lambda name: F.when(F.col(name).isNotNull(), F.lower(F.concat(F.lit("0x"), F.substring(F.get("topics", F.col(name)), 27, 40)))).otherwise(F.lit(ZERO_ADDRESS))
    raw = F.when(F.col("number_topic").isNotNull(), F.substring(F.get("topics", F.col("number_topic")), 3, 64)).otherwise(word(F.col("data"), F.col("number_word")))
    return _event(met.where(raw.isNotNull()), at("from_topic"), at("to_topic"), hex_to_decimal(raw), F.lit("1"))


def normalise_transfers(feed: DataFrame) -> DataFrame:
    """EVT6: a transfer feed; absent addresses are empty, and the row's id stands for its place in the level."""
    sender, receiver = F.coalesce("from.address", F.lit("")), F.coalesce("to.address", F.lit(""))
    return feed.select(F.col("token.contract.address").alias("contract"), F.col("token.tokenId").alias("token_number"), event_type(sender, receiver).alias("event_type"), sender.alias("from_address"), receiver.alias("to_address"), F.col("amount").alias("quantity"), F.col("level").alias("block_number"), F.col("transaction_id"), F.col("id").alias("tx_index"), F.col("id").alias("log_index"), F.col("timestamp").try_cast("timestamp").alias("block_time"))


def normalise_bigmaps(feed: DataFrame) -> DataFrame:
    """EVT7: token metadata updates of a big-map feed."""
    return feed.select(F.col("contract.address").alias("contract"), F.col("content.key").alias("token_number"), F.lit("metadata_update").alias("event_type"), F.lit("").alias("from_address"), F.lit("").alias("to_address"), F.lit("1").alias("quantity"), F.col("level").alias("block_number"), F.col("transaction_id"), F.col("id").alias("tx_index"), F.col("id").alias("log_index"), F.col("timestamp").try_cast("timestamp").alias("block_time"))


def attach_tx_hash(events: DataFrame, transactions: DataFrame) -> DataFrame:
    """EVT8: the hash of transaction_id, empty where it isn't known."""
    known = transactions.select(F.col("id").alias("transaction_id"), F.col("hash").alias("__h"))
    return events.join(known, "transaction_id", "left").withColumn("tx_hash", F.coalesce("__h", F.lit(""))).drop("__h")


def attach_metadata_tx(events: DataFrame, transactions: DataFrame) -> DataFrame:
    """EVT9: events without a transaction take the first one of their contract and level that touches token metadata."""
    first = transactions.where(F.exists("diffs", lambda d: d == "token_metadata")).groupBy(F.col("contract"), F.col("level").alias("block_number")).agg(F.min_by("hash", "id").alias("__h"))
    return events.join(first, ["contract", "block_number"], "left").withColumn("tx_hash", F.coalesce("tx_hash", "__h", F.lit(""))).drop("__h")


def attach_block_time(events: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EVT10: (events with the log's time, else the block's; events that have neither)."""
    b = blocks.select("block_number", F.col("block_time").alias("__t"))
    met = events.join(b, "block_number", "left").withColumn("block_time", F.coalesce("block_time", "__t")).drop("__t")
    return met.where("block_time is not null"), met.where("block_time is null")


def split_valid(events: DataFrame, cid: Column) -> tuple[DataFrame, DataFrame]:
    """EVT12: (valid events, rejects): a valid token id, a quantity that is a positive 64-bit number, and the addresses that
    the type asks for: a mint has a receiver only, a burn a sender only, a transfer both, a metadata update none."""
    q = F.col("quantity").cast("string")
    fits = q.rlike("^[0-9]{1,20}$") & (q.try_cast("decimal(20,0)") > 0) & (q.try_cast("decimal(20,0)") <= F.lit("18446744073709551615").cast("decimal(20,0)"))
    nobody, noone = is_none_address(F.col("from_address")), is_none_address(F.col("to_address"))
    kind = F.col("event_type")
    shape = F.when(kind == "mint", nobody & ~noone).when(kind == "burn", ~nobody & noone).when(kind == "transfer", ~nobody & ~noone).when(kind == "metadata_update", nobody & noone).otherwise(F.lit(False))
    ok = F.coalesce(cid_valid(cid) & fits & shape, F.lit(False))
    marked = events.withColumn("__ok", ok)
    return marked.where("__ok").drop("__ok"), marked.where("not __ok").drop("__ok")


def repair_sales(events: DataFrame, logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EVT13: (sales with the buyer filled in, sales that have none): the buyer is the receiver of the first three-topic
    transfer of value 0 or 1 by the same seller in the same transaction of the same contract."""
    value = F.conv(F.substring(word(F.col("data"), 0), 49, 16), 16, 10).try_cast("bigint")
    # 128 bits for the three texts of a sale, which are longer than all else that is shuffled
    sale = F.unhex(F.md5(F.concat("contract", F.lit("\n"), "tx_hash", F.lit("\n"), "from_address"))).alias("__sale")
    inner = logs.where((topic(0) == TRANSFER) & (F.size("topics") == 3) & value.isin(0, 1)).select(F.lower("address").alias("contract"), "tx_hash", topic_address(1).alias("from_address"), topic_address(2).alias("__to"), F.col("log_index").alias("__at"))
    # few sales have several logs, so none are looked for before the shuffle
    buyer = inner.select(sale, "__to", "__at").where("__sale is not null").repartition("__sale").groupBy("__sale").agg(F.min_by("__to", "__at").alias("__buyer"))
    met = events.withColumn("__sale", F.coalesce(sale, F.col("tx_hash").cast("binary"))).join(buyer, "__sale", "left").drop("__sale")
    open_ = is_none_address(F.col("to_address"))
    done = met.withColumn("to_address", F.when(open_, F.col("__buyer")).otherwise(F.col("to_address"))).withColumn("event_type", event_type(F.col("from_address"), F.col("to_address")))
    return done.where("to_address is not null").drop("__buyer"), done.where("to_address is null").drop("__buyer")


def recover_sales(events: DataFrame, logs: DataFrame, owner: str) -> DataFrame:
    """EVT14: sales that lost their buyer and were to this owner, found from the inner transfers to the owner."""
    mine = logs.where((F.size("topics") == 3) & (topic_address(2) == owner.lower()))
    mine = written(mine.select("address", "topics", "data", "tx_hash", "log_index"), "owner-logs")  # of known size, so Spark sends it to the sales where it is small
    some = events.where(is_none_address(F.col("to_address"))).join(mine.select("tx_hash").distinct(), "tx_hash", "left_semi")
    return repair_sales(some, mine)[0]


def merge_feeds(transfers: DataFrame, metadata: DataFrame) -> DataFrame:
    """EVT15: one ordered feed by time, block and place, transfers before metadata where equal."""
    both = transfers.withColumn("feed", F.lit(0)).unionByName(metadata.withColumn("feed", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("block_time", "block_number", "tx_index", "feed", "log_index")


def numbered(events: DataFrame) -> DataFrame:
    """Each event's place in its token's order (time, transaction and log index)."""
    w = Window.partitionBy("contract", "token_number").orderBy("block_time", "block_number", "tx_index", "log_index")
    return events.withColumn("place", F.row_number().over(w))


def canonical_addresses(events: DataFrame) -> DataFrame:
    return events.withColumns({c: normalise_address(F.col(c)) for c in ("from_address", "to_address")})
