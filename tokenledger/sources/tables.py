"""Tables with fixed schemas, feeds and registries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "raw_log": "address string, topics array<string>, data binary, block_number bigint, block_hash string, tx_hash string, tx_index int, log_index int, block_time timestamp",
    "transfer_feed": "id bigint, level bigint, timestamp string, token struct<contract:struct<address:string>,tokenId:string,standard:string>, `from` struct<address:string>, `to` struct<address:string>, amount string, transaction_id bigint",
    "bigmap_feed": "id bigint, level bigint, timestamp string, contract struct<address:string>, path string, content struct<key:string>, transaction_id bigint",
    "event": "chain string, standard string, contract_address string, token_number string, to_token_number string, event_type string, from_address string, to_address string, quantity string, tx_hash string, block_number bigint, block_hash string, timestamp timestamp, tx_index bigint, log_index bigint",
}


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """SRC1: a table by its fixed schema; nothing is inferred and only these columns are read."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def address_topic(address: str) -> str:
    """An address as the 32-byte topic that indexes it."""
    return "0x" + address.lower().removeprefix("0x").rjust(64, "0")


def owner_predicate(specs: list[tuple[list[str], int]], owner: str) -> Column:
    """SRC3: one predicate of several (signatures, topic index) specs: those of one topic index share a test."""
    by_index: dict[int, list[str]] = {}
    for signatures, index in specs:
        by_index.setdefault(index, []).extend(x for x in signatures if x not in by_index.get(index, []))
    parts = [F.get("topics", 0).isin(sigs) & (F.lower(F.get("topics", index)) == address_topic(owner)) for index, sigs in sorted(by_index.items())]
    return F.coalesce(reduce(lambda a, b: a | b, parts), F.lit(False))


def scan_logs(logs: DataFrame, signatures: list[str], lo: int, hi: int, owner: str | None = None, topic_index: int | None = None, contracts: list[str] | None = None) -> DataFrame:
    """SRC2: logs of a block range by event signature, and by owner in a topic and by contract where these are given."""
    out = logs.where(F.col("block_number").between(lo, hi) & F.get("topics", 0).isin(signatures))
    if owner is not None and topic_index is not None:
        out = out.where(F.lower(F.get("topics", topic_index)) == address_topic(owner))
    return out.where(F.lower("address").isin([c.lower() for c in contracts])) if contracts else out


@dataclass
class LogTable:
    """Raw logs in a folder by block range, of `width` blocks each, and event signature; a scan lists and reads only the
    folders that it asks for. A signature with most logs has as many files in a range as tasks wrote it."""

    spark: SparkSession
    path: str
    width: int = 100_000

    def append(self, logs: DataFrame) -> None:
        """Adds logs; a task writes few folders, and a range with very many logs of a signature goes over several tasks."""
        placed = self._placed(logs).withColumn("signature", F.coalesce(F.get("topics", 0), F.lit("none")))
        dealt = placed.repartition("block_range", "signature", F.pmod(F.xxhash64("tx_hash", "log_index"), F.lit(8)))
        self._write(dealt)

    def append_made(self, rows: DataFrame, log: list[Column]) -> None:
        """Adds logs that are made of smaller rows, a log a row: `log` has its columns; signature, its first topic, is in the row.
        Rows are sorted by folder in the tasks that have them, and a log is made where it is written, so its texts are neither
        shuffled nor sorted. A task writes a file to each folder that it has logs of."""
        placed = self._placed(rows).sortWithinPartitions("block_range", "signature")
        self._write(placed.select(*log, "block_range", "signature"))

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("block_range", F.floor(F.col("block_number") / self.width))

    def _write(self, placed: DataFrame) -> None:
        """A hex digit holds four bits, which zstd makes use of, and texts and numbers are much like those before them (v2)."""
        placed.write.mode("append").option("compression", "zstd").option("parquet.writer.version", "v2").partitionBy("block_range", "signature").parquet(self.path)

    def scan(self, signatures: list[str], lo: int, hi: int, owner: str | None = None, topic_index: int | None = None, contracts: list[str] | None = None) -> DataFrame:
        """SRC2 on the table: scan_logs over the folders of the range and signatures."""
        stored = self.spark.read.parquet(self.path)
        some = stored.where(F.col("block_range").between(lo // self.width, hi // self.width) & F.col("signature").isin(signatures))
        return scan_logs(some, signatures, lo, hi, owner, topic_index, contracts).drop("block_range", "signature")


@dataclass
class FeedTable:
    """Change rows (with owner_address and created_at) in a folder by day and bucket of the owner, those to everybody (without
    an owner) in a bucket of their own: a sync of one owner reads two buckets of the days since its checkpoint."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def append(self, feed: DataFrame) -> None:
        placed = feed.withColumn("day", F.to_date("created_at")).withColumn("bucket", F.when(F.col("owner_address").isNull(), -1).otherwise(self._bucket(F.col("owner_address"))))
        dealt = placed.repartition("day", "bucket", F.pmod(F.xxhash64("id"), F.lit(4)))
        dealt.write.mode("append").partitionBy("day", "bucket").parquet(self.path)

    def since(self, owner: str, at: Column) -> DataFrame:
        """Rows of one owner and to everybody, from the day of `at` on."""
        stored = self.spark.read.parquet(self.path)
        some = stored.where((F.col("day") >= F.to_date(at)) & ((F.col("bucket") == -1) | (F.col("bucket") == self._bucket(F.lit(owner)))))
        return some.where(F.col("owner_address").isNull() | (F.col("owner_address") == owner)).drop("day", "bucket")

    def _bucket(self, owner: Column) -> Column:
        return F.pmod(F.crc32(owner.cast("binary")), F.lit(self.buckets)).cast("int")


def transfers(feed: DataFrame, lo: int, hi: int) -> DataFrame:
    return feed.where(F.col("level").between(lo, hi)).orderBy("level", "id")


def bigmaps(feed: DataFrame, lo: int, hi: int) -> DataFrame:
    return feed.where(F.col("level").between(lo, hi) & (F.element_at(F.split("path", "\\."), -1) == "token_metadata"))


def account_balances(deltas: DataFrame, account: str, blacklist: DataFrame) -> DataFrame:
    """SRC6: an account's balances other than zero, without listed tokens."""
    held = deltas.where(F.col("address") == account).groupBy("token_id").agg(F.sum("delta").alias("quantity")).where("quantity <> 0")
    return held.join(blacklist, "token_id", "left_anti")


def load_publishers(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: registry JSON (a list of name, url and per chain collections and deployers) as (chain, kind, key, publisher, url) rows."""
    chains = "map<string,struct<collection_addresses:array<string>,deployer_addresses:array<string>>>"
    rows = spark.read.schema(f"name string, url string, chains {chains}").json(path, multiLine=True)
    each = rows.select("name", "url", F.explode("chains").alias("chain", "x"))
    kind = lambda field, name: each.select("chain", F.lit(name).alias("kind"), F.explode(f"x.{field}").alias("key"), F.col("name").alias("publisher"), "url")
    return kind("collection_addresses", "collection").unionByName(kind("deployer_addresses", "deployer")).withColumn("key", F.lower("key"))


def load_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: JSON of chain to contract list as (chain, contract) rows in lower case."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("chain", "contracts"))
    return parsed.select("chain", F.explode(F.transform("contracts", F.lower)).alias("contract"))
