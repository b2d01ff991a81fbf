"""Streams of chain events: ordered intake, deduplication, alignment of two feeds, running holdings, render gates, change feed.

Jobs whose decisions are about a chain's head (STR1, STR3, STR5) handle a micro-batch as a set: heads are grouped maxima, and
what has to wait is a table beside the output, so no chain's rows meet in one task. What a batch starts from is what the
batches before it left, by number, so a batch that runs twice gives the same. Other state is kept by key in Spark's store.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import values as V
from ..operators.selection import match_clients
from ..session import scratch_dir


def run_available(stream: DataFrame, name: str, each_batch: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None, top: str | None = None) -> DataFrame | None:
    """Runs a stream over what is there now and returns what it wrote (append mode), or hands batches to each_batch. With
    `top`, a folder of an earlier run, the stream goes on from there, and what both wrote is returned."""
    spark = stream.sparkSession
    top = top or f"{scratch_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{top}/checkpoint")
    if each_batch:
        writer.foreachBatch(each_batch).start().awaitTermination()
        return None
    writer.format("parquet").option("path", f"{top}/out").outputMode("append").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/out")


KEEP = 100  # batches by which a job can be set back


@dataclass
class BatchTables:
    """Tables of a job by batch: `name` as batch `at` left it. A batch overwrites its own version only, and starts from the
    latest version before it, so that one that runs twice starts from the same."""

    spark: SparkSession
    path: str

    def write(self, df: DataFrame, name: str, at: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch_id={at}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}/batch_id={at}")

    def _folder(self, name: str) -> tuple[Any, Any]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        """Batches that have left a whole version; one that was cut short has none."""
        path, fs = self._folder(name)
        found = [x.getPath() for x in fs.listStatus(path)] if fs.exists(path) else []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(x.getName().partition("=")[2]) for x in found if fs.exists(done(x, "_SUCCESS")))

    def before(self, name: str, at: int, schema: str) -> DataFrame:
        """The version of the latest batch before `at`; empty if there is none."""
        last = max((x for x in self.versions(name) if x < at), default=None)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/batch_id={last}") if last is not None else self.spark.createDataFrame([], schema)

    def all(self, name: str, schema: str) -> DataFrame:
        if not self.versions(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, batch_id int").parquet(f"{self.path}/{name}").drop("batch_id")

    def of(self, name: str, batches: list[int], schema: str) -> DataFrame:
        """The versions of some batches, and no other files."""
        paths = [f"{self.path}/{name}/batch_id={k}" for k in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def clock(self, at: int, now: float | None) -> float:
        """The time of batch `at` in seconds since 1970: `now`, else the clock, when it runs first; the same when it runs again."""
        if at not in self.versions("clock"):
            self.write(self.spark.createDataFrame([(time.time() if now is None else float(now),)], "now double").coalesce(1), "clock", at)
        return self.spark.read.schema("now double").parquet(f"{self.path}/clock/batch_id={at}").first()[0]

    def expire(self, names: list[str], at: int, kept: set[int] | None = None) -> None:
        """Removes versions that none of the last KEEP batches up to `at` starts from, but those in `kept`. As in Spark's own
        checkpoints, a job can be set back by that many batches."""
        for name in names:
            path, fs = self._folder(name)
            older = [x for x in self.versions(name) if x < at - KEEP]
            for x in older[:-1] if kept is None else [x for x in older if x not in kept]:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"batch_id={x}"), True)


CURSOR = "chain string, block_number long"


@dataclass
class OrderedIngest:
    """STR1: events appended in whole blocks of each chain. Blocks below a chain's cursor are dropped, its own block is
    processed again, higher ones move it on. A batch starts from the cursors that the batches before it left, or from those
    given, so one that runs twice, also after a restart, writes the same."""

    spark: SparkSession
    path: str
    cursors: DataFrame  # chain, block_number

    def batch(self, events: DataFrame, batch_id: int) -> None:
        tables = BatchTables(self.spark, self.path)
        moved = tables.before("cursors", batch_id, CURSOR)
        cursor = self.cursors.select("chain", "block_number").unionByName(moved).groupBy("chain").agg(F.max("block_number").alias("__cursor"))
        fresh = events.join(cursor, "chain", "left").where(F.col("__cursor").isNull() | (F.col("block_number") >= F.col("__cursor"))).drop("__cursor")
        done = tables.write(fresh.repartition("chain", "block_number").sortWithinPartitions("chain", "block_number", "tx_index"), "events", batch_id)
        heads = done.select("chain", "block_number").unionByName(cursor.toDF("chain", "block_number")).groupBy("chain").agg(F.max("block_number").alias("block_number"))
        tables.write(heads.coalesce(1), "cursors", batch_id)  # one row a chain
        tables.expire(["cursors"], batch_id)

    def run(self, stream: DataFrame) -> DataFrame:
        run_available(stream, "ingest", self.batch, f"{self.path}/checkpoint")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
        return BatchTables(self.spark, self.path).all("events", schema)


def dedupe_stream(stream: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """STR2: the first event of each key, for as long as copies may come late."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


FEED = "chain string, level bigint, feed string, id bigint, payload string"
LEVELS = "chain string, level bigint, arrived bigint, since double"


@dataclass
class LevelAlign:
    """STR3: rows (chain, level, feed, id, payload) of two feeds, released by level once both feeds are past it, transfers
    before metadata. A chain with more than max_levels waiting releases its lowest ones, and a level that has waited longer
    than timeout seconds since its first row goes out; rows of a level already released are dropped. reason says which.

    Rows are written once, as they arrive. What waits is a table of levels with the batches in which they arrived, so a
    release reads these batches' rows and no others, and the rows of a batch go when none of its levels waits. A batch's
    time is stored when it first runs, so one that runs again, at whatever time, gives the same."""

    spark: SparkSession
    path: str
    max_levels: int
    timeout: int

    def batch(self, rows: DataFrame, batch_id: int, now: float | None = None) -> None:
        """now: seconds since 1970, else the clock."""
        tables = BatchTables(self.spark, self.path)
        at = F.lit(tables.clock(batch_id, now))
        heads = tables.before("heads", batch_id, "chain string, feed string, level bigint")
        sealed = tables.before("sealed", batch_id, "chain string, sealed bigint")
        before = tables.before("levels", batch_id, LEVELS)
        new = rows.join(sealed, "chain", "left").where("sealed is null or level > sealed").select("chain", "level", "feed", "id", "payload")
        new = tables.write(new, "arrived", batch_id)
        heads = tables.write(heads.unionByName(rows.select("chain", "feed", "level")).groupBy("chain", "feed").agg(F.max("level").alias("level")).coalesce(1), "heads", batch_id)
        both = heads.groupBy("chain").agg(F.when(F.count("*") == 2, F.min("level")).alias("both"))
        met = before.unionByName(new.select("chain", "level").distinct().select("chain", "level", F.lit(batch_id).cast("bigint").alias("arrived"), at.cast("double").alias("since")))
        levels = met.groupBy("chain", "level").agg(F.min("since").alias("first")).join(both, "chain", "left").withColumn("aligned", F.coalesce(F.col("level") < F.col("both"), F.lit(False)))
        rank = F.row_number().over(Window.partitionBy("chain").orderBy(F.desc("level")))  # a limit that starts before the shuffle
        least = levels.where("not aligned").withColumn("k", rank).where(F.col("k") <= self.max_levels).groupBy("chain").agg(F.min("level").alias("least"))
        reason = F.when(F.col("aligned"), "aligned").when(F.col("first") <= at - self.timeout, "timeout").when(F.col("level") < F.col("least"), "overflow")
        judged = levels.join(least, "chain", "left").select("chain", "level", reason.alias("reason"))
        judged = tables.write(met.join(judged, ["chain", "level"]), "judged", batch_id)
        out = judged.where("reason is not null")
        # a micro-batch number each, at most as many as levels can wait
        batches = [r[0] for r in out.select("arrived").distinct().collect()]
        parts = [tables.of("arrived", [k], FEED).withColumn("arrived", F.lit(k).cast("bigint")) for k in batches]
        held = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{FEED}, arrived bigint")
        released = held.join(out.select("chain", "level", "arrived", "reason"), ["chain", "level", "arrived"]).select("chain", "level", "feed", "id", "payload", "reason")
        tables.write(released.repartition("chain", "level").sortWithinPartitions("chain", "level", F.desc("feed"), "id"), "released", batch_id)
        waiting = tables.write(judged.where("reason is null").drop("reason").coalesce(1), "levels", batch_id)  # bounded: levels that wait
        tables.write(sealed.unionByName(out.select("chain", F.col("level").alias("sealed"))).groupBy("chain").agg(F.max("sealed").alias("sealed")).coalesce(1), "sealed", batch_id)
        tables.expire(["heads", "sealed", "levels", "judged", "clock"], batch_id)
        tables.expire(["arrived"], batch_id, {r[0] for r in before.unionByName(waiting).select("arrived").distinct().collect()})

    def run(self, stream: DataFrame) -> DataFrame:
        run_available(stream, "align", self.batch, f"{self.path}/checkpoint")
        return BatchTables(self.spark, self.path).all("released", f"{FEED}, reason string")


def backfill_handoff(transfers: DataFrame, metadata: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """STR4: (history rows, live rows) that meet without a gap or an overlap. The two feeds' histories are whole below the lower
    of their last levels, so history ends there, and the live stream begins with that level. All have chain and level; a
    chain without history in both feeds is left to the stream."""
    last = transfers.select("chain", "level", F.lit(0).alias("f")).unionByName(metadata.select("chain", "level", F.lit(1).alias("f"))).groupBy("chain", "f").agg(F.max("level").alias("head"))
    head = last.groupBy("chain").agg(F.when(F.count("*") == 2, F.min("head")).alias("__head")).where("__head is not null")
    past = transfers.unionByName(metadata).join(head, "chain").where("level < __head").drop("__head")
    return past, live.join(head, "chain", "left").where("__head is null or level >= __head").drop("__head")


BLOCK = "chain string, block_number bigint, id bigint"
CLOCK = "__clock"  # the chain of a heartbeat


def with_heartbeat(stream: DataFrame) -> DataFrame:
    """A stream of blocks with a row of no chain each second, so that batches come, and time passes, also without new blocks."""
    beat = stream.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    return stream.select("chain", "block_number", "id").unionByName(beat.select(F.lit(CLOCK).alias("chain"), F.lit(0).cast("bigint").alias("block_number"), F.lit(0).cast("bigint").alias("id")))


@dataclass
class IdleFlush:
    """STR5: rows (chain, block_number, id) in whole blocks: a block goes out when a higher one of its chain comes, or when
    its chain had no new rows for `idle` seconds (flushed is true). Rows that come later for a flushed block go out as rows of
    a new head. A batch does both, under its own number and with the time stored when it first ran, so no row goes out
    twice, whatever batch runs again."""

    spark: SparkSession
    path: str
    idle: float = 30.0

    def batch(self, rows: DataFrame, batch_id: int, now: float | None = None) -> None:
        tables = BatchTables(self.spark, self.path)
        at = F.lit(tables.clock(batch_id, now)).cast("double")
        new = rows.where(F.col("chain") != CLOCK).select("chain", "block_number", "id").withColumn("since", at)
        met = tables.before("waiting", batch_id, f"{BLOCK}, since double").unionByName(new)
        head = met.groupBy("chain").agg(F.max("block_number").alias("head"), F.max("since").alias("seen"))
        flushed = F.col("block_number") == F.col("head")
        out = ~flushed | (F.col("seen") <= at - self.idle)
        met = tables.write(met.join(head, "chain").select("chain", "block_number", "id", F.col("seen").alias("since"), flushed.alias("flushed"), out.alias("out")), "met", batch_id)
        tables.write(met.where("out").select("chain", "block_number", "id", "flushed"), "blocks", batch_id)
        tables.write(met.where("not out").select("chain", "block_number", "id", "since"), "waiting", batch_id)  # heads only
        tables.expire(["waiting", "met", "clock"], batch_id)

    def run(self, stream: DataFrame) -> DataFrame:
        run_available(stream, "idle", self.batch, f"{self.path}/checkpoint")
        return self.blocks()

    def start(self, stream: DataFrame, every: str = "10 seconds") -> StreamingQuery:
        """Runs on until it is stopped, a batch at least every so often, also without new rows."""
        writer = with_heartbeat(stream).writeStream.option("checkpointLocation", f"{self.path}/checkpoint").trigger(processingTime=every)
        return writer.foreachBatch(self.batch).start()

    def blocks(self) -> DataFrame:
        return BatchTables(self.spark, self.path).all("blocks", f"{BLOCK}, flushed boolean")


CHANGE = "token_id bigint, address string, event_id bigint, quantity {kind}, kind string"
HOLDER = ["token_id", "address"]
SPAN = 1 << 20  # event ids of a bucket


@dataclass
class RunningHoldings:
    """STR6: the balance of an address after each event (token_id, event_id, from_address, to_address, quantity) that changes it,
    with kind acquired where it rises above zero, released where it no longer is, else null. Quantities and balances are
    bigints, or text of any sign where those are, which is summed exactly. A holder's batches come in the order of its events.

    A holder's events are cut in buckets of event ids. What a bucket begins with is a running sum over one row a holder and
    bucket, within it the events' running sum decides, so a holder with very many events is spread over its buckets.

    A batch stores the balances that it changed, merged with those of some batches before it: batch k - 1 has those of as many
    batches as the lowest bit of k says. So log2(k) tables have all balances, and one is written again log2(k) times."""

    spark: SparkSession
    path: str
    span: int = SPAN

    @staticmethod
    def parts(batch_id: int) -> list[int]:
        """The batches whose tables have all balances after this one."""
        k, out = batch_id + 1, []
        while k > 0:
            out.append(k - 1)
            k &= k - 1
        return out

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        tables = BatchTables(self.spark, self.path)
        amount = "bigint" if V.kind_of(rows, "quantity") == "bigint" else f"struct<{', '.join(f'{k}: decimal(38,0)' for k in V.LIMBS)}>"
        none = F.lit(0).cast(amount) if amount == "bigint" else F.struct(*(F.lit(0).cast("decimal(38,0)").alias(k) for k in V.LIMBS))
        sides = F.array(*(F.struct(F.col(f"{side}_address").alias("address"), F.coalesce(V.signed(rows, "quantity", sign), none).alias("delta")) for side, sign in (("from", -1), ("to", 1))))
        bucket = F.floor(F.col("event_id") / self.span).alias("bucket")
        each = rows.where("not (from_address <=> to_address)").select("token_id", "event_id", bucket, F.inline(sides)).where("address is not null")
        state = f"token_id bigint, address string, held {amount}, at bigint"
        before = tables.of("held", self.parts(batch_id - 1), state)
        sums = V.totalled(each, [*HOLDER, "bucket"], "delta", "delta")
        old = before.groupBy(*HOLDER).agg(F.max_by("held", "at").alias("delta")) if batch_id else before.select(*HOLDER, F.col("held").alias("delta"))
        met = old.alias("o").join(each.select(*HOLDER).distinct().alias("e"), F.expr("o.token_id <=> e.token_id and o.address = e.address"), "left_semi")
        order = Window.partitionBy(*HOLDER).orderBy(F.asc_nulls_first("bucket"))
        steps = V.running(met.withColumn("bucket", F.lit(None).cast("bigint")).unionByName(sums), "delta", "held", order.rowsBetween(Window.unboundedPreceding, 0))
        steps = steps.select(*HOLDER, "bucket", "held", F.lead("bucket").over(order).alias("next"))
        steps = tables.write(steps, "steps", batch_id)

        begin = steps.where("next is not null").select(*HOLDER, F.col("next").alias("bucket"), F.lit(None).cast("bigint").alias("event_id"), F.col("held").alias("delta"), F.lit(0).alias("place"))
        within = Window.partitionBy(*HOLDER, "bucket").orderBy("place", "event_id")
        found = V.running(begin.unionByName(each.withColumn("place", F.lit(1))), "delta", "quantity", within.rowsBetween(Window.unboundedPreceding, 0))
        found = found.withColumn("now", V.above_zero(found, "quantity"))
        found = found.withColumn("was", F.lag("now", 1, False).over(within)).where("place = 1")
        kind = F.when(F.col("now") & ~F.col("was"), "acquired").when(F.col("was") & ~F.col("now"), "released").alias("kind")
        tables.write(V.shown(found.select(*HOLDER, "event_id", "quantity", kind), "quantity"), "changes", batch_id)

        changed = steps.where("next is null").select(*HOLDER, "held", F.lit(batch_id).cast("bigint").alias("at"))
        merged = tables.of("held", [k for k in self.parts(batch_id - 1) if k not in self.parts(batch_id)], state)
        tables.write(changed.unionByName(merged).groupBy(*HOLDER).agg(F.max_by(F.struct("held", "at"), "at").alias("x")).select(*HOLDER, "x.held", "x.at") if batch_id & 1 else changed, "held", batch_id)
        tables.expire(["steps"], batch_id)
        tables.expire(["held"], batch_id, {p for k in range(max(0, batch_id - KEEP - 1), batch_id + 1) for p in self.parts(k)})

    def run(self, stream: DataFrame) -> DataFrame:
        run_available(stream, "holdings", self.batch, f"{self.path}/checkpoint")
        return self.changes(dict(stream.dtypes)["quantity"])

    def changes(self, kind: str) -> DataFrame:
        """All changes; kind is the quantities' type."""
        return BatchTables(self.spark, self.path).all("changes", CHANGE.format(kind=kind))


@dataclass
class GateConfig:
    failures_to_gate: int = 2
    shadow: bool = False


def gate_step(state: dict[str, Any], outcome: str, config: GateConfig) -> tuple[dict[str, Any], str | None]:
    """One observation of a URL: (new state, gate or release or None). N failures in a row gate, a known bad fingerprint
    gates at once, a good render resets and releases, no evidence changes nothing; in shadow mode nothing is ever gated."""
    if outcome == "no_evidence":
        return state, None
    if outcome == "rendered_ok":
        return {"failures": 0, "gated": False}, "release" if state["gated"] else None
    failures = state["failures"] + 1
    due = outcome == "known_bad_fingerprint" or failures >= config.failures_to_gate
    gate = due and not state["gated"] and not config.shadow
    return {"failures": failures, "gated": state["gated"] or gate}, "gate" if gate else None


def _fold_gates(rows: pd.DataFrame, state: dict[str, Any], config: GateConfig) -> tuple[dict[str, Any], list[tuple]]:
    out = []
    for r in rows.sort_values(["at", "id"]).itertuples():
        state, change = gate_step(state, r.outcome, config)
        if change:
            out.append((r.url_hash, int(r.id), change))
    return state, out


def render_gates(observations: DataFrame, config: GateConfig) -> DataFrame:
    """STR7: gate and release rows of a stream of observations (url_hash, id, at, outcome)."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, gated = state.get if state.exists else (0, False)
        now, out = _fold_gates(pd.concat(list(frames)), {"failures": failures, "gated": gated}, config)
        state.update((now["failures"], now["gated"]))
        yield pd.DataFrame(out, columns=["url_hash", "id", "change"])

    return observations.groupBy("url_hash").applyInPandasWithState(fold, "url_hash string, id bigint, change string", "failures int, gated boolean", "append", GroupStateTimeout.NoTimeout)


def render_gates_batch(observations: DataFrame, config: GateConfig) -> DataFrame:
    """The batch twin of STR7, as windows: url_hash, id and change (gate or release) of whole histories.

    Observations without evidence are left out. A run of a URL ends with a good render: its first observation that is due is
    the gate, its good render the release if there was one. In shadow mode there are no rows. Null times come last."""
    order = [F.asc_nulls_last("at"), F.asc_nulls_last("id")]
    good = F.col("outcome").eqNullSafe("rendered_ok")
    seen = observations.where(~F.col("outcome").eqNullSafe("no_evidence") & F.lit(not config.shadow))
    before = Window.partitionBy("url_hash").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    runs = seen.withColumn("run", F.count_if(good).over(before))
    so_far = Window.partitionBy("url_hash", "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.col("outcome").eqNullSafe("known_bad_fingerprint")
    due = ~good & (known | (F.count_if(~good).over(so_far) >= config.failures_to_gate))
    counted = runs.withColumn("due", due).withColumn("dues", F.count_if("due").over(so_far))
    change = F.when(good & (F.col("dues") > 0), "release").when(F.col("due") & (F.col("dues") == 1), "gate")
    return counted.select("url_hash", "id", change.alias("change")).where("change is not null")


def change_feed(stream: DataFrame, clients: DataFrame) -> DataFrame:
    """STR8: one row for each event and client that subscribes to its type or to all, by a join of the stream on the type."""
    return match_clients(stream, clients)
