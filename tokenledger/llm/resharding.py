"""Resharding by minimum-cost flow: from old shard sizes and new capacities, the block transfers that move the fewest bytes.

Rows of an old shard are dealt into blocks by a hash, so a block's size is known from one grouped sum. A flow network
with an arc from every old to every new shard (free where the shard stays, otherwise a cost per byte) is solved for the
least cost; whole blocks then fill the arcs, the largest first. Only shards that lose or gain blocks are rewritten.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import constants, join_by_group, written


def least_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] that brings all supply to the capacities at the least cost, by successive shortest paths.

    sum(capacity) must be at least sum(supply). The network has a node for each shard, so it is small whatever the data.
    """
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("the capacities are less than the supply")
    left, room = list(supply), list(capacity)
    flow = [[0] * m for _ in range(n)]
    while any(left):
        # the cheapest way from any old shard with bytes left, over arcs and back along flows; new shard j is node n + j
        dist: list[int | None] = [0 if x else None for x in left] + [None] * m
        via: list[int | None] = [None] * (n + m)
        queue = deque(i for i in range(n) if left[i])
        while queue:
            u = queue.popleft()
            arcs = [(n + j, cost[u][j]) for j in range(m)] if u < n else [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in arcs:
                if dist[v] is None or dist[u] + c < dist[v]:
                    dist[v], via[v] = dist[u] + c, u
                    if v not in queue:
                        queue.append(v)
        at = n + min((j for j in range(m) if room[j]), key=lambda j: (dist[n + j], j))
        path = [at]
        while via[path[-1]] is not None:
            path.append(via[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:], strict=False))
        much = min([left[path[0]], room[at - n], *(flow[v][u - n] for u, v in steps if u >= n)])
        for u, v in steps:
            if u < n:
                flow[u][v - n] += much
            else:
                flow[v][u - n] -= much
        left[path[0]] -= much
        room[at - n] -= much
    return flow


def place_blocks(blocks: list[tuple[int, int, int]], flow: list[list[int]]) -> dict[tuple[int, int], int]:
    """(old shard, block) -> new shard for blocks (old shard, block, bytes): the largest first, each to the arc with the
    most bytes left, the shard itself where equal. The arcs end up filled to within the smallest blocks."""
    by_shard = defaultdict(list)
    for old, block, size in blocks:
        by_shard[old].append((-size, block))
    out, over = {}, [0] * (len(flow[0]) if flow else 0)
    for old in sorted(by_shard):
        left = [f - o for f, o in zip(flow[old], over, strict=True)]
        over = [0] * len(left)
        arcs = [j for j, f in enumerate(flow[old]) if f] or [old % len(left)]
        queue = [(-left[j], j != old, j) for j in arcs]
        heapq.heapify(queue)
        for size, block in sorted(by_shard[old]):
            room, moved, j = queue[0]
            out[old, block] = j
            heapq.heapreplace(queue, (room - size, moved, j))
        for room, _, j in queue:
            over[j] = room  # bytes above the arc's flow, which the next shards make up for
        for j in range(len(left)):
            if j not in arcs:
                over[j] = -left[j]
    return out


def row_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and one for its end."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def old_shard_by_source(shards: int) -> Column:
    """A layout by source, as a crawl leaves it: some shards hold much more than others."""
    return F.pmod(F.crc32(F.coalesce(F.col("source").cast("string"), F.lit(""))), F.lit(shards)).cast("int")


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, new_shards: int, capacity: list[int] | None = None, blocks: int = 4096, spread: int = 1000, part: int = 100_000) -> tuple[DataFrame, list[list[int]]]:
    """(doc_id, size, text_crc32, old_shard, shard, slot of every document; bytes that go from each old to each new shard).

    Shard sizes end up near the capacities, or near equal where none are given. slot is the row's place in its new
    shard, without gaps from 0; a block of more than `part` rows is numbered in parts. Rows that repeat a doc_id are rows of their own;
    a null doc_id comes first in its part.
    Null texts have size 1. An empty table gives no rows. Other columns are ignored.

    Equal texts are a group, which goes to one shard, starting from the old shard that has most of its bytes. A group of
    more than 1/spread of all bytes is dealt out by rows instead, or shards couldn't be near equal.

    The driver gets one row per block (old shards * blocks at most, whatever the data), and the texts don't move.
    """
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_bytes(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), old_shard.alias("old_shard"), F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id()).alias("spread"))
    light = written(light, "reshard-rows")
    group = ["text_key", "text_crc32", "size"]
    held = light.groupBy(*group, "old_shard").agg(F.count("*").alias("n"))
    held = held.groupBy(*group).agg(F.sum("n").alias("n"), F.max(F.struct("n", -F.col("old_shard"))).alias("most")).where("n > 1")
    held = written(held.select(*group, "n", (-F.col("most.col2")).alias("home")), "text-groups")
    rows, whole = light.agg(F.count("*"), F.sum("size")).first()
    split = F.col("n") * F.col("size") * spread > F.lit(whole or 0)
    met = join_by_group(light, held.withColumn("home", F.when(split, None).otherwise(F.col("home"))), group, "n", rows)
    own = light.join(held.select(*group), group, "left_anti").withColumns({"n": F.lit(1).cast("long"), "home": F.col("old_shard")}).unionByName(met)
    together = F.when(F.col("home").isNull(), F.xxhash64("doc_id", "text_crc32")).otherwise(F.col("text_key"))
    own = own.select("doc_id", "size", "text_crc32", "old_shard", F.coalesce("home", "old_shard").alias("home"), F.pmod(together, F.lit(blocks)).cast("int").alias("block"), "spread")
    own = written(own, "reshard-homes")
    found = [(r["home"], r["block"], r["bytes"], r["rows"]) for r in own.groupBy("home", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()]
    sizes = [0] * old_shards
    for old, _, size, _ in found:
        sizes[old] += size
    total = sum(sizes)
    capacity = capacity or [total * (j + 1) // new_shards - total * j // new_shards for j in range(new_shards)]
    flow = least_cost_flow(sizes, capacity, [[int(i != j) for j in range(new_shards)] for i in range(old_shards)])
    to = place_blocks([x[:3] for x in found], flow)
    next_slot, rows = [0] * new_shards, []
    for old, block, _, n in sorted(found):
        rows.append((old, block, to[old, block], next_slot[to[old, block]]))
        next_slot[to[old, block]] += n
    moves = constants(docs.sparkSession, rows, "home int, block int, shard int, first_slot long")
    placed = own.join(F.broadcast(moves), ["home", "block"])  # bound: old_shards * blocks rows
    return numbered(placed, {(old, block): n for old, block, _, n in found}, part).select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot"), flow


def numbered(placed: DataFrame, rows: dict[tuple[int, int], int], part: int) -> DataFrame:
    """placed with slot: first_slot and on, without gaps, within each (home, block), whose numbers of rows are given.

    A block of many rows is numbered in parts of about `part`, by a hash of `spread`: parts are counted and their counts
    added up, then each is numbered for itself, so no task has a whole block of a group with very many rows.
    """
    spark = placed.sparkSession
    large = constants(spark, [(*k, -(-n // part)) for k, n in rows.items() if n > part], "home int, block int, parts long")
    dealt = placed.join(F.broadcast(large), ["home", "block"], "left")  # bound: a row a block
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("spread"), F.coalesce("parts", F.lit(1))))
    before = Window.partitionBy("home", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.where("parts is not null").groupBy("home", "block", "part").agg(F.count("*").alias("n"))
    starts = counted.select("home", "block", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("home", "block", "part").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32", "spread")
    placed = dealt.withColumn("row", F.row_number().over(order)).join(starts, ["home", "block", "part"], "left")
    return placed.withColumn("slot", (F.col("first_slot") + F.coalesce("start", F.lit(0)) + F.col("row") - 1).cast("long"))


def rewrite(docs: DataFrame, placed: DataFrame, flow: list[list[int]], path: str) -> list[int]:
    """Writes the documents of shards that lose or gain rows as path/shard=N, in slot order, and returns those shards;
    the files of all others stay as they are. doc_id must be unique here."""
    moved = {j for i, row in enumerate(flow) for j, much in enumerate(row) if much and i != j} | {i for i, row in enumerate(flow) for j, much in enumerate(row) if much and i != j and i < len(flow[0])}
    touched = placed.where(F.col("shard").isin(sorted(moved))).select("doc_id", "shard", "slot")
    out = docs.drop("shard", "slot").join(touched, "doc_id").repartition("shard", F.floor(F.col("slot") / 200_000)).sortWithinPartitions("shard", "slot")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return sorted(moved)
