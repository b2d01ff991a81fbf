"""Mixing sources to target weights by Sainte-Laguë apportionment.

The targets share the corpus's words by weight; a target stops at a few times its source's size and the excess goes to
the others by weight. The mix is cut in equal seats (blocks of words), so many that the smallest target has about a
hundred. Seats go to the sources by the highest quotients target / (2 * seats so far + 1); each output shard has a run
of seats, so it has an integer quota of every source. Within a source, documents are laid end to end in a seeded order,
cut in blocks of a seat's words, and the quota is taken in that order, again from the start when the source is through.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import constants, written

WEIGHTS = (5, 2, 1)  # fixed values: the weights of the sources in order, repeating
MOST = 3  # times a source's size that its target can be
SHARDS, SEATS = 8, 4096  # output shards, and seats of each at least
LEAST = 100  # seats for the smallest target, as far as a seat is a word or more
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Number of words, the runs of signs other than white space."""
    each = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")  # a sign a word, and no array of words
    return F.length(F.translate(each, " \t\n\x0b\f\r", "")).cast("long")


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[Fraction]:
    """Each source's share of all sizes by weight, stopped at most * its size, the excess shared again by weight."""
    left, weight, out = sum(sizes), sum(weights), [Fraction(0)] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (Fraction(most * sizes[k], weights[k]), k)):  # those that stop first come first
        out[k] = min(Fraction(most * sizes[k]), Fraction(left * weights[k], weight)) if weight else Fraction(0)
        left, weight = left - out[k], weight - weights[k]
    return out


def apportion(shares: list[float], seats: int) -> list[int]:
    """The order in which the seats go to the sources (Sainte-Laguë): always to the highest quotient, ties to the first."""
    queue = [(-x, k, 0) for k, x in enumerate(shares) if x > 0]
    heapq.heapify(queue)
    order = []
    for _ in range(seats if queue else 0):
        _, k, n = queue[0]
        order.append(k)
        heapq.heapreplace(queue, (-(shares[k] / (2 * n + 3)), k, n + 1))
    return order


def seats_of(shares: list[float], seats: int) -> list[int]:
    """How many of so many seats each source has, as apportion gives them.

    A source has at least the seats whose quotient is a bound or more; the bound leaves about as many seats as there are
    sources, and those go one by one.
    """
    total, some = sum(shares), sum(x > 0 for x in shares)
    bound = total / (2 * seats - some) if 2 * seats > some else 0.0
    held = [max(0, int((x / bound + 1) / 2) - 1) if bound else 0 for x in shares]
    queue = [(-(x / (2 * n + 1)), k, n) for k, (x, n) in enumerate(zip(shares, held, strict=True)) if x > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(held) if queue else 0):
        _, k, n = queue[0]
        held[k] += 1
        heapq.heapreplace(queue, (-(shares[k] / (2 * n + 3)), k, n + 1))
    return held


def seats_needed(goal: list[float], total: int, shards: int, seats: int, least: int = LEAST) -> int:
    """Seats of a shard: `seats`, or more if the smallest positive target has fewer than `least` seats of more than a word."""
    smallest = min((x for x in goal if x > 0), default=None)
    need = min(total, math.ceil(least * total / smallest)) if smallest else 0
    return max(seats, -(-need // shards))


def plan(sizes: list[int], weights: list[int], most: int = MOST, shards: int = SHARDS, seats: int = SEATS) -> tuple[list[float], list[list[int]], int]:
    """(targets, quotas[shard][source] in blocks, seats of a shard)."""
    goal = [float(x) for x in targets(sizes, weights, most)]
    seats = seats_needed(goal, sum(sizes), shards, seats)
    ends = [[0] * len(sizes), *(seats_of(goal, h * seats) for h in range(1, shards + 1))]
    return goal, [[y - x for x, y in zip(a, b, strict=True)] for a, b in zip(ends, ends[1:], strict=False)], seats


def block_words(blocks: int, total: int, seats: int) -> int:
    """Words of so many blocks of total / seats words each, to the nearest."""
    return (2 * total * blocks + seats) // (2 * seats)


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, shards: int = SHARDS, seats: int = SEATS, digits: int = 3, carry: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, quota, taken and first_shard of every document.

    taken is the number of words that the mix takes of the document, repeats counted, at most `most` times its size;
    first_shard the output shard of its first block (null if nothing is taken). Null texts have size 0; null is a
    source of its own, the last. Rows that repeat a doc_id are documents of their own; equal rows are interchangeable.
    An empty table gives no rows. Other columns are ignored, but one named by `carry`: it is returned too, and puts rows
    of one doc_id and size in order.

    One row a source comes to the driver: the sources are the mixture's configuration. Within a source, places come
    from sums over hash buckets, then over the documents of one bucket, so that no task has a whole source. Rows without
    a doc_id are dealt into buckets by their size.
    """
    spark = docs.sparkSession
    also = [carry] if carry else []
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_of(F.col("text")).alias("size"), *also)
    light = light.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), "size")))))
    light = written(light.withColumn("bucket", F.substring("key", 1, digits)), "mix-sizes")
    rows = light.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    goal, quotas, seats = plan([r["size"] for r in rows], [weights[k % len(weights)] for k in range(len(rows))], most, shards, seats)
    total, quota = sum(r["size"] for r in rows), [sum(q[k] for q in quotas) for k in range(len(rows))]
    words = lambda n: block_words(n, total, shards * seats)
    took = [min(most * r["size"], words(n)) for r, n in zip(rows, quota, strict=True)]
    ends = [[words(sum(q[k] for q in quotas[: h + 1])) for h in range(shards)] for k in range(len(rows))]
    known = constants(spark, [(r["source"], r["size"], goal[k], quota[k], took[k], ends[k]) for k, r in enumerate(rows)], "source string, source_size long, target double, quota long, took long, shard_ends array<long>")
    same = F.col("source").eqNullSafe(F.col("s"))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *also)
    placed = light.withColumn("inside", F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    sums = light.groupBy(F.col("source").alias("s"), F.col("bucket").alias("b")).agg(F.sum("size").alias("words"))
    offsets = sums.withColumn("before", F.sum("words").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    placed = placed.join(offsets, same & (F.col("bucket") == F.col("b"))).drop("s", "b", "words")
    placed = placed.join(F.broadcast(known.withColumnRenamed("source", "s")), same).drop("s")  # bound: one row a source
    start = F.col("before") + F.col("inside")
    rest = F.col("took") - F.floor(F.col("took") / F.greatest(F.col("source_size"), F.lit(1))).cast("long") * F.col("source_size")
    taken = F.col("size") * F.expr("took div greatest(source_size, 1L)") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    first = F.size(F.filter("shard_ends", lambda x: x <= start))
    return placed.select("doc_id", "source", "size", "source_size", "target", F.col("quota"), taken.cast("long").alias("taken"), F.when(taken > 0, first).alias("first_shard"), *also)
