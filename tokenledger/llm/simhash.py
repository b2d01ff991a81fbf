"""Near-duplicate documents by SimHash, found with deletion variants.

A fingerprint has a bit for each of 64 positions, set where over half of the document's shingle hashes have it.
Fingerprints are cut in the fewest segments such that of two that differ in `bits` bits, one segment differs by one bit at
most: 2 * segments > bits. Every segment is indexed once for each of its positions with that position as a wildcard (its bit
deleted); fingerprints whose segments differ by at most that bit agree in a variant, so they meet by equality and are then
compared as a whole. Where 2 * segments is bits + 2, one segment needs no wildcard: if each of the others differs in two bits,
it has none left. So 4 bits take 3 segments: two of 22 bits with a wildcard, 44 variants of 21 bits, and one of 20 bits as it is.

Equal fingerprints are one node. Variants are shuffled by their bits and a bucket's fingerprints are compared where they
arrive: the equality join and its check are one step, which returns links that connect what is linked and no more, so chance
meetings of unlike fingerprints make no rows. A larger bucket is joined to a central member first, and then every pair of
members of different components is compared, block by block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_by_group, slices, written
from .minhash import components, left_open

SEED = 42
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _parts(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of data, a part of the text at a time, cut between words."""
    at = 0
    while at < len(data):
        found = _SPACE.search(data, at + size) if at + size < len(data) else None
        end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end


def fingerprint(data: bytes, words: int = 4) -> int:
    """The fingerprint of a text in UTF-8, its shingles counted as often as they occur; 0 without words."""
    counts, total, kept, hashed = np.zeros(64, np.int64), 0, [], xxhash.xxh64_digest
    for part in _parts(data.lower()):
        kept += part
        if len(kept) < words:
            continue
        text, ends = b" ".join(kept), np.cumsum([len(x) + 1 for x in kept])
        starts = [0, *ends[:-words].tolist()]
        hashes = b"".join([hashed(text[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)])
        table = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
        for at in range(0, len(table), 1 << 16):
            counts += np.unpackbits(table[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
        total += len(table)
        kept = kept[len(kept) - words + 1 :]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(kept), SEED) if kept else 0
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(x.as_py() or b"", words) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def segments(bits: int) -> list[tuple[int, int, bool]]:
    """(lowest position, width, has a wildcard) of the fewest segments of which one, if `bits` bits differ in all, differs by one
    bit at most, or by none where it has no wildcard: 2 for each with one and 1 for the other make bits + 1."""
    wild, exact = (bits + 1) // 2, (bits + 1) % 2
    last = 64 // (wild + 1) - 1 if exact and wild else 64 * exact  # its variant is as long as the others' or a bit less
    edges = [(64 - last) * i // wild for i in range(wild + 1)] if wild else [0]
    return [(a, b - a, True) for a, b in zip(edges, edges[1:], strict=False)] + [(64 - last, last, False)] * exact


def variants(fps: DataFrame, bits: int) -> DataFrame:
    """(bucket, fp): each segment with each of its positions deleted; a bucket is the position and the segment's other bits."""
    made = []
    for at, width, wild in segments(bits):
        cut = F.expr(f"shiftrightunsigned(fp, {at}) & {(1 << width) - 1 if width < 64 else -1}L")
        for i in range(width) if wild else [None]:
            rest = cut if i is None else cut.bitwiseAND(F.lit(~(1 << i) if i < 63 else (1 << 63) - 1))
            made.append(F.struct(F.lit(at + (i or 0)).cast("long").alias("position"), rest.alias("rest")))
    key = F.expr("shiftleft(v.position, 58) ^ v.rest") if bits > 1 else F.expr("xxhash64(v.position, v.rest)")  # whole segments don't fit beside a position
    return fps.select("fp", F.explode(F.array(*made)).alias("v")).select(key.alias("bucket"), "fp")


def _near(x: np.ndarray, y: np.ndarray | np.uint64, bits: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= bits


def _spanning(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect the distinct fingerprints of one bucket as far as those within `bits` do."""
    links, rest = [], fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = _near(rest, x, bits)
            if near.any():
                links += [(x, y) for y in rest[near]]
                front += list(rest[near])
                rest = rest[~near]
    return links


def bucket_links(rows: DataFrame, bits: int, few: int = 8) -> DataFrame:
    """Links (a, b) of fingerprints within `bits`, from rows (bucket, fp) of buckets small enough for one task each."""

    def emit(found: list) -> pa.RecordBatch:
        both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 2), np.int64)

        def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
            size = np.diff(np.append(first, len(rows)))
            small = np.repeat(size <= few, size)
            some, found = rows[small], []
            for shift in range(1, few):
                same = np.flatnonzero(some[shift:, 0] == some[:-shift, 0])
                x, y = some[same, 1].view(np.uint64), some[same + shift, 1].view(np.uint64)
                near = _near(x, y, bits)
                found.append(np.stack([x[near], y[near]], axis=1))
            yield emit(np.concatenate(found))
            for at, n in zip(first[size > few], size[size > few], strict=True):
                yield emit(_spanning(rows[at : at + n, 1].copy().view(np.uint64), bits))

        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(k).to_numpy() for k in (0, 1)], axis=1)])
            if not len(rows):
                continue
            open_at = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last bucket may go on
            if open_at:
                yield from links(rows[:open_at])
            held = rows[open_at:]
        if len(held):
            yield from links(held)

    return rows.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").distinct()


def centres(rows: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) of the members of each bucket of rows (bucket, fp) to its member nearest to its majority bits."""
    half = [F.when(F.sum(F.expr(f"shiftrightunsigned(fp, {i}) & 1L")) * 2 > F.count("*"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)) for i in range(64)]
    total = half[0]
    for x in half[1:]:
        total = total.bitwiseOR(x)
    away = F.bit_count(F.col("fp").bitwiseXOR(F.col("middle")))
    near = rows.join(rows.groupBy("bucket").agg(total.alias("middle")), "bucket")
    centre = near.groupBy("bucket").agg(F.min(F.struct(away.alias("away"), "fp"))["fp"].alias("a"))
    return rows.join(centre, "bucket").where((F.col("a") != F.col("fp")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= bits)).select("a", F.col("fp").alias("b")).distinct()


def across(groups: DataFrame, bits: int, most: int = 4096) -> DataFrame:
    """Links (a, b) that join components of each group of groups (bucket, id, component, centre; see `left_open`): every
    pair of members of different components is compared, in a group with a centre those of a member of it and another.

    A group is cut in blocks of about `most` fingerprints, the centre in blocks of its own; a task holds two blocks at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            fps, comps = np.array(sides[1] or sides[0], np.int64).T.copy()
            fps, found, joined = fps.view(np.uint64), [], set()
            for x, c in sides[0]:
                for k in np.flatnonzero((comps != c) & _near(fps, np.int64(x).view(np.uint64), bits)):
                    pair = (min(c, comps[k]), max(c, comps[k]))
                    if pair not in joined:
                        joined.add(pair)
                        found.append((x, fps[k].view(np.int64)))
            both = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        key, sides = None, ([], [])
        for batch in batches:
            for unit, side, fp, component in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if key != unit:
                    if sides[0]:
                        yield close()
                    key, sides = unit, ([], [])
                sides[side].append((fp, component))
        if sides[0]:
            yield close()

    own = F.coalesce("centre", F.lit(False))
    blocks = groups.groupBy("bucket", own.alias("own")).agg(F.count("*").alias("members"), F.max("centre").isNotNull().alias("centred"))
    blocks = written(blocks.select("bucket", "own", "centred", F.ceil(F.col("members") / most).alias("parts")), "blocks")
    placed = written(groups.withColumn("own", own).join(blocks.select("bucket", "own", "parts"), ["bucket", "own"]).select("bucket", "own", F.pmod(F.xxhash64("id"), "parts").alias("part"), "id", "component"), "placed")
    each = blocks.select("bucket", "own", "centred", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    left, right = each, each.toDF("bucket", "own2", "centred2", "part2")
    units = left.join(right, "bucket").where("case when centred then own and not own2 else part <= part2 end").withColumn("unit", F.monotonically_increasing_id())
    units = written(units, "units")
    first = units.select("unit", F.lit(0).alias("side"), "bucket", "own", "part")
    second = units.where("own <> own2 or part <> part2").select("unit", F.lit(1).alias("side"), "bucket", F.col("own2").alias("own"), F.col("part2").alias("part"))
    dealt = first.unionByName(second).join(placed, ["bucket", "own", "part"]).select("unit", "side", "id", "component")
    links = written(dealt.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(run, "a long, b long").distinct(), "links")
    discard(blocks, placed, units)
    return links


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, most: int = 8192) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Documents whose fingerprints differ in at most `bits` bits are linked; component_id is the least doc_id reachable over
    links, the document's own included. Null and empty texts, and those without words, have the fingerprint 0 and are
    linked like any other. Every row is a document of its own, also rows that repeat a doc_id. A row without a doc_id has
    its links, but gives no component its name; a component of such rows alone is named null. An empty table gives no
    rows. Other columns are ignored. Buckets of over `most` distinct fingerprints are finished in blocks.
    """
    marked = written(fingerprints(docs, words), "fingerprints", merge=False)
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes", merge=False)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = variants(nodes.repartition(parts, "fp"), bits)  # a light table becomes many rows: not in the few tasks that its size asks for
    hot = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > most).select("bucket"), "large-buckets", merge=False)
    if hot.isEmpty():
        links = written(bucket_links(rows, bits), "links", merge=False)
        comps = components(links)
    else:
        links = written(bucket_links(rows.join(hot, "bucket", "left_anti"), bits), "links", merge=False)
        large = written(rows.join(hot, "bucket", "left_semi"), "large", merge=False)
        links = links.unionByName(written(centres(large, bits), "centres"))
        more = across(left_open(large.withColumnRenamed("fp", "id"), components(links)), bits)
        comps = components(links.unionByName(more))
        discard(large)
    discard(hot)
    named = nodes.join(comps.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", "copies", F.coalesce("component", "fp").alias("component"))
    named = written(named, "named", merge=False)
    each = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    total = named.count()
    placed = join_by_group(named, each, ["component"], "size", total).select("fp", "copies", "component_id")
    count = named.agg(F.sum("copies")).first()[0] or 0
    out = join_by_group(marked, placed, ["fp"], "copies", count)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
