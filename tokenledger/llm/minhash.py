"""Near-duplicate documents by one-permutation hashing.

Each document's shingle set gets one hash per shingle; the hash range is cut in bins and a bin keeps its least hash.
Empty bins borrow from another bin, probed in an order drawn for the bin alone (optimal densification), so borrowed
bins agree between two documents as often as filled ones. Bands of bins are bucket keys. A bucket of m documents gives
two stars of m - 1 candidate edges, at its least and its greatest member, and never all pairs; every edge is then
checked on the full sets. Where a bucket still holds several components after that, every pair of members of different
components is compared, block by block on full sets, so that no pair of a bucket is left out.

With 200 bins in 40 bands of 5, two sets of similarity 0.8 share no bucket with a chance of about 1e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, int_lists, join_by_group, mix, slices, word_hashes, written

BANDS, ROWS = 40, 5


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles; of fewer words than that, the whole sequence as one."""
    hashes = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(hashes):
        return hashes
    k = min(words, len(hashes))
    found = np.full(len(hashes) - k + 1, k, np.uint64)
    for i in range(k):
        found = mix(found ^ hashes[i : len(hashes) - k + 1 + i], i)
    return np.unique(found)


def probe_order(bins: int) -> np.ndarray:
    """For each bin, the order in which it probes the others when it is empty."""
    rng = np.random.default_rng(20240607)
    return np.argsort(rng.random((bins, bins)), axis=1).astype(np.uint16)


def one_permutation(hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The densified signature of a non-empty set of sorted hashes."""
    bins = len(order)
    at = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)  # rises with the hash, so a bin's first is its least
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    filled, signature = np.zeros(bins, bool), np.zeros(bins, np.uint64)
    filled[at[first]] = True
    signature[at[first]] = hashes[first]
    empty = np.flatnonzero(~filled)
    if len(empty):
        probes = order[empty]
        signature[empty] = signature[probes[np.arange(len(empty)), filled[probes].argmax(axis=1)]]
    return signature


def signatures(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set digest (d1, d2) and band keys of each document; an empty set has no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = probe_order(bands * rows)
        rng = np.random.default_rng(7)
        factors = rng.integers(1, 1 << 63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)
        salt = rng.integers(1, 1 << 63, bands, np.uint64)
        for batch in slices(batches):
            n, digests, keys = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, words)
                n.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                keys.append(mix((one_permutation(found, order).reshape(bands, rows) * factors).sum(axis=1) ^ salt).view(np.int64) if len(found) else np.empty(0, np.int64))
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), int_lists(keys)], names=["doc_id", "n_shingles", "d1", "d2", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int, most: int = 256) -> DataFrame:
    """The pairs (a, b), a a star's centre, whose full sets have 100 * intersection >= percent * union.

    The members of a star come to its centre a in groups of about `most`, each of which gets the centre's text once; a
    task holds one centre's set and one member's at a time.
    """
    groups = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / most).alias("groups")), "star-groups")
    dealt = written(pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), "groups").alias("spoke"), "b"), "spokes")
    members = dealt.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "spoke", "b", "text")
    centres = dealt.select("a", "spoke").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "spoke", F.lit(None).cast("long").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, []
        for batch in slices(batches):
            links = []
            for a, spoke, b, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != (a, spoke):
                    key, centre = (a, spoke), []
                own = shingle_set(text, words)
                if b is None:
                    centre.append(own)
                    continue
                for other in centre:
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if len(own) and 100 * both >= percent * (len(own) + len(other) - both):
                        links.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    rows = members.unionByName(centres).repartition("a", "spoke").sortWithinPartitions("a", "spoke", F.col("b").asc_nulls_first())
    links = written(rows.mapInArrow(run, "a long, b long").distinct(), "links")
    discard(groups, dealt)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id on an edge (a, b), a != b; the component is its least id.

    Alternates large-star and small-star steps, which halve the depth of the trees each time. The grouped minimum of a
    step is a table of its own, so the join with it reads two plain shuffles, of which Spark splits those of a hub. Tables
    are written out, so that lost executors cost one step only, and go when the next step stands.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = written(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star")
        lower = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        # the edge (u, v) becomes (v, m), and u itself hangs on m
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "edges")
        discard(edges, least, large, lower)
        edges = after
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    comps = written(found, "components")
    discard(edges)
    return comps


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents with equal non-empty sets are one class and only its representative, the least doc_id, is hashed into
    buckets, so copies never meet as pairs. Links are confirmed on full sets. component_id is the least doc_id
    reachable over links and equal sets.

    Null and empty texts have no shingles and are linked with nothing. A row without a doc_id is linked with nothing
    and kept. Rows that repeat a doc_id are one document. An empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = written(signatures(docs, words, bands, rows), "signatures", merge=False)
    live = sig.where("n_shingles > 0 and doc_id is not null")
    classes = written(live.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    heads = sig.join(classes.select(F.col("rep").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"]).select("doc_id", F.explode("bands").alias("bucket"))
    shared = heads.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z")
    stars = written(heads.join(shared, "bucket").select("bucket", "a", F.col("doc_id").alias("b"), "z"), "stars")
    texts = written(docs.join(stars.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts", merge=False)
    ends = stars.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("z").alias("a"), "b"))).alias("e")).select("e.*").where("a <> b")
    # each pair once, under the centre of the lower star if it is in both kinds
    once = ends.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a"))
    pairs = written(once.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b")), "pairs")
    links = verified(pairs, texts, words, percent)
    comps = components(links)
    groups = left_open(stars.select("bucket", F.col("b").alias("id")), comps)
    more = across(groups, texts, words, percent)
    if not more.isEmpty():
        comps = components(links.unionByName(more))
    discard(stars, texts, pairs, links, groups, more)
    total = classes.agg(F.sum("copies")).first()[0] or 0
    named = classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", "copies", F.coalesce("component", "rep").alias("component_id"))
    out = join_by_group(live.select("doc_id", "n_shingles", "d1", "d2"), named, ["d1", "d2"], "copies", total).select("doc_id", "n_shingles", "component_id")
    alone = sig.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def left_open(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Groups (bucket, id, component, centre) in which members of different components are still to be compared, from rows
    (bucket, id) and the components found so far.

    A bucket is open if it holds several components. The component with the most members in it is its centre, and its
    other members are outsiders; centres hold most of the rows. All outsiders of one centre, whatever the bucket, form a group with
    the centre's members, which have centre true; the outsiders of one bucket form another group. So each pair of an open bucket's
    members is in a group, and a document is in a few groups instead of all of its buckets.
    """
    rows = written(rows.join(comps, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component")), "members")
    held = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    open_ = held.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("components")).where("components > 1").select("bucket", F.col("most.component").alias("centre_of"))
    open_ = written(open_, "open-buckets")
    outside = written(rows.join(open_, "bucket").where("component <> centre_of"), "outsiders")
    centres = outside.select(F.col("centre_of").alias("component")).distinct()
    inner = comps.join(centres, "component").select("component", "id").unionByName(centres.select("component", F.col("component").alias("id"))).distinct()
    around = inner.select(F.xxhash64(F.lit("centre"), "component").alias("bucket"), "id", "component", F.lit(True).alias("centre"))
    outer = outside.select(F.xxhash64(F.lit("centre"), "centre_of").alias("bucket"), "id", "component", F.lit(False).alias("centre")).distinct()
    several = outside.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    beside = outside.join(several, "bucket").select("bucket", "id", "component", F.lit(None).cast("boolean").alias("centre"))
    groups = written(around.unionByName(outer).unionByName(beside), "open-groups")
    discard(rows, open_, outside)
    return groups


def across(groups: DataFrame, texts: DataFrame, words: int, percent: int, most: int = 256, most_shingles: int = 1 << 20) -> DataFrame:
    """The links (a, b) that join the components of each group of groups (bucket, id, component, centre): every pair of members
    of different components is compared on its full sets; in a group with a centre (centre true or false, not null), pairs
    of a centre's member and another.

    A group is cut in blocks of about `most` members and `most_shingles` shingles, the centre and any large component in
    blocks of their own; a task holds two blocks at a time, and two blocks of one component never meet. A document goes to
    a task once for each block that its own meets; of the links between two blocks only those that join components further
    are returned.
    """

    if "centre" not in groups.columns:
        groups = groups.withColumn("centre", F.lit(None).cast("boolean"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(text, words) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), int_lists([x.view(np.int64) for x in found])], names=["id", "n", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            links = _links(sides[0], sides[1] or sides[0], percent)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        key, sides = None, ([], [])
        for batch in slices(batches):
            lists = batch.column(4)
            flat, at = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            for i, (unit, side, doc, component) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)):
                if key != unit:
                    if sides[0]:
                        yield close()
                    key, sides = unit, ([], [])
                sides[side].append((doc, component, flat[at[i] : at[i + 1]].copy()))
        if sides[0]:
            yield close()

    members = written(texts.withColumnRenamed("doc_id", "id").join(groups.select("id").distinct(), "id", "left_semi").select("id", "text").mapInArrow(sets, "id long, n long, shingles array<long>"), "sets", merge=False)
    known = groups.join(members.groupBy("id").agg(F.max("n").alias("n")), "id")
    count = lambda x, n: F.greatest(F.ceil(F.col(x) / most), F.ceil(F.col(n) / most_shingles)).cast("long")
    own = known.groupBy("bucket", "component", "centre").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).withColumn("parts", count("members", "shingles"))
    own = own.withColumn("own", F.when(F.coalesce("centre", F.col("parts") > 1), F.col("component").cast("string")).otherwise(""))
    blocks = own.groupBy("bucket", "own").agg(F.first("centre").alias("centre"), F.sum("members").alias("members"), F.sum("shingles").alias("shingles"))
    blocks = written(blocks.select("bucket", "own", "centre", F.greatest(F.lit(1), count("members", "shingles")).alias("parts")), "blocks")
    named = known.join(own.select("bucket", "component", "own"), ["bucket", "component"]).join(blocks.drop("centre"), ["bucket", "own"])
    named = written(named.select("bucket", "own", F.pmod(F.xxhash64("id"), "parts").alias("part"), "id", "component"), "placed")
    each = blocks.select("bucket", "own", "centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    left, right = each.toDF("bucket", "own", "centre", "part"), each.toDF("bucket", "own2", "centre2", "part2")
    units = left.join(right, "bucket").where("case when centre is null then own < own2 or own = own2 and own = '' and part <= part2 else centre and not centre2 end")
    units = written(units.withColumn("unit", F.monotonically_increasing_id()), "units")
    first = units.select("unit", F.lit(0).alias("side"), "bucket", "own", "part")
    second = units.where("own <> own2 or part <> part2").select("unit", F.lit(1).alias("side"), "bucket", F.col("own2").alias("own"), F.col("part2").alias("part"))
    dealt = first.unionByName(second).join(named, ["bucket", "own", "part"]).join(members, "id").select("unit", "side", "id", "component", "shingles")
    links = written(dealt.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(run, "a long, b long").distinct(), "links")
    discard(members, blocks, named, units)
    return links


def _links(left: list[tuple], right: list[tuple], percent: int, columns: int = 8192) -> list[tuple[int, int]]:
    """Links between members (id, component, sorted set) of left and right that join different components, without those
    that earlier ones imply."""
    size = [np.array([len(x[2]) for x in side], np.int64) for side in (left, right)]
    comp = [np.array([x[1] for x in side], np.int64) for side in (left, right)]
    low, high = np.minimum.outer(*size), np.maximum.outer(*size)
    todo = (comp[0][:, None] != comp[1][None, :]) & (low > 0) & (100 * low >= percent * high)
    if left is right:
        todo = np.triu(todo)
    if todo.sum() <= 4 * (len(left) + len(right)):
        met = [(i, j, len(np.intersect1d(left[i][2], right[j][2], assume_unique=True))) for i, j in zip(*np.nonzero(todo), strict=True)]
        met = [(i, j) for i, j, both in met if 100 * both >= percent * (len(left[i][2]) + len(right[j][2]) - both)]
    else:
        values = [np.concatenate([x[2] for x in side]) for side in (left, right)]
        common = np.intersect1d(*values)
        both = np.zeros(todo.shape, np.int64)
        for at in range(0, len(common), columns):
            part = common[at : at + columns]
            has = []
            for side in (left, right):
                table = np.zeros((len(side), len(part)), np.float32)
                for i, x in enumerate(side):
                    lo, hi = np.searchsorted(x[2], part[0]), np.searchsorted(x[2], part[-1], "right")
                    own = x[2][lo:hi]
                    k = np.searchsorted(part, own)
                    table[i, k[part[k] == own]] = 1
                has.append(table)
            both += (has[0] @ has[1].T).astype(np.int64)
        met = zip(*np.nonzero(todo & (100 * both >= percent * (size[0][:, None] + size[1][None, :] - both))), strict=True)
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    links = []
    for i, j in met:
        a, b = top(left[i][1]), top(right[j][1])
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append((left[i][0], right[j][0]))
    return links
