"""Document fingerprints: Merkle trees over sections, paragraphs and sentences.

Leaves are the hashes of a paragraph's sentences; a paragraph hashes its leaves, a section hashes a run of paragraphs,
and the root hashes the sections. Every hash is of 64 bits, of the root 128, over the node's kind, its length and its
children's hashes, so the root tests equality of the whole text. A section ends after a paragraph whose own hash says so,
not after a number of paragraphs, so an insertion changes the sections around it only. Two trees are compared from the
root down, into differing branches only, which locates edits and gives the share of text they have in common.

A fingerprint is the root's hash in hex, a colon, and the tree in base64.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, written

SECTION = 4  # paragraphs of a section, about
LEAF = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+")
LONG = 400  # signs of a leaf at most


@dataclass(slots=True)
class Node:
    hash: bytes
    size: int  # signs of text below
    children: list[Node] | tuple = ()


def _leaf(text: str) -> Node:
    return Node(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, person=b"leaf").digest(), len(text))


def _parent(kind: bytes, children: list[Node], extra: int = 0) -> Node:
    size = sum(c.size for c in children) + extra
    h = hashlib.blake2b(size.to_bytes(8, "little"), digest_size=16 if kind == b"root" else 8, person=kind)
    h.update(b"".join([c.hash for c in children]))
    return Node(h.digest(), size, children)


def _grown(paragraphs: Iterator[Node]) -> Node:
    """The root over paragraphs, put in sections."""
    sections, run = [], []
    for x in paragraphs:
        run.append(x)
        if x.hash[0] % SECTION == 0:
            sections.append(_parent(b"section", run))
            run = []
    if run:
        sections.append(_parent(b"section", run))
    return _parent(b"root", sections)


def tree(text: str) -> Node:
    """The root of sections over paragraphs over leaves. A paragraph's line break counts as one sign of it."""

    def paragraph(x: str) -> Node:
        return _parent(b"paragraph", [_leaf(y[i : i + LONG]) for y in LEAF.findall(x) for i in range(0, len(y), LONG)] or [_leaf("")], 1)

    return _grown(map(paragraph, text.split("\n")))


def shown(root: Node) -> str:
    """The fingerprint: inner hashes follow from the leaves, so only these are in it, 8 bytes of hash and 2 of length."""
    out = []
    for s in root.children:
        for p in s.children:
            n = len(p.children)
            out.append(struct.pack(f"<I{n}H", n, *[x.size for x in p.children]))
            out += [x.hash for x in p.children]
    return root.hash.hex() + ":" + base64.b64encode(b"".join(out)).decode()


def read(fingerprint: str) -> Node:
    """The tree of a fingerprint. Raises ValueError if its leaves don't hash to its root."""
    digest, _, rest = fingerprint.partition(":")
    data = base64.b64decode(rest)

    def paragraphs() -> Iterator[Node]:
        at = 0
        while at < len(data):
            n = struct.unpack_from("<I", data, at)[0]
            sizes, at = struct.unpack_from(f"<{n}H", data, at + 4), at + 4 + 2 * n
            yield _parent(b"paragraph", [Node(data[at + 8 * i : at + 8 * i + 8], size) for i, size in enumerate(sizes)], 1)
            at += 8 * n

    root = _grown(paragraphs())
    if root.hash.hex() != digest:
        raise ValueError("the fingerprint's tree doesn't have its root")
    return root


def _matched(left: list[Node], right: list[Node]) -> tuple[list[bool], list[Node]]:
    """Which nodes of left have an equal one in right, one for one, and the nodes of right that are left over."""
    have = Counter(n.hash for n in right)
    met = []
    for n in left:
        met.append(have[n.hash] > 0)
        have[n.hash] -= met[-1]
    rest = []
    for n in right:
        if have[n.hash] > 0:
            have[n.hash] -= 1
            rest.append(n)
    return met, rest


def likeness(a: Node, b: Node) -> float:
    """Share of text (0 to 1) that two trees have in common: 1 exactly if the roots are equal.

    Sections, then paragraphs, then leaves: equal branches count whole, the others are opened.
    """
    if a.hash == b.hash:
        return 1.0
    whole, common, left, right = max(a.size, b.size), 0, a.children, b.children
    while left:
        met, rest = _matched(left, right)
        common += sum(n.size for n, same in zip(left, met, strict=True) if same)
        left = [c for n, same in zip(left, met, strict=True) if not same for c in n.children]
        right = [c for n in rest for c in n.children]
    return min(common / whole if whole else 0.0, 1 - 1e-9)


def edits(a: Node, b: Node) -> list[tuple[int, int]]:
    """Spans (start, end, in signs) of the first tree's text that the second doesn't have, by descending differing branches.

    Empty if the roots are equal, or if the second text only has more or another order; edits(b, a) then has the spans."""
    spans: list[tuple[int, int]] = []
    left, right = ([(a, 0)], [b]) if a.hash != b.hash else ([], [])
    while left:
        inner, inner_right = [], [c for n in right for c in n.children]
        for n, at in left:
            for c in n.children:
                inner.append((c, at))
                at += c.size
        met, right = _matched([c for c, _ in inner], inner_right)
        left = [x for x, same in zip(inner, met, strict=True) if not same]
        spans += [(at, at + n.size) for n, at in left if not n.children and n.size]
    joined: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if joined and joined[-1][1] == start:
            start = joined.pop()[0]
        joined.append((start, end))
    return joined


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points) and fingerprint of every document; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([shown(tree(x)) for x in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def ranges(keys: DataFrame, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first place of each of about so many blocks of equal numbers of keys, in order: whether its doc_id is null, the
    doc_id falling (as ~doc_id) and the digest falling. 17 bytes a block, as Spark itself needs for a sort over ranges."""
    dealt = keys.repartitionByRange(blocks, F.col("doc_id").desc_nulls_last(), F.col("digest").desc()).withColumn("block", F.spark_partition_id())
    found = dealt.groupBy("block").agg(F.max(F.struct("doc_id", "digest")).alias("place")).select("place.*").collect()
    null = np.array([r[0] is None for r in found], bool)
    falling = ~np.array([r[0] or 0 for r in found], np.int64), ~np.array([r[1] for r in found], np.int64)
    order = np.lexsort((falling[1], falling[0], null))
    return null[order], falling[0][order], falling[1][order]


def block_of(spark: SparkSession, cuts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Column:
    """The block of a row's doc_id and digest, negative less one where the row is its block's first. The cuts go to each executor
    once, as a broadcast variable; the plan doesn't hold them."""
    shared = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("long")
    def found(nulls: pd.Series, ids: pd.Series, digests: pd.Series) -> pd.Series:
        null, by_id, by_digest = shared.value
        own = nulls.to_numpy(bool), ~ids.to_numpy(np.int64), ~digests.to_numpy(np.int64)
        # as many searches as the cuts halve: the last cut at or before each place
        low, high = np.zeros(len(ids), np.int64), np.full(len(ids), len(by_id), np.int64)
        while (low < high).any():
            middle = (low + high) // 2
            at = np.minimum(middle, len(by_id) - 1)
            cut = null[at], by_id[at], by_digest[at]
            reached = (cut[0] < own[0]) | (cut[0] == own[0]) & ((cut[1] < own[1]) | (cut[1] == own[1]) & (cut[2] <= own[2]))
            go = low < high
            low, high = np.where(go & reached, middle + 1, low), np.where(go & ~reached, middle, high)
        block = low - 1
        at = np.maximum(block, 0)
        first = (null[at] == own[0]) & (by_id[at] == own[1]) & (by_digest[at] == own[2])
        return pd.Series(np.where(first, -block - 1, block))

    return found(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("digest"))


def compare_with_next(docs: DataFrame, per_block: int | None = None, block_bytes: int = 1 << 27) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and edited_at of every document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document in descending doc_id; after the last comes the first. edited_at has the spans (start-end, in code points, by
    commas) of the text that the edited one doesn't have. Null counts as empty. A null doc_id comes last. Rows that repeat
    a doc_id follow each other in order of a digest of the text; rows equal in both are one place in the order, and each
    of them is returned. A table of one document has itself for the next. An empty table gives no rows. Other columns are
    ignored.

    The order is cut in blocks of about `per_block` rows, or, without it, of block_bytes of text at most and several a
    core. Texts are shuffled once, by block; each block's first document goes to the block before as well, which needs it
    after its last. Blocks are read in order, a text and the next at a time.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    keys = written(own.select("doc_id", "digest", F.octet_length("text").cast("long").alias("bytes")), "places")
    rows, size = keys.agg(F.count("*"), F.sum("bytes")).first()
    many = -(-rows // per_block) if per_block else max(-(-(size or 0) // block_bytes), min(rows, 16 * spark.sparkContext.defaultParallelism))
    cuts = ranges(keys.select("doc_id", "digest"), max(1, many))
    own = own.withColumn("rows", F.lit(1).cast("long"))
    repeated = keys.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").toDF("id", "of", "n")
    if not repeated.isEmpty():  # such rows meet before the shuffle, and as one row thereafter
        met = own.join(repeated.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left")
        once = met.where("n is not null").groupBy("doc_id", "digest").agg(F.first("text").alias("text"), F.first("n").alias("rows"))
        own = met.where("n is null").select("doc_id", "text", "digest", "rows").unionByName(once)
    blocks, marked = max(1, len(cuts[0])), F.col("marked")
    own = own.withColumn("marked", block_of(spark, cuts)).withColumn("block", F.when(marked < 0, -marked - 1).otherwise(marked))
    to = F.array(F.struct("block", F.lit(0).alias("lent")), F.struct(F.pmod(F.col("block") - 1, F.lit(blocks)).alias("block"), F.lit(1).alias("lent")))
    own = own.select("doc_id", "digest", "rows", "text", F.explode(F.slice(to, F.lit(1), F.when(marked < 0, 2).otherwise(1))).alias("to"))
    own = own.select("to.block", "to.lent", "doc_id", "digest", "rows", "text").repartition("block").sortWithinPartitions("block", "lent", F.col("doc_id").desc_nulls_last(), F.col("digest").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # block, doc_id, rows, text, tree

        def result(text: str, t: Node) -> tuple:
            _, doc_id, n, own, fp = held
            half = len(own) // 2
            edited = own[: len(own) - half] + text[:half]
            other = tree(edited)
            spans = ",".join(f"{x}-{y}" for x, y in edits(fp, other))
            return doc_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), shown(fp), shown(other), likeness(fp, other), likeness(fp, t), spans, n

        for batch in slices(batches):
            out = []
            for block, lent, doc_id, n, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)), strict=True):
                t = tree(text)
                if held and held[0] == block:
                    out.append(result(text, t))
                held = None if lent else (block, doc_id, n, text, t)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*out, strict=True) if out else [()] * 9, KINDS, strict=True)], names=NAMES)

    found = own.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_at string, rows long")
    return found.select(*NAMES[:-1], F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select(*NAMES[:-1])


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_at", "rows"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int64()]
