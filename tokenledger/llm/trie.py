"""Prefix trie of conversations from sorted neighbours.

Every turn is a token of fixed width (a digest and the turn's words), so a conversation is one string whose order puts
common prefixes side by side. Equal conversations are one sequence with a count. The sorted sequences are cut in ranges;
in a range each pair of neighbours is an edge as deep as their common prefix, and a union-find takes the edges in
descending depth: a component is a run of neighbours, and each merge makes a branching node, whose children are the
components that meet there. The turns between two branching nodes are a chain of nodes with the same members.

Only the nodes on the paths of a range's first and last sequence can go on in another range. They leave it contracted to
sums over what hangs below them; then the forests of some dozens of neighbouring ranges are merged by the prefix's digest,
which closes all nodes but those on the outermost paths, and so on until one forest is left.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .mixing import words_of

DIGEST, WIDTH = 20, 28
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODES = "p long, open boolean, id string, parent_id string, left boolean, right boolean, depth long, words long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_ARROW = pa.schema([(name, {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[kind]) for name, kind in (x.split() for x in NODES.split(", "))])


def token(role: Column, text: Column) -> Column:
    """A turn as 28 signs: 120 bits of a digest of role and text, and its words."""
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.substring(F.base64(F.unhex(digest)), 1, DIGEST), F.lpad(F.hex(words_of(text)), WIDTH - DIGEST, "0"))


def sequences(conversations: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """conv_id and key (its tokens, joined) of every conversation, rebuilt: its first h turns are replaced by the first h
    of conversation conv_id - conv_id % every, with h = crc32(conv_id as text) % heads.

    Turns are in the order of turn, null first; equal ones in the order of their tokens. Null roles and texts are empty.
    Rows without a conv_id belong to no conversation and are left out. A conversation's tokens are held in one row.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", token(text("role"), text("text")).alias("token"))
    turns = written(turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % every), "turns", merge=False)
    placed = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("some"), "turn", "token")))
    whole = lambda rows: rows.repartition("base").groupBy("base", "conv_id").agg(F.transform(placed, lambda x: x["token"]).alias("tokens"))
    first = whole(turns.where("conv_id = base")).select("base", F.slice("tokens", 1, heads - 1).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    joined = whole(turns).join(first, "base", "left").withColumn("h", h.cast("int"))
    key = F.array_join(F.concat(F.expr("slice(coalesce(head, array()), 1, h)"), F.expr("slice(tokens, h + 1, greatest(size(tokens) - h, 0))")), "")
    found = written(joined.select("conv_id", key.alias("key")).withColumn("class", F.substring(F.sha2("key", 256), 1, 32)), "sequences", merge=False)
    discard(turns)
    return found


def end_digests(members: DataFrame, most: int = 4096) -> DataFrame:
    """class and ends_sha256 from (class, conv_id): the digest of each class's ids in ascending order.

    Ids are sorted over ranges, so a class of any size is spread, and joined to texts of up to `most` ids; the digest
    then runs over a class's texts in order and holds one at a time.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, at = [], 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or classes[i] != classes[at] or i - at == most:
                    rows.append((classes[at], ids[at], ",".join(map(str, ids[at:i]))))
                    at = i
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["class", "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, running = None, None
        for batch in batches:
            done = []
            for c, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if c == name:
                    running.update(b"," + text.encode())
                    continue
                if name is not None:
                    done.append((name, running.hexdigest()))
                name, running = c, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], names=["class", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, running.hexdigest())], names=["class", "ends_sha256"])

    texts = members.repartitionByRange("class", "conv_id").sortWithinPartitions("class", "conv_id").mapInArrow(joined, "class string, first long, ids string")
    return texts.repartition("class").sortWithinPartitions("class", "first").mapInArrow(digested, "class string, ends_sha256 string")


def _common(a: str, b: str) -> int:
    """Turns of the common prefix of two keys."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def _prefix_ids(key: str) -> list[str]:
    """A digest of each prefix of a key, from the empty one on."""
    running, ids = hashlib.sha256(), []
    for at in range(0, len(key) + WIDTH, WIDTH):
        ids.append(running.hexdigest()[:32])
        running.update(key[at : at + WIDTH].encode())
    return ids


class _Range:
    """The forest of one range of sorted sequences; components are known by their first sequence."""

    def __init__(self) -> None:
        self.last: str | None = None
        self.first_ids: list[str] = []
        # by sequence: depth it is pending at, members, least member, last sequence, and sums over closed children
        self.cur, self.n, self.conv, self.end = (array("q") for _ in range(4))
        self.kids, self.leaves, self.saved = (array("q") for _ in range(3))
        self.child, self.child_end, self.top = array("q"), array("q"), array("q")  # rows that wait for their parent; union-find
        self.lcp, self.length, self.words, self.offset, self.ends = array("q"), array("q"), array("q"), array("q"), []
        # by row
        self.row = {k: array("q") for k in ("start", "depth", "n", "conv", "kids", "leaves", "saved", "parent", "open", "end", "next")}

    def add(self, key: str, conv: int, n: int, ends: str) -> None:
        i, length = len(self.cur), len(key) // WIDTH
        common = -1 if self.last is None else _common(self.last, key)
        if self.last is None:
            self.first_ids = _prefix_ids(key)
            self.words.append(0)  # of the root
        self.offset.append(len(self.words) - common - 1 if i else 0)
        self.words.extend(int(key[at - 8 : at], 16) for at in range((max(common, 0) + 1) * WIDTH, len(key) + 1, WIDTH))
        for column, value in ((self.cur, length), (self.n, n), (self.conv, conv), (self.end, i), (self.kids, 0), (self.leaves, 0), (self.saved, 0), (self.child, -1), (self.child_end, -1), (self.top, i), (self.lcp, common), (self.length, length)):
            column.append(value)
        self.ends.append(ends)
        self.last = key

    def climb(self, i: int, depth: int) -> None:
        """Makes the nodes of component i from the depth it is pending at down to just below `depth`, where it then is pending."""
        row, m, full = self.row, len(self.cur), self.end[i]
        open_ = i == 0 or full == m - 1
        while self.cur[i] > depth:
            d, at = self.cur[i], len(row["start"])
            if not open_:
                if not self.kids[i]:
                    self.leaves[i] = 1
                self.saved[i] += (self.n[i] - 1) * self.words[self.offset[i] + d]
            for name, value in (("start", i), ("depth", d), ("n", self.n[i]), ("conv", self.conv[i]), ("kids", self.kids[i]), ("leaves", self.leaves[i]), ("saved", self.saved[i]), ("parent", -1), ("open", open_), ("end", full), ("next", -1)):
                row[name].append(value)
            child = self.child[i]
            while child >= 0:
                row["parent"][child] = at
                child = row["next"][child]
            self.child[i] = self.child_end[i] = at
            if open_:
                self.kids[i] = self.leaves[i] = self.saved[i] = 0
            else:
                self.kids[i] = 1
            self.cur[i] = d - 1

    def find(self, i: int) -> int:
        top = self.top
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    def build(self) -> None:
        depths = np.array(self.lcp[1:], np.int64)
        for j in (np.argsort(-depths, kind="stable") + 1).tolist():
            depth, i = self.lcp[j], self.find(j - 1)
            self.climb(i, depth)
            self.climb(j, depth)
            self.top[j] = i
            for column in (self.n, self.kids, self.leaves, self.saved):
                column[i] += column[j]
            self.conv[i] = min(self.conv[i], self.conv[j])
            self.end[i] = self.end[j]
            if self.child[j] >= 0:
                if self.child[i] < 0:
                    self.child[i] = self.child[j]
                else:
                    self.row["next"][self.child_end[i]] = self.child[j]
                self.child_end[i] = self.child_end[j]
        self.climb(0, -1)

    def batches(self, p: int, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        last_ids, m, row = _prefix_ids(self.last), len(self.cur), self.row

        def name(r: int) -> str:
            return (self.first_ids if row["start"][r] == 0 else last_ids)[row["depth"][r]]

        for lo in range(0, len(row["start"]), size):
            out: list[list] = [[] for _ in _ARROW]
            for r in range(lo, min(lo + size, len(row["start"]))):
                i, d, up, open_ = row["start"][r], row["depth"][r], row["parent"][r], bool(row["open"][r])
                # the sequence that ends here, if any, is the component's first: it is the shortest
                ends = self.ends[i] if d == self.length[i] else None
                over = up >= 0 and bool(row["open"][up])
                values = (
                    p, open_, name(r) if open_ else None, name(up) if up >= 0 and (open_ or over) else None, i == 0, row["end"][r] == m - 1, d,
                    self.words[self.offset[i] + d], row["conv"][r], row["conv"][up] if up >= 0 and not over else None, row["n"][r], row["kids"][r], row["leaves"][r], row["saved"][r], ends,
                )
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _ARROW, strict=True)], schema=_ARROW)


def forests(classes: DataFrame) -> DataFrame:
    """The nodes of every range of the sorted classes (key, conv_id, n, ends_sha256); open ones may go on in another range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, p = _Range(), 0
        for batch in batches:
            p = batch.column(4)[0].as_py() if batch.num_rows else p
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                made.add(*row)
        if made.last is not None:
            made.build()
            yield from made.batches(p)

    ranges = classes.repartitionByRange("key").sortWithinPartitions("key")
    return ranges.select("key", "conv_id", "n", "ends_sha256", F.spark_partition_id().cast("long").alias("p")).mapInArrow(run, NODES)


def merged(nodes: DataFrame, fan: int) -> DataFrame:
    """One level: the open nodes of `fan` neighbouring forests as one, which closes all but those on its outermost paths;
    the last forest that is left is closed as a whole."""
    last = (nodes.agg(F.max("p")).first()[0] or 0) < fan

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        low, high = min(r["p"] for r in rows), max(r["p"] for r in rows)
        found: dict[str, dict] = {}
        for r in rows:
            left, right = not last and r["left"] and r["p"] == low, not last and r["right"] and r["p"] == high
            known = found.setdefault(r["id"], r | {"left": False, "right": False})
            if known is not r and "seen" in known:
                for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    known[name] += r[name]
                known["conv_id"] = min(known["conv_id"], r["conv_id"])
                known["ends_sha256"] = known["ends_sha256"] or r["ends_sha256"]
            known["seen"] = True
            known["left"], known["right"] = known["left"] or left, known["right"] or right
        for r in sorted(found.values(), key=lambda r: -r["depth"]):
            r["p"], r["open"] = low // fan, r["left"] or r["right"]
            over = found.get(r["parent_id"])
            if not r["open"]:
                if not r["n_children"]:
                    r["n_leaves"] = 1
                r["saved_tokens"] += (r["n_convs"] - 1) * r["words"]
                if over:
                    over["n_children"] += 1
                    over["n_leaves"] += r["n_leaves"]
                    over["saved_tokens"] += r["saved_tokens"]
        for r in found.values():
            over = found.get(r["parent_id"])
            r["parent_conv_id"] = over["conv_id"] if over and not (over["left"] or over["right"]) else None
        return pa.Table.from_pylist(list(found.values()), schema=_ARROW)

    return nodes.groupBy(F.floor(F.col("p") / fan)).applyInArrow(run, NODES)


def prefix_trie(conversations: DataFrame, every: int = 20, heads: int = 4, fan: int = 64) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations (`sequences`), the root included:
    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    saved_tokens sums, over the node's subtree, (members - 1) * words of the node's last turn. ends_sha256 is the digest
    of the ids of the members that end here, joined by commas. Turns are equal if role and text are, null as empty; ids
    repeated with equal turns are turns of their own. A table without conversations has no rows, not even a root. Other
    columns are ignored. A range's nodes are in one task's memory, about 100 bytes each, and of the contracted forests
    `fan` times two paths.
    """
    found = sequences(conversations, every, heads)
    counted = found.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).withColumn("class", F.substring(F.sha2("key", 256), 1, 32))
    classes = written(counted.join(end_digests(found.select("class", "conv_id")), "class").select("key", "conv_id", "n", "ends_sha256"), "classes", merge=False)
    nodes = written(forests(classes), "forests", merge=False)
    discard(found, classes)
    level, closed = nodes.where("open"), None
    while True:
        level = written(merged(level, fan), "level", merge=False)
        done = level.where("not open")
        closed = done if closed is None else closed.unionByName(done)
        level = level.where("open")
        if level.isEmpty():
            break
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    known = closed.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("over"))
    # a range asks for its own paths only, so a parent of very many nodes, such as the root, isn't one key
    asked = nodes.where("open").select("p", F.col("id").alias("parent_id")).distinct().join(known, "parent_id")
    inner = nodes.where("not open").join(asked, ["p", "parent_id"], "left")
    outer = closed.join(known, "parent_id", "left")
    rows = inner.select(*columns, "over").unionByName(outer.select(*columns, "over"))
    return rows.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "over")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))).drop("over")
