"""Exact duplicates with an index of live digests behind cuckoo filters.

The index is dealt into buckets by the leading bits of the digest. Each bucket has a cuckoo filter, which answers "not
seen" without a look at the content; only its hits are verified against what is stored. A full filter is rebuilt at twice
the size from the stored keys. A bucket is one task's work, and buckets grow in number with the corpus.

`exact_duplicates` puts a whole corpus through such filters and groups the hits alone. `Index` is kept between runs:
documents are inserted, deleted and looked up, and hits are compared with the stored text, by digests that are made where it is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from .common import constants, discard, join_by_group, slices, written

SPACE = r"[\x20\x09-\x0D]+"
OTHER_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"  # runs of white space that aren't one space already


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; a digest (bytes) has two buckets, each found from the other and the fingerprint."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 64, table: bytes | None = None):
        self.slots = np.frombuffer(table, np.uint16).reshape(-1, self.SLOTS).copy() if table else np.zeros((buckets, self.SLOTS), np.uint16)
        self.mask = len(self.slots) - 1

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[-2:], "little") or 1
        first = int.from_bytes(digest[-10:-2], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & self.mask

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.slots[a] or mark in self.slots[b]

    def insert(self, digest: bytes) -> bool:
        """False if the filter overflowed; it then has lost one fingerprint and is to be rebuilt."""
        mark, a, b = self._places(digest)
        for place in (a, b):
            free = np.flatnonzero(self.slots[place] == 0)
            if len(free):
                self.slots[place, free[0]] = mark
                return True
        place = b
        for turn in range(self.KICKS):
            slot = (mark + turn) % self.SLOTS
            out = int(self.slots[place, slot])
            self.slots[place, slot] = mark
            mark, place = out, self._other(place, out)
            free = np.flatnonzero(self.slots[place] == 0)
            if len(free):
                self.slots[place, free[0]] = mark
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for place in (a, b):
            at = np.flatnonzero(self.slots[place] == mark)
            if len(at):
                self.slots[place, at[0]] = 0
                return True
        return False


class DigestFilter:
    """A filter and the part of each inserted digest that it needs to be rebuilt at twice the size when it overflows."""

    PART = 10

    def __init__(self):
        self.filter, self.stored, self.resized = CuckooFilter(), bytearray(), 0

    def insert(self, digest: bytes) -> bool:
        """True if the digest may have been inserted before; if it hasn't, it is now."""
        if digest in self.filter:
            return True
        self.stored += digest[-self.PART :]
        if not self.filter.insert(digest):
            self.filter, more = _built(bytes(self.stored[i : i + self.PART]) for i in range(0, len(self.stored), self.PART))
            self.resized += more
        return False


def _built(digests, buckets: int = 64) -> tuple[CuckooFilter, int]:
    """A filter that holds all of digests, and how often it was doubled for that."""
    digests, doubled = list(digests), 0
    while True:
        made = CuckooFilter(buckets)
        if all(made.insert(x) for x in digests):
            return made, doubled
        buckets, doubled = 2 * buckets, doubled + 1


def text_digest(text: Column) -> Column:
    """SHA-256 in hex of the text with each run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def bucket_of(digest: Column, bits: int) -> Column:
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 32 - bits).cast("int")


def bucket_bits(rows: int, per_bucket: int = 50_000, least: int = 6) -> int:
    """Leading digest bits so that a bucket has about per_bucket digests at most; 2^least buckets at least."""
    return min(31, max(least, int(np.ceil(np.log2(max(1, rows / per_bucket))))))


def probed(rows: DataFrame, bits: int) -> DataFrame:
    """rows (text_sha256, doc_id, copies) with `hit`: whether the filter of the digest's bucket had it, maybe, when it came.

    The first row of a digest is a hit only by chance; every other one is a hit.
    """
    dealt = rows.select(bucket_of(F.col("text_sha256"), bits).alias("bucket"), "text_sha256", "doc_id", "copies").repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, live = None, DigestFilter()
        for batch in batches:
            hits = []
            for bucket, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != at:
                    at, live = bucket, DigestFilter()
                hits.append(live.insert(bytes.fromhex(digest)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(hits, pa.bool_())], names=["text_sha256", "doc_id", "copies", "hit"])

    return dealt.mapInArrow(run, "text_sha256 string, doc_id long, copies long, hit boolean")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document.

    Null texts count as empty; all empty texts are equal. Of equal texts the row with the least doc_id is kept; a null
    doc_id comes last, and is kept only in a group that has no other. Rows that repeat a doc_id and its text count in
    group_size and are all marked kept if the doc_id is the least. An empty table gives no rows. Other columns are
    ignored.

    Copies are first counted where they are read, in 16 parts a digest at most, so a digest with a third of all rows
    sends a few rows only. What the filter hasn't seen and nothing hits later is alone, and done; the digests of hits are
    verified by grouping the stored digests in full, and only their documents are joined with a group.
    """
    digests = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("text_sha256")), "digests")
    total = digests.count()
    counted = digests.groupBy("text_sha256", F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("part")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    seen = written(probed(counted, bucket_bits(total)), "probed-digests")
    hits = seen.where("hit or copies > 1").select("text_sha256").distinct()
    groups = seen.join(hits, "text_sha256").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = written(groups, "digest-groups")
    alone = seen.join(groups, "text_sha256", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.col("copies").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    met = join_by_group(digests, groups, ["text_sha256"], "group_size", total)
    return met.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256").unionByName(alone)


# --- the index that is kept ------------------------------------------------------------------------------

TABLES = {"filters": "filter binary", "content": "text_sha256 string, text string", "holders": "text_sha256 string, doc_id long, copies long"}
LISTED = 4096  # touched buckets that are named to a read; of more, all are read
DEAD = 1 << 20  # digests lost in a deletion that are broadcast (some 100 MB); of more, the buckets' texts are shuffled


@dataclass
class Index:
    """Three tables in a folder, each by bucket of the digest (2^bits of them): filters (filter), content (text_sha256, text: a
    row for each live digest) and holders (text_sha256, doc_id, copies: what was inserted, and, below zero, deleted).

    An insertion appends to the buckets of its new digests, a deletion writes the content of those buckets anew that lose a
    digest, and filters are written for touched buckets; files of other buckets stay as they are. One writer at a time."""

    spark: SparkSession
    path: str
    bits: int

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets: no other files are read."""
        schema = f"{TABLES[name]}, bucket int"
        if buckets == [] or not self._stands(name):
            return constants(self.spark, [], schema)
        df = self.spark.read.schema(schema).parquet(self._folder(name))
        return df if buckets is None or len(buckets) > LISTED else df.where(F.col("bucket").isin(buckets))

    @property
    def filters(self) -> DataFrame:
        return self.table("filters")

    @property
    def content(self) -> DataFrame:
        return self.table("content")

    def live(self, buckets: list[int] | None = None) -> DataFrame:
        """text_sha256, keep_id (the least live doc_id) and group_size of every live digest."""
        return self.holders(buckets).groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))

    def holders(self, buckets: list[int] | None = None) -> DataFrame:
        """bucket, text_sha256, doc_id and copies of every live document."""
        return self.table("holders", buckets).groupBy("bucket", "text_sha256", "doc_id").agg(F.sum("copies").alias("copies")).where("copies > 0")

    def _folder(self, name: str) -> str:
        return f"{self.path}/{self.bits}/{name}"

    def _stands(self, name: str) -> bool:
        path, fs = self._at(self._folder(name))
        return fs.exists(path)

    def _at(self, folder: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def append(self, name: str, rows: DataFrame, dealt: bool = False) -> None:
        """Adds rows; dealt rows are in few tasks a bucket already, and aren't shuffled."""
        (rows if dealt else rows.repartition("bucket")).write.mode("append").partitionBy("bucket").parquet(self._folder(name))

    def replace(self, name: str, rows: DataFrame, touched: list[int], dealt: bool = False) -> None:
        """Writes the touched buckets anew, beside the table, and then puts each in its place; one without rows goes. Nothing
        of the table changes before all of them are written. If the driver is lost while they are put in place, those that are
        not yet in place are still beside the table, whole. dealt as in `append`."""
        if not touched:
            return
        beside = f"{self.path}/{self.bits}/_{name}-{uuid.uuid4().hex}"
        top, fs = self._at(beside)
        (rows if dealt else rows.repartition("bucket")).write.partitionBy("bucket").parquet(beside)
        for k in touched:
            new, old = (self._at(f"{x}/bucket={k}")[0] for x in (beside, self._folder(name)))
            fs.delete(old, True)
            if fs.exists(new):
                fs.mkdirs(old.getParent())
                if not fs.rename(new, old):
                    raise OSError(f"{beside}/bucket={k} can't be put in its place")
        fs.delete(top, True)


def _buckets(rows: DataFrame) -> list[int]:
    return [r[0] for r in rows.select("bucket").distinct().collect()]  # bound: the number of buckets


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.coalesce("text", F.lit("")), OTHER_SPACE, " ")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("text_sha256"))


def proof(text: Column) -> Column:
    """64 bytes that stand for a text where it is compared: SHA-512, which no step finds texts by."""
    return F.unhex(F.sha2(text, 512))


def _once_a_task(rows: DataFrame) -> DataFrame:
    """rows (bucket, text_sha256, text) with the first of each digest and task alone, or few where a task has very many digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in slices(batches):
            new = []
            for digest in batch.column(1).to_pylist():
                new.append(digest not in seen)
                seen.add(digest)
            yield batch.filter(pa.array(new, pa.bool_()))
            if len(seen) > 1 << 18:
                seen.clear()

    return rows.mapInArrow(run, "bucket int, text_sha256 string, text string")


def _chosen(texts: DataFrame, digests: DataFrame, bits: int) -> DataFrame:
    """bucket, text_sha256 and text of each of digests (bucket, text_sha256) that texts have, once, dealt by bucket. Texts are
    shuffled once; the digests go with them as rows without a text, so that there is no join."""
    rows = texts.withColumn("__asked", F.lit(None).cast("boolean")).unionByName(digests.select("bucket", "text_sha256", F.lit(None).cast("string").alias("text"), F.lit(True).alias("__asked")))
    once = rows.repartition(1 << min(bits, 12), "bucket").groupBy("bucket", "text_sha256").agg(F.first("text", True).alias("text"), F.max("__asked").alias("__asked"))
    return once.where("__asked and text is not null").drop("__asked")


def empty_index(spark: SparkSession, bits: int = 6, path: str | None = None) -> Index:
    """An index in a folder of its own, in the shared folder where none is given."""
    return Index(spark, path or f"{scratch_dir(spark)}/tokenledger-index-{uuid.uuid4().hex}", bits)


def maybe_live(index: Index, digests: DataFrame) -> DataFrame:
    """bucket and text_sha256 of the distinct digests (text_sha256) that the filters may have. The content isn't read."""
    asked = digests.select("text_sha256").distinct().select(bucket_of(F.col("text_sha256"), index.bits).alias("bucket"), F.unhex("text_sha256").alias("digest"), F.lit(None).cast("binary").alias("filter"))
    rows = asked.unionByName(index.filters.select("bucket", F.lit(None).cast("binary").alias("digest"), "filter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in slices(batches):
            found = []
            for bucket, digest, table in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if table is not None:
                    at, own = bucket, CuckooFilter(table=table)
                elif bucket == at and digest in own:
                    found.append((bucket, digest.hex()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.string())], names=["bucket", "text_sha256"])

    return rows.repartition("bucket").sortWithinPartitions("bucket", F.col("digest").asc_nulls_first()).mapInArrow(run, "bucket int, text_sha256 string")


def lookup(index: Index, docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, keep_id and live of every document of docs: keep_id is the least live doc_id with an equal text, null
    if there is none or none has a doc_id. A hit of the filters is compared with the stored text of its bucket; buckets without
    hits aren't read.

    Texts are compared by their `proof`, which is made where a document and where a stored text is read, so neither is shuffled, and
    once a digest; the documents then get their digest's answer by ids and digests alone, a digest that many share over salts.

    Null texts count as empty, repeated rows are each looked up, an empty table or index gives no rows or no hits."""
    own = _keyed(docs)
    proved = written(own.select("doc_id", "text_sha256", proof(F.col("text")).alias("proof")), "asked-digests")
    keys = proved.select("doc_id", "text_sha256")
    maybe = written(maybe_live(index, keys), "maybe-live")
    hit = _buckets(maybe)
    asked = proved.groupBy("text_sha256", "proof").agg(F.count("*").alias("n")).select("text_sha256", "proof")
    stored = index.table("content", hit).select("bucket", "text_sha256", proof(F.col("text")).alias("proof"))
    stored = stored.join(maybe, ["bucket", "text_sha256"])  # a digest once; Spark would move a semi join to before the proof, and shuffle texts
    same = asked.join(stored, ["text_sha256", "proof"]).select("text_sha256")
    found = same.join(index.live(hit), "text_sha256").select("text_sha256", "keep_id", F.lit(True).alias("live"))
    sizes = keys.groupBy("text_sha256").agg(F.count("*").alias("n"))
    answers = written(sizes.join(found, "text_sha256", "left").select("text_sha256", "n", "keep_id", F.coalesce("live", F.lit(False)).alias("live")), "answers")
    discard(maybe)
    return join_by_group(keys, answers, ["text_sha256"], "n", keys.count()).select("doc_id", "text_sha256", "keep_id", "live")


def insert(index: Index, docs: DataFrame, per_bucket: int = 50_000) -> Index:
    """The index with the documents of docs. A digest that the filters don't have is new without a look at the content.

    Copies in a task are one text before they are shuffled, which they are once, by bucket. Null texts count as empty, repeated
    rows are copies of one document, an empty table changes nothing."""
    own = _keyed(docs)
    bucket = bucket_of(F.col("text_sha256"), index.bits).alias("bucket")
    counted = written(own.groupBy("text_sha256", "doc_id").agg(F.count("*").alias("copies")), "inserted")
    maybe = written(maybe_live(index, counted), "maybe-live")
    known = index.table("content", _buckets(maybe)).join(maybe, ["bucket", "text_sha256"], "left_semi").select("text_sha256")
    fresh = written(counted.select("text_sha256").distinct().join(known, "text_sha256", "left_anti").select(bucket, "text_sha256"), "new-digests")
    index.append("content", _chosen(_once_a_task(own.select(bucket, "text_sha256", "text")), fresh, index.bits), dealt=True)
    index.append("holders", counted.select(bucket, "text_sha256", "doc_id", "copies"))
    out = _updated(index, fresh, "insert", per_bucket)
    discard(counted, maybe, fresh)
    return out


def delete(index: Index, docs: DataFrame, per_bucket: int = 50_000) -> Index:
    """The index without the documents of docs (doc_id and text). One row takes out one copy of a doc_id and text; what isn't
    live is ignored. A digest goes when its last copy goes."""
    counted = _keyed(docs).groupBy(bucket_of(F.col("text_sha256"), index.bits).alias("bucket"), "text_sha256", "doc_id").agg(F.count("*").alias("gone"))
    counted = written(counted, "deleted")
    touched = _buckets(counted)
    met = counted.toDF("in", "of", "id", "gone").join(index.holders(touched), (F.col("text_sha256") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")))
    taken = written(met.select("bucket", "text_sha256", "doc_id", (-F.least("gone", "copies")).alias("copies")), "taken")
    index.append("holders", taken)
    dead = written(taken.select("bucket", "text_sha256").distinct().join(index.holders(touched).select("bucket", "text_sha256").distinct(), ["bucket", "text_sha256"], "left_anti"), "dead-digests")
    losing = _buckets(dead)
    if losing:
        few = dead.count() <= DEAD  # then the buckets' files are filtered where they are read
        content, gone = index.table("content", losing).where(F.col("bucket").isin(losing)), dead.hint("broadcast") if few else dead
        index.replace("content", content.join(gone, ["bucket", "text_sha256"], "left_anti").select("bucket", "text_sha256", "text"), losing, dealt=few)
    out = _updated(index, dead, "delete", per_bucket)
    discard(counted, taken, dead)
    return out


def _updated(index: Index, changed: DataFrame, op: str, per_bucket: int) -> Index:
    """The filters after digests (bucket, text_sha256) are inserted or deleted; those that overflow are built anew from the
    stored keys, and all tables with more buckets once a bucket has more than per_bucket digests on average."""
    bits = bucket_bits(index.content.select("text_sha256").count(), per_bucket, index.bits)
    if bits > index.bits:
        more = Index(index.spark, index.path, bits)
        bucket = bucket_of(F.col("text_sha256"), bits).alias("bucket")
        more.append("content", index.content.select(bucket, "text_sha256", "text"))
        more.append("holders", index.holders().select(bucket, "text_sha256", "doc_id", "copies"))
        more.append("filters", _from_content(more.content))
        return more
    touched = _buckets(changed)
    rows = changed.select("bucket", F.unhex("text_sha256").alias("digest"), F.lit(None).cast("binary").alias("filter"))
    rows = rows.unionByName(index.table("filters", touched).select("bucket", F.lit(None).cast("binary").alias("digest"), "filter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, full = None, CuckooFilter(), False
        out = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([None if full else own.slots.tobytes()], pa.binary())], names=["bucket", "filter"])
        for batch in slices(batches):
            for bucket, digest, table in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != at:
                    if at is not None:
                        yield out()
                    at, own, full = bucket, CuckooFilter(), False
                if table is not None:
                    own = CuckooFilter(table=table)
                elif op == "delete":
                    own.delete(digest)
                elif not full:  # a full one is built anew from the content
                    full = not own.insert(digest)
        if at is not None:
            yield out()

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", F.col("digest").asc_nulls_first())
    filters = written(dealt.mapInArrow(run, "bucket int, filter binary"), "filters")
    full = _buckets(filters.where("filter is null"))
    if full:
        filters = filters.where("filter is not null").unionByName(_from_content(index.table("content", full).where(F.col("bucket").isin(full))))
    index.replace("filters", filters, touched)
    return index


def _from_content(content: DataFrame) -> DataFrame:
    """(bucket, filter) of each bucket, from its stored digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digests = None, []
        size = lambda: 1 << max(6, (len(digests) * 5 // 16).bit_length())  # noqa: E731  # four fifths of the slots at most
        out = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([_built(digests, size())[0].slots.tobytes()], pa.binary())], names=["bucket", "filter"])
        for batch in slices(batches):
            for bucket, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != at:
                    if at is not None:
                        yield out()
                    at, digests = bucket, []
                digests.append(digest)
        if at is not None:
            yield out()

    return content.select("bucket", F.unhex("text_sha256").alias("digest")).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, filter binary")
