"""Helpers that several operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..session import scratch_dir


def written(df: DataFrame, name: str, merge: bool = True) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and is computed once.

    With merge, for tables of ids and counts, the writing stage has at most 8 tasks a core, so that many small
    partitions don't become as many files. Without it, for tables of texts, tasks stay as large as their input splits."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tokenledger-{name}-{uuid.uuid4().hex}"
    (df.coalesce(8 * spark.sparkContext.defaultParallelism) if merge else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def constants(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows that the driver knows, as a local relation: no Python worker is started for it."""
    kinds = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.table([pa.array(list(x), to_arrow_type(f.dataType)) for x, f in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names=kinds.names), kinds)


def join_by_group(left: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, parts: int = 1000) -> DataFrame:
    """Inner join of left with groups (unique in keys), without a hot key landing in one task.

    groups[size] is the number of left rows of the group and total their sum. A group that holds more than 1/parts of
    them is hot, and at most `parts` are. Its rows are dealt over several salts by a hash of the row, and its one row of
    groups goes to each: 2 * parts rows more at most, whatever they hold. Only the keys of hot groups are broadcast.
    """
    many = F.ceil(F.col(size) * parts / F.lit(max(1, total))).cast("int")
    hot = groups.where(F.col(size) * parts > F.lit(total)).select(*keys, many.alias("__salts"))
    plain = [c for c, kind in left.dtypes if "map<" not in kind]
    salt = F.pmod(F.xxhash64(*plain), F.coalesce("__salts", F.lit(1))).cast("int")
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__salts")  # bound: `parts` keys
    salted = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(many, F.lit(1)) - 1)))
    return dealt.join(salted, [*keys, "__salt"]).drop("__salt")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short slices, so that what a task holds in Python stays small whatever the texts' lengths."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def int_lists(rows: list[np.ndarray], dtype=np.int64) -> pa.ListArray:
    """An Arrow list column from one array of integers a row."""
    ends = np.cumsum([0, *(len(x) for x in rows)]).astype(np.int32)
    flat = np.concatenate(rows).astype(dtype, copy=False) if rows else np.empty(0, dtype)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


# --- words as 64-bit hashes, a whole text at a time -------------------------------------------------

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_BASE, _CHUNK = 0x9E3779B97F4A7C15 | 1, 1 << 22
_powers: list[np.ndarray] = []


def mix(x: np.ndarray, k: int = 0) -> np.ndarray:
    """Spreads every bit of 64-bit words over all bits; one function for each k."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 17)
        inverse = pow(_BASE, -1, 1 << 64)
        for base in (_BASE, inverse):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers.append(np.cumprod(table))
        _powers[:] = _powers[-2:]
    return _powers[0], _powers[1]


def word_hashes(data: bytes, separators: np.ndarray = SPACES, stems: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit hash of each word of data in order; words are the runs of bytes that aren't separators.

    With stems, the hashes of the first so many bytes of each longer word follow, chunk by chunk.

    The hash is a polynomial in the word's bytes, from prefix sums over the text, so there is no loop over words.
    Long texts go through in chunks cut between words.
    """
    found, at = [], 0
    cut = None
    while at < len(data):
        end = min(at + _CHUNK, len(data))
        if end < len(data):
            cut = cut or re.compile(b"[" + re.escape(bytes(np.flatnonzero(separators).tolist())) + b"]")
            m = cut.search(data, end)
            end = m.start() if m else len(data)
        chars = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.concatenate(([False], ~separators[chars], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edge[::2], edge[1::2]
        power, inverse = _pow(len(chars))
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * power[: len(chars)], out=sums[1:])
        found.append((sums[stop] - sums[start]) * inverse[start])
        for k in stems:
            longer = start[stop - start > k]
            found.append((sums[longer + k] - sums[longer]) * inverse[longer] + np.uint64(k))
        at = end
    return mix(np.concatenate(found)) if found else np.empty(0, np.uint64)
