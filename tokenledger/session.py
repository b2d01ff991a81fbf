"""What a session needs beside Spark's own settings: the package on the executors, and a shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_done: weakref.WeakSet = weakref.WeakSet()


def ship_package(spark: SparkSession) -> None:
    """Adds the package as a zip to the session's context, once; Spark hands it to every executor, also to later ones."""
    context = spark.sparkContext
    if context in _done:
        return
    top = Path(__file__).resolve().parents[0]
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{top.name}.zip")  # the driver serves it from here until the context ends
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, p.relative_to(top.parent))
    context.addPyFile(path)
    _done.add(context)


_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or an own folder where that is unset and the master is local, as in tests on one machine.

    Raises RuntimeError where it is unset on a cluster, whose machines don't share a folder of the driver's."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-"))
        spark.sparkContext.setCheckpointDir(_own[0])
    return _own[0]


def spread(df: DataFrame) -> DataFrame:
    """df dealt out evenly, four tasks a core: for rows of which a small file holds very many and each takes long."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def by_rows(df: DataFrame, key: list[str], most: int = 1 << 18) -> DataFrame:
    """df dealt out by a hash of key into as many tasks that each has about `most` rows. The count reads the columns that decide
    about rows only."""
    n = df.select(*key).count()
    return df.repartition(max(1, -(-n // most)), *key)


def of_rows(df: DataFrame, key: list[str], rows: int, most: int = 1 << 19) -> DataFrame:
    """df, of `rows` rows at most, dealt out by a hash of key into as many tasks that each has about `most`. It stays as it is where
    a core's share is within that: Spark's own tasks have no more then, and may broadcast or sum before they shuffle."""
    n = -(-rows // most)
    return df.repartition(n, *key) if n > df.sparkSession.sparkContext.defaultParallelism else df


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
