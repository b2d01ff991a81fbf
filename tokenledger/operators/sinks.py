"""New versions of a table after a write: upserts, inserts that skip known keys, and replaced groups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str], fields: list[str], when: str | None = None) -> DataFrame:
    """SNK1: source rows inserted by key, or their fields set on the row that is there, where the guard (over old.* and new.*)
    allows it. source has one row a key."""
    old, new = target.withColumn("__old", F.lit(True)).alias("old"), source.withColumn("__new", F.lit(True)).alias("new")
    met = old.join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys], "full")
    take = F.col("new.__new").isNotNull() & (F.col("old.__old").isNull() | (F.expr(when) if when else F.lit(True)))
    return met.select(*(F.coalesce(f"old.{c}", f"new.{c}").alias(c) if c in keys else F.when(F.coalesce(take, F.lit(False)) & (F.col("old.__old").isNull() | F.lit(c in fields)), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in target.columns))


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """SNK2: target and the source rows whose key is new, one row a key."""
    return target.unionByName(source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti").select(target.columns))


def replace_group(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """SNK3: all rows of the keys in source replaced by source's rows."""
    return target.join(source.select(key).distinct(), key, "left_anti").select(target.columns).unionByName(source.select(target.columns))


@dataclass
class BucketedTable:
    """A table in a folder by buckets of a key's hash. A write reads and overwrites the buckets of its source's keys only;
    the files of the others stay as they are. One writer at a time."""

    spark: SparkSession
    path: str
    key: str
    buckets: int = 64
    spread: int = 4  # tasks that write a bucket, so that a key with very many rows isn't one task's

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame, mode: str) -> None:
        columns = [c for c in df.columns if c != "bucket"]
        dealt = df.repartition("bucket", F.pmod(F.xxhash64(*columns), F.lit(self.spread)))
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def create(self, df: DataFrame) -> BucketedTable:
        self._write(self._placed(df), "errorifexists")
        return self

    def read(self, keys: list | None = None) -> DataFrame:
        """All rows, or those of some keys, from their buckets' files."""
        df = self.spark.read.parquet(self.path)
        if keys is not None:
            wanted = [r[0] for r in self._placed(self.spark.createDataFrame([(k,) for k in keys], f"{self.key} {dict(df.dtypes)[self.key]}")).select("bucket").distinct().collect()]
            df = df.where(F.col("bucket").isin(wanted) & F.col(self.key).isin(keys))
        return df.drop("bucket")

    def _change(self, source: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        placed = self._placed(source)
        touched = [r[0] for r in placed.select("bucket").distinct().collect()]  # bound: the number of buckets
        if touched:
            old = self.spark.read.parquet(self.path)
            columns = [c for c in old.columns if c != "bucket"]
            self._write(self._placed(change(old.where(F.col("bucket").isin(touched)).select(columns), source.select(columns))), "overwrite")

    def upsert(self, source: DataFrame, keys: list[str], fields: list[str], when: str | None = None) -> None:
        """SNK1 on the touched buckets; the table's key is one of keys."""
        self._change(source, lambda old, new: upsert(old, new, keys, fields, when))

    def insert_ignore(self, source: DataFrame, keys: list[str]) -> None:
        """SNK2 on the touched buckets."""
        self._change(source, lambda old, new: insert_ignore(old, new, keys))

    def replace_group(self, source: DataFrame) -> None:
        """SNK3 on the touched buckets: all rows of the keys in source give way to source's."""
        self._change(source, lambda old, new: replace_group(old, new, self.key))
