"""The corpus pipeline: language, exact duplicates, near duplicates, mixture, pieces, one stage after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm import cuckoo, langid, minhash, mixing, pieces
from tokenledger.llm.common import discard, written
from tokenledger.llm.queries import piece_model
from tokenledger.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted language; those that have none (`und`: no text or no letter) go. lang becomes the prediction.

    Null and empty texts go; a null doc_id, source or lang doesn't matter. Very long texts are read whole. Repeated rows
    get equal predictions and all stay. An empty table gives no rows, and if no row has a language to learn from, none
    stays; other columns go.
    """
    ship_package(spark)
    model = langid.fit(docs)
    return langid.with_language(docs.select(*COLUMNS), model).where("lang <> 'und'")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the row with the least doc_id; a null doc_id comes last, and stays if the text has no other.

    Null texts are empty texts, and one row of those stays. Of rows that repeat both doc_id and text one stays. Very long
    texts are compared whole, by digest. An empty table gives no rows; other columns go.

    What goes is decided on ids and digests alone; texts are shuffled once, to leave out those rows, and sorted nowhere.
    """
    ship_package(spark)
    found = written(cuckoo.exact_duplicates(docs).select("doc_id", "text_sha256", "kept").groupBy("doc_id", "text_sha256", "kept").count(), "exact-rows")
    listed = found.where("not kept or count > 1").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("of"), "kept")
    own = docs.select(*COLUMNS, cuckoo.text_digest(F.col("text")).alias("text_sha256"))
    met = own.join(listed.hint("shuffle_hash"), (F.col("text_sha256") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    once = met.where("kept is null").select(*COLUMNS)
    if listed.where("kept").isEmpty():
        return once
    return once.unionByName(met.where("kept").dropDuplicates(["doc_id", "text_sha256"]).select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each component of documents with a 5-word-shingle similarity of 0.8 or more.

    Null and empty texts and rows without a doc_id are near nothing and stay; rows that repeat a doc_id stay or go
    together. Very long texts are compared whole. An empty table gives no rows; other columns go.
    """
    ship_package(spark)
    gone = written(minhash.near_duplicates(docs, words=5, percent=80).where("not kept").select("doc_id").distinct(), "near-rows")
    return docs.select(*COLUMNS).join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: the words taken over the document's words, to the nearest, at least once
    if any are taken.

    Rows are told apart by doc_id, source (both null or not) and text. A null source is a source of its own; a text
    without words, null or empty, is never taken, as no words of it are. Rows that repeat all three are taken as often as
    the one of them that is taken most. Very long texts are one document. An empty table gives no rows; other columns go.
    """
    ship_package(spark)
    own = docs.select(*COLUMNS, F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    taken = mixing.mix(own, carry="digest").where("taken > 0")
    times = F.greatest(F.lit(1), F.round(F.col("taken") / F.col("size"))).cast("int")
    times = taken.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("digest").alias("text_digest")).agg(F.max(times).alias("times"))
    times = written(times, "mix-times").hint("shuffle_hash")
    met = own.join(times, (F.col("digest") == F.col("text_digest")) & F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of")))
    return met.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids and the source bytes that each stands for.

    A null text is encoded as an empty one, to no ids; repeated rows are encoded each. An empty table gives no rows.
    """
    ship_package(spark)
    return pieces.encode(docs, piece_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixture", mixture),
    ("encode", encode),
]

#: The language model and the pieces can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again by the next; a stage's input goes when
    its result stands."""
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}", merge=False)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
