"""Not-modified revisits of a web archive, resolved to the response that they stand for.

A revisit (an answer 304) belongs to the latest earlier full response of the same canonical URL. Its validators must
agree with that response's, and the headers that a 304 may update are merged into the stored ones.

The as-of join is made of windows: inside time buckets of a URL, and over one row per bucket, so a URL that holds a
third of all captures is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_group, written

# Header fields of a 304 answer that don't update the stored response, as they tell of the message or its body.
NOT_MERGED = ["age", "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "set-cookie", "te", "trailer", "transfer-encoding", "upgrade"]


def canonical_url(url: Column) -> Column:
    """Host and path: scheme, user, www, default port, fragment and the host's case don't count; query fields are sorted."""
    rest = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^[^@]*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, r"\.?(:80|:443)?$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&"))))


def url_key(url: Column) -> Column:
    """128 bits of a digest of the canonical URL: no two of an archive's URLs share it."""
    return F.substring(F.unhex(F.sha2(canonical_url(url), 256)), 1, 16)


def _opaque(etag: Column) -> Column:
    """An entity tag without its weakness mark, as If-None-Match compares them."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def latest_earlier(captures: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """captures (url_key, at, kind and any other columns) that are revisits, with `found`: the greatest `answer` of the
    latest earlier response of the same URL, null if there is none.

    kind is response or revisit, at the capture's second, answer a struct that starts with `at` and tells a response apart.
    Of responses in one second the one with the greatest answer counts as the latest; a response in the revisit's own
    second isn't earlier. Rows stay apart whatever they repeat. A null url_key or at has no earlier response.
    """
    known = captures.where(F.col("url_key").isNotNull() & F.col("at").isNotNull()).withColumn("bucket", F.floor(F.col("at") / bucket_seconds))
    known = written(known, "captures")
    response = F.when(F.col("kind") == "response", F.col("answer"))
    earlier = Window.partitionBy("url_key", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    inside = known.withColumn("near", F.max(response).over(earlier)).where("kind = 'revisit'")
    buckets = known.groupBy("url_key", "bucket").agg(F.max(response).alias("last"))
    before = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("url_key", "bucket", F.max("last").over(before).alias("far"))
    found = inside.join(carried, ["url_key", "bucket"]).withColumn("found", F.coalesce("near", "far")).drop("bucket", "near", "far")
    rest = captures.where((F.col("kind") == "revisit") & (F.col("url_key").isNull() | F.col("at").isNull()))
    return found.unionByName(rest.withColumn("found", F.lit(None).cast(captures.schema["answer"].dataType)))


def no_headers() -> Column:
    return F.create_map().cast("map<string,string>")


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored header fields, those replaced that the update has and may replace. Names are in lower case."""
    new = F.map_filter(F.coalesce(update, no_headers()), lambda k, _: ~k.isin(NOT_MERGED))
    old = F.map_filter(F.coalesce(stored, no_headers()), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(old, new)


def validation(stored: Column, update: Column) -> Column:
    """resolved if the entity tags agree, or, where one side has none, the times of change; mismatch if they differ;
    unvalidated if the two have no validator in common."""
    a, b = _opaque(stored["etag"]), _opaque(update["etag"])
    c, d = F.trim(stored["last-modified"]), F.trim(update["last-modified"])
    by_tag = F.when(a == b, "resolved").otherwise("mismatch")
    by_time = F.when(c == d, "resolved").otherwise("mismatch")
    return F.when(a.isNotNull() & b.isNotNull(), by_tag).when(c.isNotNull() & d.isNotNull(), by_time).otherwise("unvalidated")


def resolve_revisits(records: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """revisit_id, response_id, state, headers (merged; null unless resolved) and the response's payload columns.

    records: record_id long, kind, url, at timestamp or seconds, headers map<string,string> with names in lower case,
    and any payload columns named payload*. state is resolved, mismatch, unvalidated, or missing where there is no
    earlier response. A revisit without url or time is missing. Null headers count as none.

    Every revisit gives one row: rows that repeat a record_id, or have none, are records of their own. A response is told
    apart by second, record_id and headers; of responses that repeat all three at one URL, the payload of one counts. An
    empty table gives no rows. Other columns are ignored.

    Revisits carry their headers through the as-of join; payloads are shuffled once, and only those that are asked for.
    """
    payload = [c for c in records.columns if c.startswith("payload")]
    mark = F.md5(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce("headers", no_headers()))))))
    at = F.col("at").cast("long").alias("at")
    own = records.select("record_id", "kind", "headers", F.when(F.col("url").isNotNull(), url_key(F.col("url"))).alias("url_key"), at, F.struct(at, "record_id", mark.alias("mark")).alias("answer"), *payload)
    captures = own.select("record_id", "kind", "url_key", "at", F.when(F.col("kind") == "response", F.col("answer")).alias("answer"), F.when(F.col("kind") == "revisit", F.col("headers")).alias("update"))
    pairs = written(latest_earlier(captures, bucket_seconds).select(F.col("record_id").alias("revisit_id"), "url_key", F.col("found").alias("answer"), "update"), "revisit-pairs")
    uses = pairs.where("answer is not null").groupBy("url_key", "answer").agg(F.count("*").alias("uses"))
    total = pairs.count()
    stored = own.where("kind = 'response'").join(uses, ["url_key", "answer"]).groupBy("url_key", "answer", "uses").agg(F.first(F.struct("headers", *payload)).alias("stored"))
    met = join_by_group(pairs.where("answer is not null"), stored, ["url_key", "answer"], "uses", total)
    met = met.withColumn("state", validation(F.col("stored.headers"), F.col("update")))
    ok = F.col("state") == "resolved"
    met = met.select("revisit_id", F.col("answer.record_id").alias("response_id"), "state", F.when(ok, merged_headers(F.col("stored.headers"), F.col("update"))).alias("headers"), *(F.when(ok, F.col(f"stored.{c}")).alias(c) for c in payload))
    missing = pairs.where("answer is null").select("revisit_id", F.lit(None).cast("long").alias("response_id"), F.lit("missing").alias("state"))
    return met.unionByName(missing, allowMissingColumns=True)
