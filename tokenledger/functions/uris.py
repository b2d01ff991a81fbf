"""URLs, content references and HTTP header values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gateways that stand for content-addressed schemes.
IPFS_GATEWAY, ARWEAVE_GATEWAY, ONCHFS_GATEWAY = "https://ipfs.io/ipfs/", "https://arweave.net/", "https://onchfs.fxhash2.xyz/"
CID_PATTERN = r"(Qm[1-9A-HJ-NP-Za-km-z]{44}|b[a-z2-7]{58,})"


def is_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"), F.lit(False))


def is_https_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^(?i)https://[^/?#]+"), F.lit(False))


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def ipfs_ref(c: Column) -> Column:
    """The content id and what follows it (path, query, fragment) of an ipfs:// URI or a gateway URL."""
    return _or_null(F.regexp_extract(c, rf"(?:^ipfs://(?:ipfs/)?|/ipfs/)({CID_PATTERN}(?:[/?#].*)?)$", 1))


def arweave_ref(c: Column) -> Column:
    return _or_null(F.regexp_extract(c, r"^(?:ar://|https?://(?:[a-z0-9\-]+\.)?arweave\.net/)([A-Za-z0-9_\-]{43}(?:[/?#].*)?)$", 1))


def onchfs_ref(c: Column) -> Column:
    return _or_null(F.regexp_extract(c, r"^(?:onchfs://|https?://onchfs\.[^/]+/)([0-9a-fA-F]{64}(?:[/?#].*)?)$", 1))


def to_gateway(c: Column) -> Column:
    return (
        F.when(c.startswith("ipfs://"), F.concat(F.lit(IPFS_GATEWAY), F.regexp_replace(c, "^ipfs://(ipfs/)?", "")))
        .when(c.startswith("ar://"), F.concat(F.lit(ARWEAVE_GATEWAY), F.substring(c, 6, 1_000_000)))
        .when(c.startswith("onchfs://"), F.concat(F.lit(ONCHFS_GATEWAY), F.substring(c, 10, 1_000_000)))
        .otherwise(c)
    )


def gateway_candidates(ref: Column, gateways: list[str], template: str = "{gateway}/ipfs/{ref}") -> Column:
    before, _, after = template.partition("{ref}")
    return F.array(*(F.concat(F.lit(before.replace("{gateway}", g.rstrip("/"))), ref, F.lit(after)) for g in gateways))


def entry_ref(c: Column) -> Column:
    """The directory's index page: /index.html before query and fragment; null if it is there already."""
    path = F.regexp_extract(c, r"^([^?#]*)", 1)
    rest = F.regexp_extract(c, r"^[^?#]*(.*)$", 1)
    return F.when(~path.rlike(r"/index\.html$"), F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/index.html"), rest))


def parse_data_uri(c: Column) -> Column:
    """mime (text/plain where none is given), params, base64 flag and decoded bytes of a data URI; null for anything else."""
    head = F.regexp_extract(c, r"(?s)^data:([^,]*),", 1)
    body = F.regexp_extract(c, r"(?s)^data:[^,]*,(.*)$", 1)
    parts = F.transform(F.split(head, ";"), lambda x: F.trim(x))
    mime = F.lower(parts[0])
    rest = F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: x.contains("="))
    based = F.exists(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: F.lower(x) == "base64")
    params = F.map_from_entries(F.array_distinct(F.transform(rest, lambda x: F.struct(F.lower(F.substring_index(x, "=", 1)).alias("k"), F.regexp_replace(x, "^[^=]*=", "").alias("v")))))
    data = F.when(based, F.try_to_binary(F.regexp_replace(body, r"\s", ""), F.lit("base64"))).otherwise(F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))).cast("binary"))
    return F.when(c.rlike(r"(?s)^data:[^,]*,"), F.struct(F.when(mime == "", "text/plain").otherwise(mime).alias("mime"), params.alias("params"), based.alias("base64"), data.alias("data")))


def url_hash(c: Column) -> Column:
    return F.when(c != "", F.md5(c))


def content_type(c: Column) -> Column:
    return F.trim(F.split(F.lower(c), ";")[0])


def content_range(c: Column) -> Column:
    """first, last and total of `bytes a-b/total`; null unless a <= b < total. An unknown total (`*`) is null inside."""
    at = lambda k: F.regexp_extract(F.trim(c), r"^(?i)bytes\s+(\d+)-(\d+)/(\d+|\*)$", k)
    first, last, total = at(1).try_cast("bigint"), at(2).try_cast("bigint"), at(3).try_cast("bigint")
    ok = (first <= last) & (total.isNull() | (last < total))
    return F.when(first.isNotNull() & ok, F.struct(first.alias("first"), last.alias("last"), total.alias("total")))
