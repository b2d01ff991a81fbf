"""Filters, semi and anti joins, lookups and state-table reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import cid_parts, cid_valid


def drop_blacklisted(rows: DataFrame, blacklist: DataFrame, cid: str = "token_cid") -> DataFrame:
    """FLT1: rows whose contract isn't listed (chain, contract); an invalid token id counts as listed."""
    valid = rows.where(cid_valid(F.col(cid)))
    parts = cid_parts(F.col(cid))
    listed = blacklist.select(F.col("chain").alias("__chain"), F.lower("contract").alias("__contract"))
    return valid.join(listed, (parts["chain"] == F.col("__chain")) & (F.lower(parts["contract"]) == F.col("__contract")), "left_anti")


def interest_filter(events: DataFrame, tokens: DataFrame, watched: DataFrame) -> DataFrame:
    """FLT2: events of known tokens, and ownership events from or to an address watched on that chain."""
    known = tokens.select("token_id").distinct().withColumn("__known", F.lit(True))
    addresses = watched.select("chain", "address").distinct()
    sender = addresses.select("chain", F.col("address").alias("from_address"), F.lit(True).alias("__from"))
    receiver = addresses.select("chain", F.col("address").alias("to_address"), F.lit(True).alias("__to"))
    met = events.join(known, "token_id", "left").join(sender, ["chain", "from_address"], "left").join(receiver, ["chain", "to_address"], "left")
    watched_too = (F.col("event_type") != "metadata_update") & (F.coalesce("__from", F.lit(False)) | F.coalesce("__to", F.lit(False)))
    return met.where(F.coalesce("__known", F.lit(False)) | watched_too).drop("__known", "__from", "__to").select(events.columns)


ROUTES = {"mint": "mint", "transfer": "transfer", "burn": "burn", "metadata_update": "metadata"}


def route(events: DataFrame) -> dict[str, DataFrame]:
    """FLT3: one frame for each handler; types without one (metadata ranges) are in none of them."""
    return {handler: events.where(F.col("event_type") == kind) for kind, handler in ROUTES.items()}


def visible(tokens: DataFrame, unviewable: bool = False, moderated: bool = False) -> DataFrame:
    """FLT4: viewable tokens without a moderation mark, each condition to be switched off."""
    out = tokens if unviewable else tokens.where("is_viewable")
    return out if moderated else out.where("moderation_status = 'none'")


def owned_by(tokens: DataFrame, balances: DataFrame, owners: list[str]) -> DataFrame:
    return tokens.join(balances.where(F.col("owner_address").isin(owners)).select("token_id"), "token_id", "left_semi")


def token_filter(tokens: DataFrame, **lists: list) -> DataFrame:
    """FLT6: AND of in-lists by column name; an empty or missing list doesn't filter."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]).isin(kv[1])) if kv[1] else df, lists.items(), tokens)


def release_filter(tokens: DataFrame, members: DataFrame, release_id: int | None = None, vendor: str | None = None, slug: str | None = None, mint_numbers: list[int] | None = None) -> DataFrame:
    """FLT7: tokens of a release, named by its id or by vendor and slug, with mint numbers only beside a release."""
    if mint_numbers and release_id is None and slug is None:
        raise ValueError("mint numbers need a release")
    if slug is not None and vendor is None:
        raise ValueError("a slug needs its vendor")
    some = members
    for name, value in (("release_id", release_id), ("vendor", vendor), ("slug", slug)):
        some = some.where(F.col(name) == value) if value is not None else some
    some = some.where(F.col("mint_number").isin(mint_numbers)) if mint_numbers else some
    return tokens.join(some.select("token_id", "release_id", "mint_number"), "token_id")


def match_clients(events: DataFrame, clients: DataFrame) -> DataFrame:
    """FLT8: one row per event and active client whose filters hold the event's type or `*`."""
    all_ = F.array_contains("filters", "*")
    wanted = F.when(all_, F.array(F.lit("*"))).otherwise(F.array_distinct("filters"))
    each = clients.where("is_active").select("client_id", F.explode(wanted).alias("__key")).distinct()
    # an event asks by its type and by *, and a client is under one of the two; works on streams too
    return events.withColumn("__key", F.explode(F.array(F.col("event_type"), F.lit("*")))).join(each, "__key").select(*events.columns, "client_id")


# What unsigned tokens of one vendor carry for a name, in their description and in their animation's address.
UNSIGNED_NAME, UNSIGNED_TEXT, UNSIGNED_CID = "[waiting to be signed]", "waiting to be signed by fxhash signer", "QmdGV3UqJqX4v5x9nFcDYeekCEAm3SDXUG5SHdjKQKn4Pe"


def placeholder_rows(metadata: DataFrame, standard: str = "fa2") -> DataFrame:
    """FLT9: metadata of this standard's tokens that still holds the placeholder of an unsigned token."""
    signs = (F.lower(F.trim("name")) == UNSIGNED_NAME, F.lower("description").contains(UNSIGNED_TEXT), F.col("animation_url").contains(UNSIGNED_CID))
    return metadata.where((F.col("standard") == standard) & reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in signs)))


def reprocess_candidates(overlays: DataFrame, members: DataFrame, vendors: list[str]) -> DataFrame:
    """FLT10: tokens with an overlay of these vendors, and the first member by mint, then by token, of releases without a slug."""
    first = members.where("slug is null").groupBy("release_id").agg(F.min_by("token_id", F.struct("mint_number", "token_id")).alias("token_id"))
    return overlays.where(F.col("vendor").isin(vendors)).select("token_id").unionByName(first.select("token_id")).distinct()


def publisher_lookup(tokens: DataFrame, collections: DataFrame, deployers: DataFrame) -> DataFrame:
    """JN1: publisher by collection, else by deployer, case-insensitive. Both registries are small and broadcast by size."""
    by_collection = collections.select(F.lower("key").alias("__c"), F.col("publisher").alias("__pc"))
    by_deployer = deployers.select(F.lower("key").alias("__d"), F.col("publisher").alias("__pd"))
    met = tokens.join(by_collection, F.lower("contract") == F.col("__c"), "left").join(by_deployer, F.lower("deployer") == F.col("__d"), "left")
    return met.select(*tokens.columns, F.coalesce("__pc", "__pd").alias("publisher"))


def deployer_attach(tokens: DataFrame, deployers: DataFrame) -> DataFrame:
    """JN2: the contract's deployer; a blank one is unknown."""
    known = deployers.select("contract", F.when(F.trim("deployer") != "", F.col("deployer")).alias("deployer"))
    return tokens.join(known, "contract", "left")


def release_membership(tokens: DataFrame, members: DataFrame) -> DataFrame:
    return tokens.join(members.select("token_id", "release_id", "mint_number"), "token_id", "left")


def media_assets_of(rows: DataFrame, assets: DataFrame, urls: list[str]) -> DataFrame:
    """JN4: distinct assets of each token's URLs, by the URL's hash."""
    each = rows.select("token_id", F.explode(F.array(*urls)).alias("url")).where("url <> ''").select("token_id", F.md5("url").alias("url_hash")).distinct()
    return each.join(assets, "url_hash")


def tokens_by_url(health: DataFrame, urls: DataFrame) -> DataFrame:
    return health.join(urls.select("url_hash").distinct(), "url_hash", "left_semi").select("url_hash", "token_id").distinct()


def without_gated(health: DataFrame, probes: DataFrame) -> DataFrame:
    return health.join(probes.where("health_gated").select("url_hash"), "url_hash", "left_anti")


def near_known(hashes: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """(id, hash, and known's columns) of the pairs of a hash and a known fingerprint (bits) that differ in `most` bits at most.

    Two hashes that differ in at most `most` bits agree in one of most + 1 bands of their 64 bits, so bands are joined
    by equality and candidates checked bit by bit; no pair is missed and nothing is crossed.
    """
    n = most + 1
    cut = [64 * k // n for k in range(n + 1)]

    def bands(c: Column) -> Column:
        return F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(c, cut[k]).bitwiseAND(F.lit((1 << (cut[k + 1] - cut[k])) - 1 if cut[k + 1] - cut[k] < 64 else -1)).alias("part")) for k in range(n))))

    left = hashes.select("id", "hash", bands(F.col("hash")).alias("b"))
    right = known.select("*", bands(F.col("bits")).alias("b"))
    return left.join(right, "b").where(F.bit_count(F.col("hash").bitwiseXOR(F.col("bits"))) <= most).drop("b")


def hash_neighbours(hashes: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """JN7: the first known fingerprint, in list order, within `most` bits of each hash."""
    return near_known(hashes, known.select("position", "bits"), most).groupBy("id").agg(F.min("position").alias("position"))


def due_items(verdicts: DataFrame, tokens: DataFrame, source: str, now: Column) -> DataFrame:
    """JN8: verdicts of a source whose next check has come, with the token's identity."""
    due = verdicts.where((F.col("source") == source) & (F.col("next_check_at") <= now))
    return due.join(tokens.select("token_id", "chain", "contract", "number"), "token_id")


def cids_from_listing(requests: DataFrame, listing: DataFrame) -> DataFrame:
    """JN9: token ids of (release_id, mint) requests, looked up in a listing of members (release_id, mint_number, cid); a
    request without a member has none."""
    known = listing.select("release_id", F.col("mint_number").alias("mint"), "cid").dropDuplicates(["release_id", "mint", "cid"])
    return requests.join(known, ["release_id", "mint"], "left")


def cids_from_release(requests: DataFrame, prefix: Column, project_base: bool = True) -> DataFrame:
    """JN9: token ids of (project, mint) requests: project * 10^6 + mint - 1, or the mint number itself."""
    number = F.col("project") * 1_000_000 + F.col("mint") - 1 if project_base else F.col("mint")
    return requests.withColumn("cid", F.concat(prefix, number.cast("string")))
