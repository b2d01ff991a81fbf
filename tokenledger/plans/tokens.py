"""Top-level reads: collection queries as one plan each."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import WIDE
from ..operators.holdings import first_per_key
from ..operators.metadata import MERGED, healthy_picks, healthy_url, merged_fields
from ..operators.selection import owned_by, release_filter, token_filter, visible

SORTS = ("created_at", "latest_provenance", "mint_number")


@dataclass
class TokenQuery:
    """A collection query; limit + 1 rows come back, so that a caller sees whether there are more."""

    owners: list[str] = field(default_factory=list)
    token_ids: list[int] = field(default_factory=list)
    chains: list[str] = field(default_factory=list)
    contracts: list[str] = field(default_factory=list)
    numbers: list[str] = field(default_factory=list)
    release_id: int | None = None
    vendor: str | None = None
    slug: str | None = None
    mint_numbers: list[int] = field(default_factory=list)
    with_release: bool = False
    unviewable: bool = False
    moderated: bool = False
    sort_by: str = "created_at"
    descending: bool = True
    limit: int = 20
    offset: int = 0

    def __post_init__(self) -> None:
        if self.sort_by not in SORTS:
            raise ValueError(f"sort_by is one of {SORTS}")
        if self.limit < 1 or self.offset < 0:
            raise ValueError("limit is 1 or more, offset 0 or more")
        if self.sort_by == "mint_number" and self.release_id is None and self.slug is None:
            raise ValueError("mint order needs a release")


def query_tokens(q: TokenQuery, tokens: DataFrame, balances: DataFrame | None = None, members: DataFrame | None = None, ownership: DataFrame | None = None) -> DataFrame:
    """QRY1: filters, then the sort with a tie-break by id, then a page. Joins are in the plan only where the query needs them."""
    out = visible(tokens, q.unviewable, q.moderated)
    out = token_filter(out, token_id=q.token_ids, chain=q.chains, contract=q.contracts, number=q.numbers)
    if q.owners:
        out = owned_by(out, balances, q.owners)
    if q.release_id is not None or q.slug is not None or q.with_release:
        out = release_filter(out, members, q.release_id, q.vendor, q.slug, q.mint_numbers)
    key = q.sort_by
    if key == "latest_provenance":
        # a token without a row of these owners stays, and comes last
        rows = ownership.where(F.col("owner_address").isin(q.owners)) if q.owners else ownership
        last = first_per_key(rows, ["token_id"], [F.desc("last_timestamp"), F.desc("last_tx_index"), F.desc("id")]).select("token_id", "last_timestamp")
        out, key = out.join(last, "token_id", "left"), "last_timestamp"
    first = F.desc_nulls_last(key) if q.descending else F.asc_nulls_last(key)
    return out.orderBy(first, F.desc("token_id") if q.descending else F.asc("token_id")).offset(q.offset).limit(q.limit + 1)


LISTS = {  # kind: its table, what it is ordered by (time and numbers falling, then text), its fields
    "owners": ("balances", {"amount": "quantity", "text": "owner_address"}, ["owner_address", "quantity"]),
    "provenance_events": ("events", {"at": "ts", "first": "event_id"}, ["event_id", "event_type", "ts"]),
    "owner_provenances": ("ownership", {"at": "last_timestamp", "first": "last_tx_index", "second": "id"}, ["owner_address", "last_timestamp", "last_tx_index"]),
}
KINDS = (*LISTS, "metadata", "enrichment_source", "display", "media_asset")
URLS = ["image_url", "animation_url"]


def page_ids(tokens: DataFrame, most: int = 1000) -> list[int] | None:
    """The ids of a page, which reads are then cut to; None if there are more than `most`."""
    rows = tokens.select("token_id").limit(most + 1).collect()
    return None if len(rows) > most else [r[0] for r in rows]


def expand(tokens: DataFrame, kinds: list[str] | tuple[str, ...], tables: dict[str, DataFrame], n: int, owners: list[str] | None = None, ids: list[int] | None = None) -> DataFrame:
    """QRY2, QRY3: tokens with a column for each kind asked for.

    owners, provenance_events and owner_provenances are the first n (most held, newest, newest) with their number as
    <kind>_total; with owners, owner_provenances has all rows of these and no others. metadata and enrichment_source are the token's rows. display is the
    enrichment's fields before the metadata's, with the healthy URLs, data URIs swapped for their public variant.
    media_asset has the assets of the URLs in metadata, enrichment_source and display, as far as these are asked for.

    tables: balances, events, ownership, metadata, enrichment (a row a token), health, assets (source_url_hash,
    variant_urls), as the kinds need them. ids are the tokens' (`page_ids`), where these are few.

    Tokens and all tables are one union of rows with a column for each kind, grouped once by token. Of the lists, n rows a token
    and task at most are sent to be ranked; their numbers are counted before the shuffle. URLs meet the assets by hash before
    that, all that display could show included; which of them it shows is known after the grouping.
    """
    if unknown := set(kinds) - set(KINDS):
        raise ValueError(f"{sorted(unknown)} aren't of {KINDS}")
    sources = [k for k in ("metadata", "enrichment_source", "display") if k in kinds]
    if "media_asset" in kinds and not (sources and "assets" in tables):
        raise ValueError("media_asset needs assets, and metadata, enrichment_source or display")
    own = lambda name: tables[name] if ids is None else tables[name].where(F.col("token_id").isin(ids))
    lists = [k for k in LISTS if k in kinds]
    single = {k: own(t) for k, t in (("metadata", "metadata"), ("enrichment_source", "enrichment")) if k in kinds or "display" in kinds}
    rows, made = [tokens.select("token_id", F.struct(*tokens.columns).alias("token"))], ["first(token, true) AS token"]
    if lists:
        found = {k: own(LISTS[k][0]) for k in lists}
        some = {k: len(owners) if owners and k == "owner_provenances" else n for k in lists}
        if owners and "owner_provenances" in found:
            found["owner_provenances"] = found["owner_provenances"].where(F.col("owner_address").isin(owners))
        rows.append(_ranked(found, some))
        ones = (found[k].selectExpr("token_id", *(f"CAST({'1' if x == k else 'NULL'} AS bigint) AS {x}_total" for x in lists)) for k in lists)
        rows.append(reduce(DataFrame.union, ones).groupBy("token_id").agg(*(F.expr(f"sum({k}_total) AS {k}_total") for k in lists)))
        for kind in lists:
            fields = LISTS[kind][2]
            listed = f"sort_array(collect_list(CASE WHEN kind = '{kind}' THEN struct(rank, {', '.join(f'{kind}.{f} AS {f}' for f in fields)}) END))"
            made += [f"CASE WHEN count_if(kind = '{kind}') > 0 THEN transform({listed}, x -> struct({', '.join(f'x.{f} AS {f}' for f in fields)})) END AS {kind}", f"max({kind}_total) AS {kind}_total"]
    none = "NULL"
    for kind, df in single.items():
        columns = set(df.columns)
        rows.append(df.selectExpr("token_id", f"struct({', '.join(f'CAST({f if f in columns else none} AS string) AS {f}' for f in MERGED)}) AS {kind}"))
        made.append(f"first({kind}, true) AS {kind}")
    health = own("health") if "display" in kinds else None
    if health is not None:
        rows.append(health.select("token_id", "media_source", "health_status", "media_url"))
    if "assets" in tables and {"display", "media_asset"} & set(kinds):
        urls = [df.selectExpr("token_id", f"explode(array({', '.join(URLS)})) AS url") for df in single.values()]
        urls += [health.where("health_status = 'healthy'").selectExpr("token_id", "media_url AS url")] if health is not None else []
        asked = reduce(DataFrame.union, urls).where("url <> ''").selectExpr("token_id", "md5(url) AS source_url_hash")
        rows.append(asked.join(tables["assets"], "source_url_hash").selectExpr("token_id", "struct(source_url_hash AS hash, try_element_at(variant_urls, 'public') AS public) AS asset"))
        made.append("collect_set(asset) AS __assets")
    out = _union(rows).groupBy("token_id").agg(*map(F.expr, made), *(healthy_picks() if health is not None else ())).where("token is not null")
    if "display" in kinds:
        part = lambda kind: {f: F.col(f"{kind}.{f}") for f in MERGED}
        fields = merged_fields(part("enrichment_source"), part("metadata"))
        fields |= {f"{k}_url": healthy_url(k, fields[f"{k}_url"]) for k in ("image", "animation")}
        out = out.withColumn("display", F.when(F.col("metadata").isNotNull(), F.struct(*(c.alias(f) for f, c in fields.items()))))
    result = [f"token.{c} AS {c}" for c in tokens.columns] + [x for k in lists for x in (k, f"{k}_total")]
    for kind in sources:
        if kind == "display" and "assets" in tables:
            public = lambda u: f"array_max(transform(filter(__assets, x -> x.hash = md5({u})), x -> x.public))"
            swapped = lambda u: f"CASE WHEN startswith({u}, 'data:') THEN coalesce({public(u)}, {u}) ELSE {u} END"
            result.append(f"CASE WHEN display IS NOT NULL THEN struct({', '.join(f'{swapped(f"display.{f}") if f in URLS else f"display.{f}"} AS {f}' for f in MERGED)}) END AS display")
        else:
            result.append(kind)
    if "media_asset" in kinds:
        hashes = f"transform(filter(array({', '.join(f'{k}.{u}' for k in sources for u in URLS)}), u -> u <> ''), u -> md5(u))"
        shown = f"array_sort(array_intersect(transform(__assets, x -> x.hash), {hashes}))"
        result.append(f"CASE WHEN size({shown}) > 0 THEN {shown} END AS media_asset")
    return out.selectExpr(*result)


def _ranked(found: dict[str, DataFrame], most: dict[str, int]) -> DataFrame:
    """The first rows of each token and list, up to the list's number, with their rank; a column of fields for each list."""
    kinds = {k: dict(df.dtypes) for k, df in found.items()}
    types = {k: f"struct<{', '.join(f'{f}: {kinds[k][f]}' for f in LISTS[k][2])}>" for k in found}
    each = []
    for kind, df in found.items():
        order = dict(LISTS[kind][1])
        if "amount" in order and kinds[kind][order["amount"]] == "string":
            order["digits"] = f"lpad({order.pop('amount')}, {WIDE}, '0')"  # orders numbers of up to 256 bits by size
        key = [f"CAST({order.get(k, 'NULL')} AS {t}) AS {k}" for k, t in _ORDER.items()]
        own = [f"{f'struct({", ".join(LISTS[k][2])})' if k == kind else f'CAST(NULL AS {types[k]})'} AS {k}" for k in found]
        each.append(df.selectExpr("token_id", f"'{kind}' AS kind", f"{most[kind]} AS most", *key, *own))
    w = Window.partitionBy("token_id", "kind").orderBy(*(F.desc(k) for k in _ORDER if k != "text"), F.asc("text"))
    first = reduce(DataFrame.union, each).withColumn("rank", F.row_number().over(w))
    return first.where((F.col("rank") <= max(most.values())) & (F.col("rank") <= F.col("most"))).select("token_id", "kind", "rank", *found)


_ORDER = {"at": "timestamp_ntz", "digits": "string", "amount": "bigint", "first": "bigint", "second": "bigint", "text": "string"}


def _union(rows: list[DataFrame]) -> DataFrame:
    """One table of rows that each have some of its columns, the others null."""
    schemas = [df.schema for df in rows]
    kinds = {f.name: f.dataType.simpleString() for schema in schemas for f in schema}
    whole = lambda schema: [f"`{k}`" if k in schema.names else f"CAST(NULL AS {t}) AS `{k}`" for k, t in kinds.items()]
    return reduce(DataFrame.union, (df.selectExpr(*whole(schema)) for df, schema in zip(rows, schemas, strict=True)))


def provenance(events: DataFrame, token_id: int, limit: int, offset: int, descending: bool) -> DataFrame:
    """QRY7: a page of one token's events with their total number."""
    own = events.where(F.col("token_id") == token_id)
    total = own.agg(F.count("*").alias("total"))
    by = [(F.desc_nulls_first if descending else F.asc_nulls_last)(c) for c in ("ts", "tx_index", "event_id")]
    return own.orderBy(*by).offset(offset).limit(limit).join(F.broadcast(total))  # bound: one row


def next_range(watched: DataFrame, head: int, start: int) -> DataFrame:
    """QRY12: what to scan next of each address: everything, then the older gap, then the newer one, else nothing."""
    kind = F.when(F.col("min_block").isNull(), "full").when(F.col("min_block") > start, "older").when(F.col("max_block") < head, "newer").otherwise("none")
    lo = F.when(kind.isin("full", "older"), F.lit(start)).when(kind == "newer", F.col("max_block") + 1)
    hi = F.when(kind.isin("full", "newer"), F.lit(head)).when(kind == "older", F.col("min_block") - 1)
    return watched.withColumn("kind", kind).withColumn("lo", lo.cast("long")).withColumn("hi", hi.cast("long"))


def quota(watched: DataFrame, now: str) -> DataFrame:
    """QRY13: what is left of each address's daily quota; a reset time that has passed gives it back for 24 hours."""
    at = F.expr(f"TIMESTAMP_NTZ'{now}'")
    due = F.col("quota_reset_at").isNull() | (F.col("quota_reset_at") <= at)
    left = F.greatest(F.col("quota") - F.when(due, F.lit(0)).otherwise(F.col("used")), F.lit(0)).cast("long")
    return watched.withColumn("remaining", left).withColumn("resets_at", F.when(due, at + F.expr("INTERVAL '1' DAY")).otherwise(F.col("quota_reset_at")))
