"""Token metadata and vendor overlays: JSON to columns, upserts with change rows, and display views.

Normalised metadata has token_id, name, description, image_url, animation_url and artists (array of did and name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import did_pkh, is_evm, is_tezos_address
from ..functions.uris import to_gateway
from ..functions.values import changed_fields, mint_number, project_mint, spam_status

# Trait types that name an artist, and the longer list that vendor traits use.
ARTIST_TRAITS = ["artist", "Artist", "Creator", "creator", "Artists", "artists"]
VENDOR_ARTIST_TRAITS = ["artist", "artists", "creator", "artist name", "creator name", "made by", "created by"]
ARTISTS = "array<struct<did:string,name:string>>"
SERIES_PUBLISHER, SERIES_VENDOR = "Feral File", "feralfile"  # fixed values: a publisher in registries, and the vendor of its rows


def _text(raw: Column, path: str) -> Column:
    return F.get_json_object(raw, f"$.{path}")


def _filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def artist_name(raw: Column) -> Column:
    """MD3: artist; a trait that names one; what follows " by " in collection_name; createdBy, created_by, creator; else empty."""
    traits = F.from_json(F.coalesce(_text(raw, "attributes"), F.lit("[]")), "array<struct<trait_type:string,value:string>>")
    named = F.try_element_at(F.filter(traits, lambda t: t["trait_type"].isin(ARTIST_TRAITS) & t["value"].isNotNull()), F.lit(1))["value"]
    after_by = F.try_element_at(F.split(_text(raw, "collection_name"), " by "), F.lit(2))
    return F.coalesce(_text(raw, "artist"), named, after_by, _text(raw, "createdBy"), _text(raw, "created_by"), _text(raw, "creator"), F.lit(""))


def normalise_tzip21(rows: DataFrame) -> DataFrame:
    """MD1: (token_id, chain, raw) of Tezos metadata. Each creator is an artist; the name is the artist's if one is found, else the address."""
    raw = F.col("raw")
    creators = F.coalesce(F.from_json(_text(raw, "creators"), "array<string>"), F.array().cast("array<string>"))
    name = artist_name(raw)
    artists = F.transform(creators, lambda c: F.struct(did_pkh(c, F.col("chain")).alias("did"), F.when(name != "", name).otherwise(c).alias("name")))
    return rows.select("token_id", _text(raw, "name").alias("name"), _text(raw, "description").alias("description"), to_gateway(_text(raw, "displayUri")).alias("image_url"), to_gateway(_text(raw, "artifactUri")).alias("animation_url"), artists.alias("artists"))


def normalise_opensea(rows: DataFrame) -> DataFrame:
    """MD2: (token_id, raw) in the usual EVM form; at most one artist, without an identity."""
    raw = F.col("raw")
    name = artist_name(raw)
    one = F.array(F.struct(F.lit(None).cast("string").alias("did"), name.alias("name")))
    return rows.select("token_id", _text(raw, "name").alias("name"), _text(raw, "description").alias("description"), to_gateway(_text(raw, "image")).alias("image_url"), to_gateway(_text(raw, "animation_url")).alias("animation_url"), F.when(name != "", one).otherwise(F.array().cast(ARTISTS)).alias("artists"))


def uri_template(uri: Column, number: Column) -> Column:
    return F.replace(uri, F.lit("{id}"), number)


def vendor_route(publisher: Column, chain: Column) -> Column:
    """MD5: the vendor whose overlay applies; null for none."""
    main = F.when(chain == "tezos:mainnet", "objkt").when(chain == "eip155:1", "opensea")
    return (
        F.when(publisher == "Art Blocks", F.when(is_evm(chain), "artblocks"))
        .when(publisher == SERIES_PUBLISHER, F.when(chain.isin("eip155:1", "tezos:mainnet"), SERIES_VENDOR))
        .when(publisher == "fxhash", F.when(chain == "tezos:mainnet", "fxhash"))
        .otherwise(main)
    )


def _overlay(rows: DataFrame, vendor: str, **fields: Column) -> DataFrame:
    kinds = {"mint_number": "bigint", "total_mints": "bigint", "artists": ARTISTS}
    names = ["name", "description", "image_url", "animation_url", "mime_type", "artists", "release_id", "release_slug", "release_name", "mint_number", "total_mints", "moderation_status"]
    return rows.select("token_id", F.lit(vendor).alias("vendor"), *(fields.get(n, F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in names))


def _artist(did: Column, name: Column) -> Column:
    return F.array(F.struct(did.alias("did"), name.alias("name")))


def overlay_artblocks(rows: DataFrame, per_project: int = 1_000_000) -> DataFrame:
    """MD6 for (token_id, chain, contract, number, raw, vendor_json): name and release from the project and the mint's place."""
    v, p = F.col("vendor_json"), project_mint(F.col("number"), per_project)
    title, address = _text(v, "name"), _text(v, "artist_address")
    release = F.concat_ws("-", F.regexp_extract("chain", "([0-9]+)$", 1), F.lower("contract"), p["project"].cast("string"))
    total = _text(v, "max_invocations").try_cast("bigint")
    return _overlay(rows, "artblocks", name=F.concat(title, F.lit(" #"), p["index"].cast("string")), description=_filled(_text(v, "description")), artists=F.when(address != "", _artist(did_pkh(address, F.col("chain")), _text(v, "artist_name"))), animation_url=_text(F.col("raw"), "generator_url"), image_url=_text(F.col("raw"), "image"), release_id=release, mint_number=p["index"] + 1, release_name=_filled(F.trim(title)), total_mints=F.when(total > 0, total), release_slug=_filled(F.trim(_text(v, "slug"))))


def overlay_series(rows: DataFrame, base_url: str) -> DataFrame:
    """MD6 for works in series: previews are the image of image works, else the animation beside a thumbnail; no release without an index."""
    v = F.col("vendor_json")
    url = lambda path: F.when(_filled(_text(v, path)).isNotNull(), F.concat(F.lit(base_url), _text(v, path)))
    still = F.lower(F.coalesce(_text(v, "series.medium"), F.lit(""))) == "image"
    key = F.when(F.col("chain") == "eip155:1", _text(v, "series.artist.addresses.ethereum")).when(F.col("chain") == "tezos:mainnet", _text(v, "series.artist.addresses.tezos"))
    index, total = _text(v, "index").try_cast("bigint"), _text(v, "series.max_artwork").try_cast("bigint")
    member = index.isNotNull() & (_filled(_text(v, "series.id")).isNotNull())
    return _overlay(rows, SERIES_VENDOR, name=_text(v, "name"), description=_filled(_text(v, "series.description")), image_url=F.when(still, url("preview")).otherwise(url("thumbnail")), animation_url=F.when(~still, url("preview")), artists=F.when(key != "", _artist(did_pkh(key, F.col("chain")), _text(v, "series.artist.alias"))), release_id=F.when(member, _text(v, "series.id")), mint_number=F.when(member, index + 1), release_name=F.when(member, _filled(F.trim(_text(v, "series.title")))), total_mints=F.when(member & (total > 0), total), release_slug=F.when(member, _filled(F.trim(_text(v, "series.slug")))))


def overlay_fxhash(rows: DataFrame) -> DataFrame:
    """MD6: rows without vendor JSON are left to objkt. A supply that isn't positive is unknown."""
    known, v = rows.where("vendor_json is not null"), F.col("vendor_json")
    wallet, iteration = _text(v, "token.author.wallet"), _text(v, "iteration").try_cast("bigint")
    total = F.coalesce(_text(v, "token.original_supply"), _text(v, "token.supply")).try_cast("bigint")
    member = iteration > 0
    return _overlay(known, "fxhash", name=_text(v, "name"), image_url=to_gateway(_filled(_text(v, "display_uri"))), artists=F.when(wallet != "", _artist(did_pkh(wallet, F.lit("tezos:mainnet")), _text(v, "token.author.name"))), release_id=F.when(member, _text(v, "token.id")), mint_number=F.when(member, iteration), release_name=F.when(member, _text(v, "token.name")), total_mints=F.when(member & (total > 0), total), release_slug=F.when(member, _filled(F.trim(_text(v, "token.slug")))))


def overlay_objkt(rows: DataFrame) -> DataFrame:
    """MD6: creators at Tezos addresses only; a release where the collection is the artist's own."""
    v = F.col("vendor_json")
    creators = F.coalesce(F.from_json(_text(v, "creators"), "array<struct<address:string,alias:string>>"), F.array().cast("array<struct<address:string,alias:string>>"))
    artists = F.transform(F.filter(creators, lambda c: is_tezos_address(c["address"])), lambda c: F.struct(did_pkh(c["address"], F.lit("tezos:mainnet")).alias("did"), F.coalesce(c["alias"], F.lit("")).alias("name")))
    number, total = F.col("number").try_cast("bigint"), _text(v, "fa.editions").try_cast("bigint")
    member = (_text(v, "fa.collection_type") == "custom") & (number > 0)
    return _overlay(rows, "objkt", name=_text(v, "name"), description=_text(v, "description"), image_url=to_gateway(_filled(_text(v, "display_uri"))), animation_url=to_gateway(_filled(_text(v, "artifact_uri"))), mime_type=_filled(_text(v, "mime")), artists=F.when(F.size(artists) > 0, artists), release_id=F.when(member, F.col("contract")), release_slug=F.when(member, F.col("contract")), release_name=F.when(member, _text(v, "fa.name")), mint_number=F.when(member, number), total_mints=F.when(member & (total > 0), total), moderation_status=spam_status(F.lit(None).cast("boolean"), _text(v, "flag")))


def artist_from_traits(traits: Column) -> Column:
    """AGG18: distinct artist names of traits in their order, joined; null if there are none."""
    named = F.filter(traits, lambda t: F.lower(F.trim(t["trait_type"])).isin(VENDOR_ARTIST_TRAITS) & (F.trim(t["value"]) != ""))
    return _filled(F.array_join(F.array_distinct(F.transform(named, lambda t: F.trim(t["value"]))), ", "))


def overlay_opensea(rows: DataFrame) -> DataFrame:
    """MD6: images asked at a width; the mint number from the name or the identifier; the artist from traits."""
    v = F.col("vendor_json")
    image, slug = _filled(_text(v, "image_url")), _filled(_text(v, "collection"))
    sized = F.concat(image, F.when(F.contains(image, F.lit("?")), "&w=1000").otherwise("?w=1000"))
    mint = mint_number(F.coalesce(_text(v, "name"), F.lit("")), _text(v, "identifier"))
    member = slug.isNotNull() & (mint > 0)
    artist = artist_from_traits(F.from_json(F.coalesce(_text(v, "traits"), F.lit("[]")), "array<struct<trait_type:string,value:string>>"))
    return _overlay(rows, "opensea", name=_filled(_text(v, "name")), description=_filled(_text(v, "description")), image_url=sized, animation_url=_filled(_text(v, "display_animation_url")), artists=F.when(artist.isNotNull(), _artist(F.lit(None).cast("string"), artist)), release_id=F.when(member, slug), release_slug=F.when(member, slug), mint_number=F.when(member, mint), moderation_status=spam_status(_text(v, "is_disabled").try_cast("boolean"), F.lit(None).cast("string")))


def canonical_json(raw: Column) -> Column:
    """JSON with sorted keys at every depth and no spaces, numbers by value; null for what isn't JSON, or names a key twice in
    one object. Objects of a variant hold their keys in order."""
    return F.to_json(F.try_parse_json(raw))


def json_hash(raw: Column) -> Column:
    """MD7: equal for JSON texts that differ in key order and spacing only."""
    return F.sha2(canonical_json(raw), 256)


def upsert_feed(old: DataFrame, new: DataFrame, fields: list[str], kind: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """MD8, MD9: (rows after the upsert by token, one change row with the fields that differ for each token where any do)."""
    both = new.alias("new").join(old.alias("old"), F.col("new.token_id") == F.col("old.token_id"), "left")
    changed = both.select("new.token_id", changed_fields("old", "new", fields, F.col("old.token_id").isNotNull()).alias("changed"))
    feed = changed.where(F.size("changed") > 0).select("token_id", F.lit(kind).alias("event_type"), at.alias("occurred_at"), "changed")
    return old.join(new.select("token_id"), "token_id", "left_anti").select("token_id", *fields).unionByName(new.select("token_id", *fields)), feed


def release_upsert(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """MD10: values that aren't blank replace, blank ones keep the old."""
    n = new.select("vendor", "vendor_release_id", *(F.col(f).alias(f"__{f}") for f in fields))
    met = old.join(n, ["vendor", "vendor_release_id"], "full")
    return met.select("vendor", "vendor_release_id", *(F.coalesce(F.when(F.trim(F.col(f"__{f}").cast("string")) != "", F.col(f"__{f}")), F.col(f)).alias(f) for f in fields))


def member_upsert(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """MD11: (members, rejects). A token is in one release; rejected are mints below 1 and slots that two tokens would share."""
    from pyspark.sql import Window

    kept = old.join(new.select("token_id"), "token_id", "left_anti").select("release_id", "token_id", "mint_number", F.lit(0).alias("fresh"))
    both = kept.unionByName(new.select("release_id", "token_id", "mint_number", F.lit(1).alias("fresh")))
    w = Window.partitionBy("release_id", "mint_number").orderBy("fresh", "token_id")
    ranked = both.withColumn("k", F.row_number().over(w))
    bad = (F.col("mint_number") < 1) | (F.col("k") > 1)
    return ranked.where(~bad).select("release_id", "token_id", "mint_number"), ranked.where(bad).select("release_id", "token_id", "mint_number")


MERGED = ("name", "description", "image_url", "animation_url", "artist")


def merged_fields(overlay: dict[str, Column], metadata: dict[str, Column]) -> dict[str, Column]:
    """The overlay's fields before the metadata's; its artists only where there are any."""
    out = {c: F.coalesce(overlay[c], metadata[c]) for c in MERGED}
    return out | {"artist": F.when(overlay["artist"] != "", overlay["artist"]).otherwise(metadata["artist"])}


def display_merge(metadata: DataFrame, overlay: DataFrame) -> DataFrame:
    """MD12: metadata with the overlay's fields where it has them."""
    o = overlay.select("token_id", *(F.col(c).alias(f"__{c}") for c in MERGED))
    met = merged_fields({c: F.col(f"__{c}") for c in MERGED}, {c: F.col(c) for c in MERGED})
    return metadata.join(o, "token_id", "left").select("token_id", *(c.alias(k) for k, c in met.items()))


def healthy_picks() -> list[Column]:
    """Of a token's health rows, for image and animation each: the URL to show (the overlay's if healthy, else the metadata's
    if healthy, else null) and whether there are rows of that kind."""
    pick = lambda kind: F.coalesce(*(F.max(F.when((F.col("media_source") == f"{s}_{kind}") & (F.col("health_status") == "healthy"), F.col("media_url"))) for s in ("enrichment", "metadata"))).alias(f"__{kind}")
    has = lambda kind: F.bool_or(F.col("media_source").endswith(kind)).alias(f"__has_{kind}")
    return [pick("image"), pick("animation"), has("image"), has("animation")]


def healthy_url(kind: str, url: Column) -> Column:
    """The picked URL; untouched for tokens without rows of that kind."""
    return F.when(F.col(f"__has_{kind}"), F.col(f"__{kind}")).otherwise(url)


def display_healthy(display: DataFrame, health: DataFrame) -> DataFrame:
    """MD13: display's (token_id, image_url, animation_url) with healthy URLs."""
    met = display.join(health.groupBy("token_id").agg(*healthy_picks()), "token_id", "left")
    return met.select("token_id", *(healthy_url(k, F.col(f"{k}_url")).alias(f"{k}_url") for k in ("image", "animation")))


def upsert_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """MD14: new rows in place of old ones with their key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(old.columns))


def swap_data_uris(display: DataFrame, assets: DataFrame, columns: list[str]) -> DataFrame:
    """MD15: data URIs replaced by their asset's public variant where there is one."""
    out = display
    public = assets.select(F.col("source_url_hash").alias("__h"), F.try_element_at("variant_urls", F.lit("public")).alias("__p")).where("__p is not null")
    for c in columns:
        out = out.join(public, F.when(F.col(c).startswith("data:"), F.md5(c)) == F.col("__h"), "left").withColumn(c, F.coalesce("__p", c)).drop("__h", "__p")
    return out


def pick_variants(assets: DataFrame, keys: list[str]) -> DataFrame:
    return assets.withColumn("variant_urls", F.map_filter("variant_urls", lambda k, _: k.isin(keys)))
