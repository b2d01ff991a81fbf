"""Queries on functions, filters, joins and top-level reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import uris as U
from ..functions import values as V
from ..operators import holdings as H
from ..operators import selection as S
from ..sources.views import Views
from .registry import query

CID = "chain || ':' || standard || ':' || contract || ':' || number"


def with_cid(df):
    return df.withColumn("token_cid", I.cid(F.col("chain"), F.col("standard"), F.col("contract"), F.col("number")))


@query("FN1_cid_build_parse_normalise", "token_dim", f"SELECT token_id, {CID} AS cid, standard AS part, chain || ':' || standard || ':' || lower(contract) || ':' || number AS canonical FROM token_dim")
def fn1(v: Views):
    c = with_cid(v.token_dim)
    return c.select("token_id", F.col("token_cid").alias("cid"), I.cid_parts(F.col("token_cid"))["standard"].alias("part"), I.cid_normalise(F.col("token_cid")).alias("canonical"))


ODD = "CASE token_id % 6 WHEN 0 THEN chain || ':erc1155:' || contract || ':' || number WHEN 1 THEN chain || ':fa2:' || contract || ':' || number WHEN 2 THEN 'tezos:mainnet:fa2:KT1' || substr(replace(replace(contract, '0', '9'), 'l', 'k'), 1, 33) || ':' || number WHEN 3 THEN chain || ':erc721:' || substr(contract, 1, 30) || ':' || number WHEN 4 THEN chain || ':erc721:' || contract || ':x' || number ELSE " + CID + " END"


@query("FN2_cid_valid", "token_dim", f"""
SELECT token_id, regexp_matches(c, '^eip155:(1|11155111):(erc721|erc1155):0x[0-9a-fA-F]{{40}}:[0-9]+$') OR regexp_matches(c, '^tezos:(mainnet|ghostnet):fa2:KT1[1-9A-HJ-NP-Za-km-z]{{33}}:[0-9]+$') AS valid
FROM (SELECT token_id, {ODD} AS c FROM token_dim) x""")
def fn2(v: Views):
    return v.token_dim.select("token_id", I.cid_valid(F.expr(ODD)).alias("valid"))


@query("FN3_chain_predicates", "ledger token_dim", """
SELECT event_id, chain = 'eip155:1' AS evm, chain IN ('eip155:1', 'tezos:mainnet') AS valid, CASE WHEN chain LIKE 'eip155:%' THEN CAST(substr(chain, 8) AS BIGINT) END AS network, chain LIKE 'eip155:%' AS has_network
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'eip155:5' WHEN 1 THEN 'tezos:other' ELSE chain END AS chain FROM ledger) x""")
def fn3(v: Views):
    c = F.col("chain")
    return v.ledger.withColumn("chain", F.expr("CASE event_id % 5 WHEN 0 THEN 'eip155:5' WHEN 1 THEN 'tezos:other' ELSE chain END")).select("event_id", I.is_evm(c).alias("evm"), I.is_valid_chain(c).alias("valid"), I.eip155_id(c).alias("network"), I.eip155_id(c).isNotNull().alias("has_network"))


ADDRESS = "CASE token_id % 5 WHEN 0 THEN contract WHEN 1 THEN 'KT1' || substr(replace(replace(contract, '0', '9'), 'l', 'k'), 1, 33) WHEN 2 THEN 'tz2' || substr(replace(replace(contract, '0', '9'), 'l', 'k'), 1, 33) WHEN 3 THEN 'tz7' || substr(contract, 1, 33) ELSE substr(contract, 1, 30) END"


@query("FN4_address_tests", "token_dim", f"SELECT token_id, regexp_matches(c, '^0x[0-9a-fA-F]{{40}}$') AS eth, regexp_matches(c, '^(tz[1-4]|KT1)[1-9A-HJ-NP-Za-km-z]{{33}}$') AS tezos, CASE WHEN regexp_matches(c, '^0x[0-9a-fA-F]{{40}}$') THEN 'ethereum' WHEN regexp_matches(c, '^(tz[1-4]|KT1)[1-9A-HJ-NP-Za-km-z]{{33}}$') THEN 'tezos' END AS blockchain FROM (SELECT token_id, {ADDRESS} AS c FROM token_dim) x")
def fn4(v: Views):
    c = F.expr(ADDRESS)
    return v.token_dim.select("token_id", I.is_eth_address(c).alias("eth"), I.is_tezos_address(c).alias("tezos"), I.blockchain_of(c).alias("blockchain"))


NUM = "CASE token_id % 4 WHEN 0 THEN number WHEN 1 THEN ' ' || number || ' ' WHEN 2 THEN '000' ELSE '-' || number END"


@query("FN5_numeric_tests", "token_dim", f"SELECT token_id, regexp_matches(n, '^[0-9]+$') AS numeric_, regexp_matches(n, '^[0-9]+$') AND regexp_matches(n, '[1-9]') AS positive, CASE WHEN regexp_matches(trim(n), '^[0-9]+$') THEN CAST(trim(n) AS BIGINT) END AS value FROM (SELECT token_id, {NUM} AS n FROM token_dim) x")
def fn5(v: Views):
    n = F.expr(NUM)
    return v.token_dim.select("token_id", I.is_numeric(n).alias("numeric_"), I.is_positive_numeric(n).alias("positive"), I.unsigned_to_long(n).alias("value"))


@query("FN6_url_tests", "", "SELECT page_id, page_id % 4 IN (0, 1) AS url_, page_id % 4 IN (0, 1) AND starts_with(url, 'https://') AS https FROM pages")
def fn6(v: Views):
    c = F.expr("CASE page_id % 4 WHEN 2 THEN '/only/a/path' WHEN 3 THEN 'https:///' ELSE url END")
    return v.table("pages").select("page_id", U.is_url(c).alias("url_"), U.is_https_url(c).alias("https"))


REF = "'bafybe' || substr(md5(url) || md5(url), 1, 0) || repeat(substr('abcdefghij', CAST(page_id % 10 AS INT) + 1, 1), 53) || '/art?x=' || CAST(page_id AS STRING_)"


def uri(kind: str, dialect: str) -> str:
    ref = REF.replace("STRING_", "STRING" if dialect == "spark" else "VARCHAR")
    long = "substr(md5(url) || md5(url), 1, 43)" if kind == "ar" else "md5(url) || md5(url)"
    if kind == "ipfs":
        return f"CASE page_id % 3 WHEN 0 THEN 'ipfs://' || {ref} WHEN 1 THEN 'https://gw.example.org/ipfs/' || {ref} ELSE url END"
    host = "https://arweave.net/" if kind == "ar" else "https://onchfs.fxhash2.xyz/"
    return f"CASE page_id % 3 WHEN 0 THEN '{kind}://' || {long} WHEN 1 THEN '{host}' || {long} || '/i.html' ELSE url END"


@query("FN7_ipfs_gateway_ref", "", f"SELECT page_id, CASE WHEN page_id % 3 < 2 THEN {REF.replace('STRING_', 'VARCHAR')} END AS ref FROM pages")
def fn7(v: Views):
    return v.table("pages").select("page_id", U.ipfs_ref(F.expr(uri("ipfs", "spark"))).alias("ref"))


@query("FN8_arweave_onchfs_ref", "", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN substr(md5(url) || md5(url), 1, 43) WHEN 1 THEN substr(md5(url) || md5(url), 1, 43) || '/i.html' END AS arweave, CASE page_id % 3 WHEN 0 THEN md5(url) || md5(url) WHEN 1 THEN md5(url) || md5(url) || '/i.html' END AS onchfs FROM pages")
def fn8(v: Views):
    return v.table("pages").select("page_id", U.arweave_ref(F.expr(uri("ar", "spark"))).alias("arweave"), U.onchfs_ref(F.expr(uri("onchfs", "spark"))).alias("onchfs"))


@query("FN9_uri_to_gateway", "", f"SELECT page_id, replace(u, 'ipfs://', 'https://ipfs.io/ipfs/') AS gateway FROM (SELECT page_id, {uri('ipfs', 'duckdb')} AS u FROM pages) x")
def fn9(v: Views):
    return v.table("pages").select("page_id", U.to_gateway(F.expr(uri("ipfs", "spark"))).alias("gateway"))


@query("FN10_gateway_candidates", "", "SELECT page_id, g || '/ipfs/' || md5(url) AS candidate FROM pages, (SELECT unnest(['https://a.example', 'https://b.example', 'https://c.example']) AS g) x")
def fn10(v: Views):
    gateways = ["https://a.example/", "https://b.example", "https://c.example"]
    return v.table("pages").select("page_id", F.explode(U.gateway_candidates(F.md5("url"), gateways)).alias("candidate"))


@query("FN11_directory_entry_ref", "", "SELECT page_id, CASE WHEN NOT ends_with(p, '/index.html') THEN regexp_replace(p, '/+$', '') || '/index.html' || substr(url, length(p) + 1) END AS entry FROM (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS p FROM pages) x")
def fn11(v: Views):
    return v.table("pages").select("page_id", U.entry_ref(F.col("url")).alias("entry"))


@query("FN12_parse_data_uri", "", "SELECT page_id, 'text/html' AS mime, page_id % 2 = 0 AS based, octet_length(encode(html)) AS bytes FROM pages")
def fn12(v: Views):
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("data:text/html;charset=utf-8;base64,"), F.base64(F.encode("html", "utf-8")))).otherwise(F.concat(F.lit("data:text/html,"), F.url_encode("html")))
    d = U.parse_data_uri(F.replace(raw, F.lit("+"), F.when(F.col("page_id") % 2 == 0, F.lit("+")).otherwise(F.lit("%20"))))
    return v.table("pages").select("page_id", d["mime"].alias("mime"), d["base64"].alias("based"), F.octet_length(d["data"]).cast("long").alias("bytes"))


@query("FN13_did_pkh", "token_dim", "SELECT token_id, lower('did:pkh:' || chain || ':' || contract) AS did FROM token_dim")
def fn13(v: Views):
    return v.token_dim.select("token_id", I.did_pkh(F.col("contract"), F.col("chain")).alias("did"))


@query("FN14_url_hash", "", "SELECT page_id, CASE WHEN page_id % 7 > 0 THEN md5(url) END AS hash FROM pages")
def fn14(v: Views):
    return v.table("pages").select("page_id", U.url_hash(F.when(F.col("page_id") % 7 > 0, F.col("url")).otherwise("")).alias("hash"))


@query("FN15_content_type_norm", "media", "SELECT id, CASE WHEN content_type LIKE 'text%' THEN 'text/html' ELSE content_type END AS mime FROM media")
def fn15(v: Views):
    return v.media.select("id", U.content_type(F.upper("content_type")).alias("mime"))


@query("FN16_content_range_parse", "", "SELECT page_id, CASE WHEN page_id % 4 IN (0, 1) THEN page_id END AS first, CASE WHEN page_id % 4 IN (0, 1) THEN page_id + 9 END AS last, CASE WHEN page_id % 4 = 0 THEN page_id + 10 END AS total FROM pages")
def fn16(v: Views):
    raw = F.expr("CASE page_id % 4 WHEN 0 THEN concat('bytes ', page_id, '-', page_id + 9, '/', page_id + 10) WHEN 1 THEN concat('Bytes ', page_id, '-', page_id + 9, '/*') WHEN 2 THEN concat('bytes ', page_id, '-', page_id + 9, '/', page_id + 9) ELSE 'bytes */5' END")
    r = U.content_range(raw)
    return v.table("pages").select("page_id", r["first"].alias("first"), r["last"].alias("last"), r["total"].alias("total"))


@query("FN17_mint_number_extract", "token_dim", "SELECT token_id, CASE WHEN token_id % 3 < 2 THEN token_id END AS mint FROM token_dim")
def fn17(v: Views):
    k = F.col("token_id") % 3
    name = F.when(k == 0, F.concat(F.col("name"), F.lit(" #"), F.col("number"))).otherwise(F.col("name"))
    return v.token_dim.select("token_id", V.mint_number(name, F.when(k == 2, F.lit("none")).otherwise(F.col("number"))).alias("mint"))


@query("FN18_project_mint_split", "token_dim", "SELECT token_id, CAST(token_id AS BIGINT) AS project, CAST(size AS BIGINT) AS index FROM token_dim")
def fn18(v: Views):
    p = V.project_mint((F.col("token_id") * 1_000_000 + F.col("size")).cast("string"))
    return v.token_dim.select("token_id", p["project"].alias("project"), p["index"].alias("index"))


@query("FN19_spam_flag", "token_dim", "SELECT token_id, CASE WHEN size % 9 = 0 OR size % 5 IN (1, 2) THEN 'spam' ELSE 'none' END AS status FROM token_dim")
def fn19(v: Views):
    flag = F.expr("CASE size % 5 WHEN 1 THEN 'banned' WHEN 2 THEN 'removed' WHEN 3 THEN 'flagged' END")
    return v.token_dim.select("token_id", V.spam_status(F.when(F.col("size") % 9 == 0, True), flag).alias("status"))


@query("FN20_severity", "verdicts", "SELECT source, sum(CASE verdict WHEN 'none' THEN 0 WHEN 'spam' THEN 1 ELSE 2 END) AS total FROM verdicts GROUP BY source")
def fn20(v: Views):
    return v.verdicts.groupBy("source").agg(F.sum(V.severity(F.col("verdict"))).alias("total"))


@query("FN21_hamming", "hashes", "SELECT vec_id, bit_count(xor(hash, 6148914691236517205)) AS distance FROM hashes")
def fn21(v: Views):
    return v.hashes.select("vec_id", V.hamming(F.col("hash"), F.lit(6148914691236517205)).alias("distance"))


@query("FN22_fingerprint_parse", "hashes", "SELECT vec_id, CASE WHEN vec_id % 70 <= 64 THEN hash END AS bits FROM hashes")
def fn22(v: Views):
    return v.hashes.select("vec_id", V.parse_fingerprint(F.hex("hash"), (F.col("vec_id") % 70).cast("int"))["bits"].alias("bits"))


@query("FN23_json_fields", "", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn23(v: Views):
    return v.table("events").select("event_id", V.raw_field(F.col("props"), "k").try_cast("bigint").alias("k"))


@query("FN24_changed_fields", "metadata overlay", """
SELECT m.token_id, concat_ws(',', CASE WHEN o.token_id IS NULL OR m.name IS DISTINCT FROM o.name THEN 'name' END, CASE WHEN o.token_id IS NULL OR m.image_url IS DISTINCT FROM o.image_url THEN 'image_url' END,
       CASE WHEN o.token_id IS NULL OR m.animation_url IS DISTINCT FROM o.animation_url THEN 'animation_url' END) AS changed FROM metadata m LEFT JOIN overlay o ON m.token_id = o.token_id""")
def fn24(v: Views):
    new, old = v.metadata.alias("new"), v.overlay.alias("old")
    c = V.changed_fields("old", "new", ["name", "image_url", "animation_url"], F.col("old.token_id").isNotNull())
    return new.join(old, F.col("new.token_id") == F.col("old.token_id"), "left").select("new.token_id", F.array_join(c, ",").alias("changed"))


# --- filters and joins -------------------------------------------------------------------------------


@query("FLT1_drop_blacklisted", "token_dim", f"SELECT token_id FROM (SELECT token_id, brand, {ODD} AS c FROM token_dim) x WHERE (regexp_matches(c, '^eip155:(1|11155111):(erc721|erc1155):0x[0-9a-fA-F]{{40}}:[0-9]+$') OR regexp_matches(c, '^tezos:(mainnet|ghostnet):fa2:KT1[1-9A-HJ-NP-Za-km-z]{{33}}:[0-9]+$')) AND (brand <> 'Brand#11' OR c LIKE 'tezos%')")
def flt1(v: Views):
    tokens = v.token_dim.withColumn("token_cid", F.expr(ODD))
    listed = tokens.where("brand = 'Brand#11'").select("chain", F.upper("contract").alias("contract")).distinct()
    return S.drop_blacklisted(tokens, listed).select("token_id")


@query("FLT2_interest_filter", "ledger watched token_dim", """
SELECT event_id FROM ledger l WHERE token_id IN (SELECT token_id FROM token_dim WHERE size % 4 = 0)
OR (event_type <> 'metadata_update' AND (EXISTS (SELECT 1 FROM watched w WHERE w.chain = l.chain AND w.address = l.from_address) OR EXISTS (SELECT 1 FROM watched w WHERE w.chain = l.chain AND w.address = l.to_address)))""")
def flt2(v: Views):
    return S.interest_filter(v.ledger, v.token_dim.where("size % 4 = 0"), v.watched).select("event_id")


@query("FLT3_route_by_type", "ledger", "SELECT CASE event_type WHEN 'metadata_update' THEN 'metadata' ELSE event_type END AS handler, count(*) AS n FROM ledger GROUP BY 1")
def flt3(v: Views):
    parts = [df.groupBy().agg(F.count("*").alias("n")).select(F.lit(h).alias("handler"), "n") for h, df in S.route(v.ledger).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("FLT4_visible_only", "token_dim", "SELECT token_id FROM token_dim WHERE is_viewable AND moderation_status = 'none'")
def flt4(v: Views):
    return S.visible(v.token_dim).select("token_id")


@query("FLT5_owned_by", "token_dim balances", "SELECT token_id FROM token_dim WHERE token_id IN (SELECT token_id FROM balances WHERE owner_address IN ('c1', 'c2', 'c3'))")
def flt5(v: Views):
    return S.owned_by(v.token_dim, v.balances, ["c1", "c2", "c3"]).select("token_id")


@query("FLT6_token_attr_filter", "token_dim", "SELECT token_id FROM token_dim WHERE brand IN ('Brand#11', 'Brand#22', 'Brand#33') AND chain IN ('eip155:1') AND size IN (1, 2, 3, 4, 5, 6)")
def flt6(v: Views):
    return S.token_filter(v.token_dim, brand=["Brand#11", "Brand#22", "Brand#33"], chain=["eip155:1"], size=[1, 2, 3, 4, 5, 6], number=[]).select("token_id")


@query("FLT7_release_filter", "token_dim release_dim", "SELECT t.token_id, release_id, mint_number FROM token_dim t JOIN release_dim r ON t.token_id = r.token_id WHERE vendor = 'artblocks' AND release_id = 3 AND mint_number IN (1, 2, 3, 4, 5, 8, 13)")
def flt7(v: Views):
    return S.release_filter(v.token_dim, v.release_dim, release_id=3, vendor="artblocks", mint_numbers=[1, 2, 3, 4, 5, 8, 13]).select("token_id", "release_id", "mint_number")


@query("FLT8_event_subscription_match", "ledger clients", "SELECT event_id, client_id FROM ledger, clients WHERE is_active AND (filters = '*' OR list_contains(string_split(filters, ','), event_type))")
def flt8(v: Views):
    return S.match_clients(v.ledger.select("event_id", "event_type"), v.clients.withColumn("filters", F.split("filters", ","))).select("event_id", "client_id")


@query("FLT9_unsigned_placeholder", "metadata", "SELECT token_id FROM metadata WHERE standard = 'fa2' AND (lower(trim(name)) = '[waiting to be signed]' OR lower(description) LIKE '%waiting to be signed by fxhash signer%' OR animation_url LIKE '%QmdGV3UqJqX4v5x9nFcDYeekCEAm3SDXUG5SHdjKQKn4Pe%')")
def flt9(v: Views):
    return S.placeholder_rows(v.metadata).select("token_id")


@query("FLT10_reprocess_candidates", "overlay release_dim", "SELECT token_id FROM overlay WHERE vendor IN ('objkt') UNION SELECT arg_min(token_id, mint_number * 1000000000 + token_id) FROM release_dim WHERE slug IS NULL GROUP BY release_id")
def flt10(v: Views):
    return S.reprocess_candidates(v.overlay, v.release_dim, ["objkt"])


@query("FLT11_deferred_backlog", "token_dim", "SELECT token_id FROM token_dim WHERE burned AND size IS NOT NULL")
def flt11(v: Views):
    return v.token_dim.withColumn("provenance_deferred_at", F.when(F.col("burned"), F.col("created_at"))).where("provenance_deferred_at is not null").select("token_id")


@query("JN1_publisher_lookup", "metadata", "SELECT token_id, CASE WHEN contract IN ('Brand#11', 'Brand#12') THEN 'P-' || contract WHEN deployer LIKE 'P%' THEN 'D-' || deployer END AS publisher FROM metadata")
def jn1(v: Views):
    m = v.metadata
    by_collection = m.where(F.col("contract").isin("Brand#11", "Brand#12")).select(F.upper("contract").alias("key"), F.concat(F.lit("P-"), "contract").alias("publisher")).distinct()
    by_deployer = m.where("deployer like 'P%'").select(F.upper("deployer").alias("key"), F.concat(F.lit("D-"), "deployer").alias("publisher")).distinct()
    return S.publisher_lookup(m, by_collection, by_deployer).select("token_id", "publisher")


@query("JN2_deployer_attach", "metadata", "SELECT token_id, CASE WHEN contract <> 'Brand#13' THEN 'dep-' || contract END AS deployer FROM metadata")
def jn2(v: Views):
    known = v.metadata.select("contract", F.when(F.col("contract") == "Brand#13", " ").otherwise(F.concat(F.lit("dep-"), "contract")).alias("deployer")).distinct()
    return S.deployer_attach(v.metadata.drop("deployer"), known).select("token_id", "deployer")


@query("JN3_release_membership", "token_dim release_dim", "SELECT t.token_id, release_id, mint_number FROM token_dim t LEFT JOIN (SELECT * FROM release_dim WHERE mint_number <= 20) r ON t.token_id = r.token_id")
def jn3(v: Views):
    return S.release_membership(v.token_dim, v.release_dim.where("mint_number <= 20")).select("token_id", "release_id", "mint_number")


@query("JN4_media_asset_attach", "metadata media", """
WITH a AS (SELECT DISTINCT md5(image_url) AS url_hash, 'asset-' || image_url AS asset FROM metadata WHERE size % 2 = 0), u AS (
  SELECT token_id, image_url AS url FROM metadata UNION SELECT token_id, animation_url FROM metadata WHERE animation_url IS NOT NULL)
SELECT DISTINCT token_id, asset FROM u JOIN a ON md5(u.url) = a.url_hash""")
def jn4(v: Views):
    m = v.metadata
    assets = m.where("size % 2 = 0").select(F.md5("image_url").alias("url_hash"), F.concat(F.lit("asset-"), "image_url").alias("asset")).distinct()
    return S.media_assets_of(m, assets, ["image_url", "animation_url"]).select("token_id", "asset")


@query("JN5_tokens_by_url", "media probes", "SELECT DISTINCT m.url_hash, token_id FROM media m WHERE url_hash IN (SELECT url_hash FROM probes WHERE verdict = 'blank')")
def jn5(v: Views):
    return S.tokens_by_url(v.media, v.probes.where("verdict = 'blank'"))


@query("JN6_gate_anti_join", "media probes", "SELECT id FROM media WHERE url_hash NOT IN (SELECT url_hash FROM probes WHERE health_gated)")
def jn6(v: Views):
    return S.without_gated(v.media, v.probes).select("id")


@query("JN7_hash_neighbours", "hashes", """
WITH k AS (SELECT vec_id AS position, hash AS bits FROM hashes WHERE vec_id % 5 = 0)
SELECT vec_id AS id, min(position) AS position FROM hashes, k WHERE bit_count(xor(hash, bits)) <= 7 GROUP BY vec_id""")
def jn7(v: Views):
    known = v.hashes.where("vec_id % 5 = 0").select(F.col("vec_id").alias("position"), F.col("hash").alias("bits"))
    return S.hash_neighbours(v.hashes.select(F.col("vec_id").alias("id"), "hash"), known, 7)


NOW = "TIMESTAMP '2020-02-10 00:00:00'"


def now():
    return F.expr("TIMESTAMP_NTZ'2020-02-10 00:00:00'")


@query("JN8_due_items_join", "verdicts token_dim", f"SELECT v.token_id, contract, number, next_check_at FROM verdicts v JOIN token_dim t ON v.token_id = t.token_id WHERE source = 'objkt' AND next_check_at <= {NOW}")
def jn8(v: Views):
    return S.due_items(v.verdicts, v.token_dim, "objkt", now()).select("token_id", "contract", "number", "next_check_at")


@query("JN9_cid_from_release", "release_dim", "SELECT token_id, 'eip155:1:erc721:0xabc:' || CAST(release_id * 1000000 + mint_number - 1 AS VARCHAR) AS cid FROM release_dim")
def jn9(v: Views):
    asked = v.release_dim.select("token_id", F.col("release_id").cast("long").alias("project"), F.col("mint_number").cast("long").alias("mint"))
    return S.cids_from_release(asked, F.lit("eip155:1:erc721:0xabc:")).select("token_id", "cid")


@query("JN9_cid_from_listing", "release_dim", "SELECT r.release_id, r.mint, 'm' || CAST(d.token_id AS VARCHAR) AS cid FROM (SELECT DISTINCT release_id, mint_number + 30 AS mint FROM release_dim) r LEFT JOIN release_dim d ON r.release_id = d.release_id AND r.mint = d.mint_number")
def jn9_listing(v: Views):
    """Mints 31 on are asked for; those above the highest have no member."""
    asked = v.release_dim.select("release_id", (F.col("mint_number") + 30).alias("mint")).distinct()
    return S.cids_from_listing(asked, v.release_dim.withColumn("cid", F.concat(F.lit("m"), "token_id")))


# --- top-level reads ---------------------------------------------------------------------------------


@query("QRY1_tokens", "token_dim balances release_dim", """
SELECT t.token_id, created_at, mint_number FROM token_dim t JOIN release_dim r ON t.token_id = r.token_id
WHERE is_viewable AND moderation_status = 'none' AND t.token_id IN (SELECT token_id FROM balances WHERE owner_address IN ('c1', 'c2', 'c3', 'c4', 'c5'))
ORDER BY created_at DESC NULLS LAST, t.token_id DESC LIMIT 21 OFFSET 10""")
def qry1(v: Views):
    from .tokens import TokenQuery, query_tokens

    q = TokenQuery(owners=["c1", "c2", "c3", "c4", "c5"], sort_by="created_at", limit=20, offset=10, with_release=True)
    return query_tokens(q, v.token_dim, v.balances, v.release_dim).select("token_id", "created_at", "mint_number")


@query("QRY1_tokens_by_provenance", "ledger token_dim balances", """
WITH b AS (SELECT token_id, 'u' || (token_id % 3) AS owner_address FROM balances), op AS (
  SELECT token_id, to_address AS owner_address, max(event_id) AS id, max(ts) AS last_timestamp FROM ledger WHERE to_address IS NOT NULL GROUP BY token_id, to_address), l AS (
  SELECT token_id, max(last_timestamp) AS last_timestamp FROM op WHERE owner_address IN ('u1', 'u2') GROUP BY token_id)
SELECT t.token_id, last_timestamp FROM token_dim t LEFT JOIN l ON t.token_id = l.token_id
WHERE is_viewable AND moderation_status = 'none' AND t.token_id IN (SELECT token_id FROM b WHERE owner_address IN ('u1', 'u2')) AND brand IN ('Brand#1', 'Brand#12', 'Brand#21') ORDER BY last_timestamp DESC NULLS LAST, t.token_id DESC LIMIT 41""")
def qry1_provenance(v: Views):
    """More tokens are held than have a row of the owners: those come last."""
    from .ledger import provenance_rows
    from .tokens import TokenQuery, query_tokens

    held = v.balances.select("token_id", F.concat(F.lit("u"), F.col("token_id") % 3).alias("owner_address"))
    q = TokenQuery(owners=["u1", "u2"], sort_by="latest_provenance", limit=40)
    tokens = v.token_dim.where(F.col("brand").isin("Brand#1", "Brand#12", "Brand#21"))
    return query_tokens(q, tokens, held, None, provenance_rows(v)).select("token_id", "last_timestamp")


def expansion_tables(v: Views):
    from .ledger import provenance_rows

    urls = v.metadata.select(F.explode(F.array("image_url", "animation_url")).alias("url")).unionByName(v.overlay.select(F.explode(F.array("image_url", "animation_url")).alias("url"))).unionByName(v.table("pages").select("url"))
    assets = urls.where("url is not null").distinct().where(F.length("url") % 3 > 0).select(F.md5("url").alias("source_url_hash"), F.create_map(F.lit("public"), F.concat(F.lit("cdn/"), F.md5("url"))).alias("variant_urls"))
    return {"balances": v.balances, "events": v.ledger, "ownership": provenance_rows(v), "metadata": v.metadata.withColumnRenamed("deployer", "artist"), "enrichment": v.overlay, "health": v.media, "assets": assets}


EXPANDED = """
op AS (SELECT token_id, to_address AS owner_address, max(event_id) AS id, max(ts) AS last_timestamp, arg_max(tx_index, event_id) AS last_tx_index FROM ledger WHERE to_address IS NOT NULL GROUP BY token_id, to_address), o AS (
  SELECT token_id, string_agg(owner_address, ',' ORDER BY k) AS owners, max(total) AS owners_total FROM (SELECT *, count(*) OVER (PARTITION BY token_id) AS total, row_number() OVER (PARTITION BY token_id ORDER BY quantity DESC, owner_address) AS k FROM balances) x WHERE k <= 3 GROUP BY token_id), e AS (
  SELECT token_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY k) AS events, max(total) AS events_total FROM (SELECT *, count(*) OVER (PARTITION BY token_id) AS total, row_number() OVER (PARTITION BY token_id ORDER BY ts DESC, event_id DESC) AS k FROM ledger) x WHERE k <= 3 GROUP BY token_id), w AS (
  SELECT token_id, string_agg(owner_address, ',' ORDER BY k) AS owner_provenances FROM (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY last_timestamp DESC, last_tx_index DESC, id DESC) AS k FROM op) x WHERE k <= 3 GROUP BY token_id), h AS (
  SELECT token_id, coalesce(max(CASE WHEN media_source = 'enrichment_image' AND health_status = 'healthy' THEN media_url END), max(CASE WHEN media_source = 'metadata_image' AND health_status = 'healthy' THEN media_url END)) AS image,
    coalesce(max(CASE WHEN media_source = 'enrichment_animation' AND health_status = 'healthy' THEN media_url END), max(CASE WHEN media_source = 'metadata_animation' AND health_status = 'healthy' THEN media_url END)) AS animation,
    bool_or(media_source LIKE '%image') AS has_image, bool_or(media_source LIKE '%animation') AS has_animation FROM media GROUP BY token_id), y AS (
  SELECT m.token_id, coalesce(v.name, m.name) AS name, CASE WHEN has_image THEN image ELSE coalesce(v.image_url, m.image_url) END AS image_url, CASE WHEN has_animation THEN animation ELSE coalesce(v.animation_url, m.animation_url) END AS animation_url,
    CASE WHEN v.artist <> '' THEN v.artist ELSE m.deployer END AS artist FROM metadata m LEFT JOIN overlay v ON m.token_id = v.token_id LEFT JOIN h ON m.token_id = h.token_id), z AS (
  SELECT token_id, image_url AS url FROM metadata UNION SELECT token_id, animation_url FROM metadata UNION SELECT token_id, image_url FROM overlay UNION SELECT token_id, animation_url FROM overlay UNION SELECT token_id, image_url FROM y UNION SELECT token_id, animation_url FROM y), a AS (
  SELECT token_id, string_agg(md5(url), ',' ORDER BY md5(url)) AS assets FROM z WHERE url <> '' AND length(url) % 3 > 0 GROUP BY token_id)
SELECT t.token_id, owners, owners_total, events, events_total, owner_provenances, m.name AS metadata_name, v.image_url AS enrichment_image, y.name AS display_name, y.image_url AS display_image, y.animation_url AS display_animation, y.artist AS display_artist, assets
FROM token_dim t LEFT JOIN o ON t.token_id = o.token_id LEFT JOIN e ON t.token_id = e.token_id LEFT JOIN w ON t.token_id = w.token_id LEFT JOIN metadata m ON t.token_id = m.token_id LEFT JOIN overlay v ON t.token_id = v.token_id LEFT JOIN y ON t.token_id = y.token_id LEFT JOIN a ON t.token_id = a.token_id"""


def expanded(v: Views, tokens, ids: list[int] | None = None):
    from .tokens import KINDS, expand

    joined = lambda c, f: F.array_join(F.transform(c, lambda x: x[f].cast("string")), ",")
    return expand(tokens, KINDS, expansion_tables(v), 3, ids=ids).select(
        "token_id", joined("owners", "owner_address").alias("owners"), "owners_total", joined("provenance_events", "event_id").alias("events"), F.col("provenance_events_total").alias("events_total"), joined("owner_provenances", "owner_address").alias("owner_provenances"),
        F.col("metadata.name").alias("metadata_name"), F.col("enrichment_source.image_url").alias("enrichment_image"), F.col("display.name").alias("display_name"), F.col("display.image_url").alias("display_image"), F.col("display.animation_url").alias("display_animation"), F.col("display.artist").alias("display_artist"), F.array_join("media_asset", ",").alias("assets"),
    )


@query("QRY2_token_detail", "token_dim ledger balances metadata overlay media", f"WITH {EXPANDED} WHERE t.token_id = 42")
def qry2(v: Views):
    return expanded(v, v.token_dim.where("token_id = 42"), [42])


@query("QRY3_token_expand", "token_dim ledger balances metadata overlay media", f"WITH {EXPANDED}")
def qry3(v: Views):
    return expanded(v, v.token_dim)


@query("QRY4_releases", "release_dim", "SELECT release_id, vendor_release_id, slug, count(*) AS members FROM release_dim GROUP BY ALL ORDER BY release_id LIMIT 10 OFFSET 5")
def qry4(v: Views):
    return v.release_dim.groupBy("release_id", "vendor_release_id", "slug").agg(F.count("*").alias("members")).orderBy("release_id").offset(5).limit(10)


@query("QRY5_release_members", "token_dim release_dim", "SELECT t.token_id, mint_number FROM token_dim t JOIN release_dim r ON t.token_id = r.token_id WHERE release_id = 4 AND is_viewable AND moderation_status = 'none' ORDER BY mint_number, t.token_id LIMIT 26")
def qry5(v: Views):
    from .tokens import TokenQuery, query_tokens

    return query_tokens(TokenQuery(release_id=4, sort_by="mint_number", descending=False, limit=25), v.token_dim, None, v.release_dim).select("token_id", "mint_number")


@query("QRY7_provenance_page", "ledger", "SELECT event_id, event_type, count(*) OVER () AS total FROM ledger WHERE token_id = 17 ORDER BY ts DESC, tx_index DESC, event_id DESC LIMIT 10 OFFSET 20")
def qry7(v: Views):
    from .tokens import provenance

    return provenance(v.ledger, 17, 10, 20, True).select("event_id", "event_type", "total")


@query("QRY12_next_scan_range", "watched", """
SELECT id, CASE WHEN min_block IS NULL THEN 'full' WHEN min_block > 100 THEN 'older' WHEN max_block < 9000 THEN 'newer' ELSE 'none' END AS kind,
       CASE WHEN min_block IS NULL THEN 100 WHEN min_block > 100 THEN 100 WHEN max_block < 9000 THEN max_block + 1 END AS lo,
       CASE WHEN min_block IS NULL THEN 9000 WHEN min_block > 100 THEN min_block - 1 WHEN max_block < 9000 THEN 9000 END AS hi FROM watched""")
def qry12(v: Views):
    from .tokens import next_range

    return next_range(v.watched, 9000, 100).select("id", "kind", "lo", "hi")


@query("QRY13_quota_info", "watched", "SELECT id, CAST(greatest(quota - CASE WHEN quota_reset_at <= TIMESTAMP '2020-01-12' THEN 0 ELSE used END, 0) AS BIGINT) AS remaining, CASE WHEN quota_reset_at <= TIMESTAMP '2020-01-12' THEN TIMESTAMP '2020-01-13' ELSE quota_reset_at END AS resets_at FROM watched")
def qry13(v: Views):
    from .tokens import quota

    return quota(v.watched, "2020-01-12 00:00:00").select("id", "remaining", "resets_at")
