"""The queries of this subpackage, opN_<name>, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import cuckoo, html_text, langid, merkle, minhash, mixing, pieces, resharding, simhash, toxicity, trie, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def capture_records(pages: DataFrame) -> DataFrame:
    """WARC records made of pages: two thirds are responses of their section's URL, and each is also a revisit of it, in
    another spelling.

    A section has responses of several pages; the revisits follow some of them by seconds or by days, and some come
    before the first. Entity tags are of the section and the time, so they agree with the latest earlier response if it
    is recent; other revisits have another tag, or none, and are left to the time of change."""
    section = F.regexp_replace("url", "/[0-9]+.*$", "/")
    shift = F.expr("page_id % 7 * 10 + page_id % 13 * 1000 + CASE WHEN page_id % 17 = 0 THEN 500000 ELSE 0 END - CASE WHEN page_id % 4 = 3 THEN 40000 ELSE 0 END")
    tag = lambda at: F.concat(F.lit('"'), F.md5(F.concat(section, F.floor(at / 90000).cast("string"))), F.lit('"'))
    day = lambda at: F.concat(F.lit("day "), F.floor(at / 400000).cast("string"))
    headers = lambda *x: F.map_filter(F.create_map(*x), lambda _, v: v.isNotNull())
    answered, asked = F.col("page_id") * 60, F.col("page_id") * 60 + 1 + shift
    response = pages.where("page_id % 3 <> 0").select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), section.alias("url"), answered.alias("at"),
        headers(F.lit("etag"), F.when(F.col("page_id") % 4 != 0, tag(answered)), F.lit("last-modified"), day(answered), F.lit("content-type"), F.lit("text/html"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
        F.octet_length("html").cast("long").alias("payload_bytes"), F.sha2("html", 256).alias("payload_sha256"),
    )
    spelling = F.concat(F.upper(F.regexp_extract(section, "^[^/]*//[^/]*", 0)), F.regexp_replace(section, "^[^/]*//[^/]*", ""), F.lit("#again"))
    etag = F.when(F.col("page_id") % 5 != 0, F.when(F.col("page_id") % 11 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag(asked))))
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), spelling.alias("url"), asked.alias("at"),
        headers(F.lit("etag"), etag, F.lit("last-modified"), F.when(F.col("page_id") % 3 != 0, day(asked)), F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.concat(F.lit("max-age="), (F.col("page_id") % 90).cast("string"))).alias("headers"),
        F.lit(None).cast("long").alias("payload_bytes"), F.lit(None).cast("string").alias("payload_sha256"),
    )
    return response.unionByName(revisit)


@query
def op1_not_modified_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every not-modified revisit with the response it stands for, its state and its merged headers."""
    found = warc.resolve_revisits(capture_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    line = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda x: F.concat(x["key"], F.lit(": "), x["value"])), "; ")
    return found.select("revisit_id", "response_id", "state", line.alias("headers"), "payload_bytes", "payload_sha256")


ORACLES["op1_not_modified_revisits"] = """
WITH p AS (
  SELECT page_id, html, regexp_replace(url, '/[0-9]+.*$', '/') AS section, page_id * 60 AS answered,
         page_id * 60 + 1 + page_id % 7 * 10 + page_id % 13 * 1000 + CASE WHEN page_id % 17 = 0 THEN 500000 ELSE 0 END
           - CASE WHEN page_id % 4 = 3 THEN 40000 ELSE 0 END AS asked
  FROM pages
), u AS (
  SELECT *, regexp_replace(trim(section), '^[A-Za-z][A-Za-z0-9+.\\-]*://', '') AS rest FROM p
), c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(rest, '^([^/?#]*)', 1), '^[^@]*@', '')), '\\.?(:80|:443)?$', ''), '^www[0-9]*\\.', '')
            || CASE WHEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) END
            || CASE WHEN regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) = '' THEN ''
                    ELSE '?' || array_to_string(list_sort(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&')), '&') END AS key
  FROM u
), r AS (
  SELECT page_id * 2 AS response_id, key, answered AS at,
         CASE WHEN page_id % 4 <> 0 THEN '"' || md5(section || CAST(CAST(floor(answered / 90000) AS BIGINT) AS VARCHAR)) || '"' END AS etag,
         'day ' || CAST(CAST(floor(answered / 400000) AS BIGINT) AS VARCHAR) AS changed,
         CAST(octet_length(encode(html)) AS BIGINT) AS bytes, sha256(html) AS sha FROM c WHERE page_id % 3 <> 0
), v AS (
  SELECT page_id * 2 + 1 AS revisit_id, key, asked AS at,
         CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 11 = 0 THEN '"other"'
              ELSE 'W/"' || md5(section || CAST(CAST(floor(asked / 90000) AS BIGINT) AS VARCHAR)) || '"' END AS etag,
         CASE WHEN page_id % 3 <> 0 THEN 'day ' || CAST(CAST(floor(asked / 400000) AS BIGINT) AS VARCHAR) END AS changed,
         'max-age=' || CAST(page_id % 90 AS VARCHAR) AS cache FROM c
), j AS (
  SELECT v.revisit_id, r.response_id, r.bytes, r.sha, r.etag AS re, v.etag AS ve, r.changed AS rc, v.changed AS vc, v.cache
  FROM v ASOF LEFT JOIN r ON v.key = r.key AND v.at > r.at
), s AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'missing'
                 WHEN re IS NOT NULL AND ve IS NOT NULL THEN CASE WHEN re = regexp_replace(ve, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
                 WHEN rc IS NOT NULL AND vc IS NOT NULL THEN CASE WHEN rc = vc THEN 'resolved' ELSE 'mismatch' END
                 ELSE 'unvalidated' END AS state FROM j
)
SELECT revisit_id, response_id, state,
       CASE WHEN state = 'resolved' THEN 'cache-control: ' || cache || '; content-type: text/html'
            || coalesce('; etag: ' || coalesce(ve, re), '') || '; last-modified: ' || coalesce(vc, rc) END AS headers,
       CASE WHEN state = 'resolved' THEN bytes END AS payload_bytes, CASE WHEN state = 'resolved' THEN sha END AS payload_sha256
FROM s
"""


@query
def op2_site_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, without the site's template."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op3_min_cost_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents moved from 8 shards by source to 8 shards of near equal bytes, with the fewest bytes moved."""
    placed, _ = resharding.reshard(table(spark, sf_dir, "documents"), resharding.old_shard_by_source(8), 8, 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


@query
def op4_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by weights 5, 2, 1 takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op4_sainte_lague_mix"] = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null ' || CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS VARCHAR))) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source
), w AS (
  SELECT source, n, k, CAST(CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS HUGEINT) AS w, 3 * n AS cap FROM s
), r AS (
  SELECT *, row_number() OVER o AS rank, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before,
         sum(n) OVER () AS total, sum(w) OVER () AS w_all
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), k)
), c AS (
  SELECT *, rank < coalesce(min(CASE WHEN cap * (w_all - w_before) > (total - cap_before) * w THEN rank END) OVER (), 1000000) AS capped FROM r
), t AS (
  SELECT source, k, n, total, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
         CAST(w * (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) AS DOUBLE)
         / CAST(w_all - coalesce(sum(CASE WHEN capped THEN w END) OVER (), 0) AS DOUBLE) END AS target
  FROM c
), m AS (
  SELECT 8 * greatest(4096, (least(max(total), CAST(ceil(CAST(100 * max(total) AS DOUBLE) / min(target) FILTER (WHERE target > 0)) AS HUGEINT)) + 7) // 8) AS seats FROM t
), q AS (
  SELECT k, count(*) AS quota FROM (
    SELECT k, row_number() OVER (ORDER BY target / CAST(2 * i + 1 AS DOUBLE) DESC, k) AS place, seats
    FROM (SELECT k, target, seats, unnest(range(CAST(seats AS BIGINT))) AS i FROM t, m WHERE target > 0)
  ) WHERE place <= seats GROUP BY k
), p AS (
  SELECT t.*, least(3 * n, (2 * total * coalesce(quota, 0) + seats) // (2 * seats)) AS took FROM t LEFT JOIN q USING (k), m
), l AS (
  SELECT d.doc_id, d.size, CAST(p.n AS BIGINT) AS source_size, p.target, p.n, p.took,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (took // greatest(n, 1)) + greatest(0, least(size, took - (took // greatest(n, 1)) * n - start)) AS BIGINT) AS taken
FROM l
"""


@query
def op5_language_family_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: family first, then one machine for each two languages of it."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op6_sentencepiece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids, of the source spans of their pieces, and of their decoded text."""
    model = piece_model()
    encoded = pieces.encode(table(spark, sf_dir, "documents"), model, digests=True)
    return pieces.decode(encoded, model, ("covered_bytes", "spans_sha256")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"), "covered_bytes", "spans_sha256")


@query
def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every document and of its edited text, and their likeness."""
    return merkle.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op8_cuckoo_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal normalised texts by the cuckoo-filter index; the least doc_id of each stays."""
    return cuckoo.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op8_cuckoo_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""


@query
def live_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's kept index: all documents are inserted, those labelled toxic are taken out again, and every document is looked up:
    the least live document with its text, if there is one."""
    docs = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    index = cuckoo.insert(cuckoo.empty_index(spark), docs)
    index = cuckoo.delete(index, docs.join(toxic, "doc_id", "left_semi"))
    return cuckoo.lookup(index, docs)


ORACLES["live_digest_index"] = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id FROM d WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) GROUP BY text_sha256
)
SELECT d.doc_id, d.text_sha256, g.keep_id, g.text_sha256 IS NOT NULL AS live FROM d LEFT JOIN g ON d.text_sha256 = g.text_sha256
"""


@query
def op9_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 2-word shingle sets have a similarity of 0.8 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


@query
def op10_toxicity_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a factorization machine learned from the labels."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op11_jacobi_davidson_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the first 8 whitened components; deviation is null where a long can't hold it."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), k=8)
    return found.withColumnRenamed("deviation", "deviation_exact").withColumn("deviation", F.expr("try_cast(deviation_exact as long)")).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual", "deviation_exact")


@query
def op12_lcp_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op12_lcp_prefix_trie"] = """
WITH crc_table AS (
  SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), turns AS (
  SELECT conv_id, turn, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(said ORDER BY turn NULLS FIRST, said.role, said.text) AS said FROM turns GROUP BY conv_id
), heads AS (
  SELECT o.*, coalesce(b.said, []) AS head,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(o.conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                         lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8)), 4294967295) % 4 AS h
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20, crc_table
), rebuilt AS (
  SELECT conv_id, list_concat(list_slice(head, 1, h), list_slice(said, h + 1, len(said))) AS said FROM heads
), members AS (
  SELECT conv_id, d, list_slice(said, 1, d) AS path, d = len(said) AS ends FROM rebuilt, unnest(range(len(said) + 1)) u(d)
), nodes AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY path, d
), kids AS (
  SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), sums AS (
  SELECT list_slice(n.path, 1, a) AS path, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves,
         sum(CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.path[n.depth].text, '[^\\x20\\x09-\\x0D]+')) END) AS saved
  FROM nodes n LEFT JOIN kids k ON k.path = n.path, unnest(range(n.depth + 1)) u(a) GROUP BY 1
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path LEFT JOIN kids k ON k.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = list_slice(n.path, 1, n.depth - 1)
"""


@query
def op13_deletion_variant_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word SimHash fingerprints differ in 4 bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)
