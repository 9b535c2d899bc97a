"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, quality, secrets, simhash, token_files, topk, toxicity, url_filter, warc, winnow
from .common import scratch, table


def tokenizer_file(name: str) -> str:
    """Place of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def id_hash(column: str = "doc_id") -> Column:
    """Unsigned crc32 of the id's decimal text."""
    return F.crc32(F.encode(F.col(column).cast("string"), "UTF-8"))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return topk.top_k(v, v.where(F.col("vec_id") % 50 == 0), 5)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def held_out(scored: DataFrame, mod: int, rest: int) -> DataFrame:
    return scored.select("doc_id", F.coalesce(id_hash() % mod == rest, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), id_hash() % 5 != 0)
    return held_out(toxicity.score(docs, model), 5, 0)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "warc")
    return warc.read_warc(spark, out, warc.write_warc(table(spark, sf_dir, "pages"), out))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), id_hash() % 3 != 1)
    return held_out(quality.score(docs, model), 3, 1)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tokens")
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), out, tokenizer_file("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, out, manifest)


def op10_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_topk, op2_simhash, op3_toxicity, op4_warc, op5_byte_bpe, op6_url_filter, op7_quality, op8_secrets, op9_token_files, op10_winnow)}

_N = {n: secrets.n_log_n(n) for n in range(secrets.WINDOW + 1)}

ORACLE_SQL = {
    "op1_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5""",
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS best FROM p WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST, url DESC))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND k > 1 THEN best END AS refers_to
FROM m""",
    "op6_url_filter": r"""
WITH r AS (SELECT row_number() OVER () AS r, page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
h AS (SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) t(verdict, rhost, rpath)),
f AS (SELECT h.*, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY h.r ORDER BY length(rhost) DESC NULLS LAST, length(rpath) DESC) AS n
      FROM h LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1""",
    "op8_secrets": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
k(kind, no, re, least) AS (VALUES
  ('assign', 0, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', 12),
  ('access', 1, 'AKIA[A-Z0-9]{{14,}}', 18), ('hex', 2, '[0-9a-f]{{16,}}', 16), ('entropy', 3, '[A-Za-z0-9+/_=-]{{20,}}', 20)),
m AS (SELECT r, kind, no, least, string_split_regex(text, re) AS gaps, regexp_extract_all(text, re) AS hits FROM d, k),
e AS (SELECT r, kind, no, least, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
p AS (SELECT r, kind, no, least, hits[i] AS hit,
             CAST(sum(length(gaps[i])) OVER w + sum(length(hits[i])) OVER w - length(hits[i]) AS BIGINT) AS s
      FROM e WINDOW w AS (PARTITION BY r, no ORDER BY i)),
b AS (SELECT r, kind, no, s, s + length(hit) AS t, hit FROM p
      WHERE CASE WHEN no = 0 THEN length(regexp_replace(hit, '^(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?', '')) ELSE length(hit) END >= least
        AND (no < 3 OR (regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')
             AND NOT regexp_matches(hit, '^[0-9A-Fa-f]{{8}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{12}}$')))),
w AS (SELECT DISTINCT hit, unnest(range(1, length(hit) - {secrets.WINDOW} + 2)) AS i FROM b WHERE no = 3),
c AS (SELECT hit, i, unnest(string_split(substr(hit, i, {secrets.WINDOW}), '')) AS ch FROM w),
n AS (SELECT hit, i, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL),
t AS (SELECT hit, i, sum(list_extract([{", ".join(str(_N[i]) for i in range(1, secrets.WINDOW + 1))}], n)) AS f FROM n GROUP BY ALL),
h AS (SELECT hit, floor(({secrets.WINDOW * round(__import__("math").log2(secrets.WINDOW) * 1_000_000)} - min(f)) / {secrets.WINDOW}) AS bits FROM t GROUP BY hit),
a AS (SELECT b.* FROM b LEFT JOIN h USING (hit) WHERE no < 3 OR bits >= CASE WHEN regexp_matches(hit, '^[0-9a-fA-F]+$') THEN {secrets.HEX_BITS} WHEN regexp_matches(hit, '^[A-Za-z0-9]+$') THEN {secrets.ALNUM_BITS} ELSE {secrets.BASE64_BITS} END),
g AS (SELECT r, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
             coalesce(string_agg(kind || ':' || s || ':' || t, ',' ORDER BY s, no) FILTER (no < 3), '') AS base, string_agg(kind || ':' || s || ':' || t, ',' ORDER BY s, no) AS spans
      FROM a GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)""",
    "op10_winnow": r"""
WITH fold AS (SELECT row_number() OVER () AS item, coalesce(CAST(item_id AS VARCHAR), '') AS name, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, name, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item, name, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM fold WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
spots AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
occ AS (SELECT spots.r, spots.n, spots.i, win.item, win.name FROM spots JOIN win USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM occ) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS s FROM (SELECT DISTINCT r, item, name FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
}
