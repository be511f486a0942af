"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, golden, licenses, lm_scoring, mixing, quality, sharding, simhash, substring, trie, url_filter, vecdedup
from tessera.llm.common import crc_remainder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
THRESHOLD = 0.3


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return lm_scoring.score_documents(docs, crc_remainder(F.col("doc_id"), 7) != 2)


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.Model:
    return quality.train(docs, _read(spark, sf_dir, "labels"), crc_remainder(F.col("doc_id"), 5) != 0)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, quality_model(spark, sf_dir, docs))
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_read(spark, sf_dir, "documents"), 24)


def op5_ivfpq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), bpe.read_ranks(RANKS), PATTERN)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(_read(spark, sf_dir, "documents"))


#: Verdict, host and path of the rules.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"), RULES)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_digest(_read(spark, sf_dir, "documents"))


def op10_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_vectors(_read(spark, sf_dir, "embeddings"))


def op11_golden_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = golden.golden_records(_read(spark, sf_dir, "clients"))
    return won.withColumn("balance_cents", F.floor(100 * F.col("balance") + 0.5).cast("long")).drop("balance")


#: Labels and the phrases that give them.
LICENSE_PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_documents(_read(spark, sf_dir, "documents"), LICENSE_PHRASES))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.spliced(trie.numbered(_read(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (op1_lm_scoring, op2_quality_classifier, op3_simhash_neardup, op4_feistel_sharding, op5_ivfpq_neighbours, op6_byte_bpe, op7_source_mixing, op8_url_filter, op9_substring_dedup, op10_vector_neardup, op11_golden_record, op12_license_scan, op13_prefix_trie)
    return {f.__name__: f for f in all_}


def _op8_sql() -> str:
    """Rules from the longest to the shortest, then the vocabulary's terms between boundaries."""
    rules = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    fits = []
    for _, rule in rules:
        host, _, tail = rule.partition("/")
        fits.append(f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{tail}')")
    rule = " ".join(f"WHEN {f} THEN '{r}'" for f, (_, r) in zip(fits, rules, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _) in zip(fits, rules, strict=True))
    terms = url_filter.read_terms()
    strict = [(t, 1) for t, w in terms.items() if w >= url_filter.LIMIT]
    soft = [(t, w) for t, w in terms.items() if w < url_filter.LIMIT]
    count = lambda ts: " + ".join(f"{w} * CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)" for t, w in ts)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), h AS (SELECT *, {count(strict)} AS strict_hits, {count((t, 1) for t, _ in soft)} AS soft_hits, {count(soft)} AS soft_weight FROM p)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN strict_hits > 0 OR (soft_hits >= 2 AND soft_weight >= {url_filter.LIMIT}) THEN 'block' ELSE 'allow' END AS verdict,
       strict_hits, soft_hits, soft_weight
FROM h
"""


#: Links by cosine within a label, and their transitive closure.
OP10_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), comp AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
deg AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT embeddings.vec_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, comp.component_id,
       embeddings.vec_id = comp.component_id AS kept
FROM embeddings JOIN comp USING (vec_id) LEFT JOIN deg USING (vec_id)
"""


#: Windows of 50 words and the smallest document that starts each.
OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), firsts AS (SELECT h, min(doc_id) AS first_doc FROM win GROUP BY h),
hits AS (SELECT win.doc_id, win.i FROM win JOIN firsts USING (h) WHERE first_doc < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hits),
pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (
  SELECT pos.doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM pos ANTI JOIN gone ON pos.doc_id = gone.doc_id AND pos.p = gone.p GROUP BY pos.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def _op11_sql() -> str:
    """Every field's first value over one sorted window of the whole cluster."""
    ties = ", ".join(f"{c} NULLS FIRST" for c in ("name", "email", "city", "nation_id", "segment", "balance"))
    recent = f"updated_at DESC NULLS LAST, trust, client_id NULLS LAST, {ties}"
    trusted = f"stale, trust, {recent}"
    orders = {"segment": recent, "email": trusted, "name": f"length(name) DESC NULLS LAST, {trusted}", "balance": f"agrees DESC, {recent}"}
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    first = lambda what, order, drop=" IGNORE NULLS": f"first_value({what}{drop}) OVER (PARTITION BY cluster_id ORDER BY {order} {frame})"
    fields = ", ".join(f"{first(c, o)} AS w_{c}, {first(f'CASE WHEN {c} IS NOT NULL THEN client_id END', o)} AS {c}_from" for c, o in orders.items())
    blank = lambda c: rf"CASE WHEN NOT regexp_full_match({c}, '[\x20\x09-\x0D]*') THEN {c} END AS {c}"
    place = f"((city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT) DESC, {recent}"
    return f"""
WITH r AS (
  SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at, nation_id,
         CASE source WHEN 'crm' THEN 0 WHEN 'web' THEN 1 WHEN 'store' THEN 2 WHEN 'partner' THEN 3 ELSE 4 END AS trust,
         {blank('name')}, {blank('email')}, {blank('city')}, {blank('segment')}, CASE WHEN isfinite(balance) THEN balance END AS balance
  FROM clients
), s AS (
  SELECT *, updated_at IS NULL OR updated_at < max(updated_at) OVER (PARTITION BY cluster_id) - INTERVAL 1440 HOUR AS stale,
         {first('segment', recent)} AS chosen
  FROM r
), a AS (SELECT *, coalesce(segment = chosen, false) AS agrees FROM s
), w AS (
  SELECT cluster_id, count(*) OVER p AS n_records, count(*) FILTER (stale) OVER p AS n_stale, {fields},
         {first('city', place, '')} AS city, {first('nation_id', place, '')} AS nation_id, {first('client_id', place, '')} AS place_from,
         row_number() OVER (PARTITION BY cluster_id) AS n
  FROM a WINDOW p AS (PARTITION BY cluster_id)
)
SELECT cluster_id, n_records, n_stale, w_name AS name, w_email AS email, w_segment AS segment, city, nation_id,
       CAST(floor(100 * w_balance + 0.5) AS BIGINT) AS balance_cents, name_from, email_from, segment_from, balance_from,
       CASE WHEN city IS NOT NULL OR nation_id IS NOT NULL THEN place_from END AS address_from
FROM w WHERE n = 1
"""


#: Rebuilt conversations; nodes by the list of their turns' hashes, subtrees by what starts with it. CRC-32 bit by bit.
OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT conv_id, sha256(length(role) || ':' || role || text) AS mark, strlen(text) AS bytes,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos
  FROM t
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
           lambda a, b: list_reduce(range(8), lambda u, k: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END, xor(a, b)), 4294967295), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM n)
), r AS (
  SELECT c.conv_id, n.pos, mark, bytes FROM c JOIN n ON n.conv_id = c.base AND n.pos <= c.h
  UNION ALL SELECT conv_id, n.pos + 8, mark, bytes FROM c JOIN n USING (conv_id) WHERE n.pos > c.h
), p AS (
  SELECT conv_id, row_number() OVER w AS depth, bytes, string_agg(mark, '') OVER w AS path
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), e AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
nodes AS (
  SELECT path, min(p.conv_id) AS conv_id, max(p.depth) AS depth, count(*) AS n_convs, max(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (e.depth = p.depth), '')) AS ends_sha256
  FROM p JOIN e USING (conv_id) GROUP BY path
), k AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM nodes WHERE path <> '' GROUP BY 1),
m AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN k USING (path)),
s AS (
  SELECT v.path, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved_tokens
  FROM m v JOIN m u ON starts_with(u.path, v.path) GROUP BY v.path
)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s USING (path) LEFT JOIN nodes up ON m.path <> '' AND up.path = left(m.path, length(m.path) - 64)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filter": _op8_sql(), "op9_substring_dedup": OP9_SQL, "op10_vector_neardup": OP10_SQL, "op11_golden_record": _op11_sql(), "op13_prefix_trie": OP13_SQL}
