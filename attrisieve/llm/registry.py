"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc, chat, decontaminate, licences, lm, mih, negatives, packing, simhash, tokencount, toxicity, urlrules, whitening
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_causal_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_viterbi_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op4_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "alias_of")


OP6_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, coalesce(html, '') AS html,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages
), q AS (
  SELECT page_id, url, html,
         coalesce(translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_extract(url, '(?s)^[^:/?#]*://([^#]*)', 1) AS bare
  FROM p
), k AS (
  SELECT *, CASE WHEN regexp_extract(bare, '(?s)^([^/?]*)', 1) <> '' THEN
           translate(regexp_extract(bare, '(?s)^([^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
           || CASE WHEN regexp_extract(bare, '(?s)^[^/?]*(.*)$', 1)[1] = '/' THEN '' ELSE '/' END
           || regexp_extract(bare, '(?s)^[^/?]*(.*)$', 1) END AS key,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM q
), own AS (
  SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said FROM k
), tags AS (
  SELECT key, url, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?(?:-->|$)', '', 'g'), '(?is)<(?:link|meta)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS tag FROM own WHERE key IS NOT NULL
), raw AS (
  SELECT key, url, regexp_matches(tag, '(?i)^<link') AS is_link,
         regexp_extract(tag, '(?is)[\s"''/]rel\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', ['a', 'b', 'c']) AS rel,
         regexp_extract(tag, '(?is)[\s"''/]href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', ['a', 'b', 'c']) AS href,
         regexp_extract(tag, '(?is)[\s"''/]http-equiv\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', ['a', 'b', 'c']) AS equiv,
         regexp_extract(tag, '(?is)[\s"''/]content\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', ['a', 'b', 'c']) AS content
  FROM tags
), said_by AS (
  SELECT key, url, is_link, lower(trim(rel.a || rel.b || rel.c)) AS rel, lower(trim(equiv.a || equiv.b || equiv.c)) AS equiv,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(href.a || href.b || href.c, '&quot;|&#34;|&#x22;', '"', 'gi'), '&#39;|&#x27;|&apos;', '''', 'gi'), '&lt;|&#60;|&#x3c;', '<', 'gi'), '&gt;|&#62;|&#x3e;', '>', 'gi'), '&amp;|&#38;|&#x26;', '&', 'gi') AS href,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content.a || content.b || content.c, '&quot;|&#34;|&#x22;', '"', 'gi'), '&#39;|&#x27;|&apos;', '''', 'gi'), '&lt;|&#60;|&#x3c;', '<', 'gi'), '&gt;|&#62;|&#x3e;', '>', 'gi'), '&amp;|&#38;|&#x26;', '&', 'gi') AS content
  FROM raw
), aims AS (
  SELECT key, url, trim(regexp_replace(CASE WHEN is_link AND regexp_matches(rel, '(?:^|\s)canonical(?:\s|$)') THEN href
         WHEN NOT is_link AND equiv = 'refresh' THEN regexp_extract(content, '(?is)^[\s\d.]*[;,]?\s*url\s*=\s*["'']?\s*([^"'']*)', 1) END, '[\t\n\f\r]', ' ', 'g')) AS aim,
         regexp_extract(url, '(?s)^([^:/?#]*://[^/?#]*)', 1) AS origin, regexp_extract(url, '(?s)^([^:/?#]*:)//', 1) AS scheme,
         regexp_extract(url, '(?s)^([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)', 1) AS folder
  FROM said_by
), links AS (
  SELECT key, CASE WHEN regexp_matches(aim, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN aim WHEN starts_with(aim, '//') THEN scheme || aim
         WHEN starts_with(aim, '/') THEN origin || aim ELSE folder || CASE WHEN ends_with(folder, '/') THEN '' ELSE '/' END || aim END AS target
  FROM aims WHERE aim <> ''
), bare_links AS (
  SELECT key, regexp_extract(target, '(?s)^[^:/?#]*://([^#]*)', 1) AS bare FROM links
), edges AS (
  SELECT key AS a, translate(regexp_extract(bare, '(?s)^([^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
         || CASE WHEN regexp_extract(bare, '(?s)^[^/?]*(.*)$', 1)[1] = '/' THEN '' ELSE '/' END || regexp_extract(bare, '(?s)^[^/?]*(.*)$', 1) AS b
  FROM bare_links WHERE regexp_extract(bare, '(?s)^([^/?]*)', 1) <> ''
),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.other = w.a),
roots AS (SELECT node, min(other) AS alias_of FROM reach GROUP BY node),
votes AS (SELECT alias_of, bool_or(said = 'allow') AS allowed, bool_or(said = 'block') AS blocked FROM own JOIN roots ON own.key = roots.node GROUP BY alias_of)
SELECT page_id, host, path, rule,
       coalesce(said, CASE WHEN blocked AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END) AS verdict, roots.alias_of
FROM own LEFT JOIN roots ON own.key = roots.node LEFT JOIN votes ON votes.alias_of = roots.alias_of
"""


def op7_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = mih.codes(table(spark, sf_dir, "embeddings"))
    return mih.top_k(coded, coded.where(F.col("id") % 50 == 0)).select("query_id", F.col("id").alias("vec_id"), "distance", F.col("rank").cast("bigint").alias("rank"))


OP7_SQL = """
WITH c AS (
  SELECT vec_id, list_transform(range(1, 65), lambda i: coalesce(embedding[i], 0) > 0 AND NOT isnan(coalesce(embedding[i], 0))) AS bits FROM embeddings WHERE embedding IS NOT NULL
), h AS (
  SELECT vec_id,
         CAST(list_sum(list_transform(range(1, 33), lambda i: CASE WHEN bits[i] THEN 1::BIGINT << (i - 1) ELSE 0::BIGINT END)) AS BIGINT) AS lo,
         CAST(list_sum(list_transform(range(33, 65), lambda i: CASE WHEN bits[i] THEN 1::BIGINT << (i - 33) ELSE 0::BIGINT END)) AS BIGINT) AS hi
  FROM c
), d AS (
  SELECT q.vec_id AS query_id, b.vec_id, CAST(bit_count(xor(q.lo, b.lo)) + bit_count(xor(q.hi, b.hi)) AS INTEGER) AS distance
  FROM h q JOIN h b ON q.vec_id % 50 = 0
)
SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
FROM d QUALIFY rank <= 10
"""


def op8_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op9_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP10_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n,
         sha256(coalesce(html, '')) AS h
  FROM pages
), f AS (SELECT h, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY h)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.h AS payload_digest,
       CASE WHEN p.n >= 100 AND p.page_id <> f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.n >= 100 AND p.page_id <> f.first_id THEN f.first_id END AS refers_to, p.url
FROM p LEFT JOIN f ON p.h = f.h AND p.n >= 100
"""


def op11_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("bigint"))


def op12_bit_sliced_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(negatives.shifted(table(spark, sf_dir, "embeddings")))


OP12_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND n.label <> n.own AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""


def op13_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline,
        "op1_greedy_tiling": op1_greedy_tiling,
        "op2_causal_attention": op2_causal_attention,
        "op3_viterbi_turns": op3_viterbi_turns,
        "op4_licence_sentences": op4_licence_sentences,
        "op5_minimum_bin_slack": op5_minimum_bin_slack,
        "op6_redirect_equivalence": op6_redirect_equivalence,
        "op7_multi_index_hashing": op7_multi_index_hashing,
        "op8_simhash_bktree": op8_simhash_bktree,
        "op9_classifier_chain": op9_classifier_chain,
        "op10_arc_to_warc": op10_arc_to_warc,
        "op11_svd_whitening": op11_svd_whitening,
        "op12_bit_sliced_negatives": op12_bit_sliced_negatives,
        "op13_transducer_counts": op13_transducer_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_licence_sentences": licences.oracle_sql(), "op6_redirect_equivalence": OP6_SQL, "op7_multi_index_hashing": OP7_SQL, "op10_arc_to_warc": OP10_SQL, "op12_bit_sliced_negatives": OP12_SQL}
