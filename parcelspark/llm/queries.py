"""The registered queries of the training-text operators and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contamination
from .importance import importance_draw
from .line_spread import without_boilerplate
from .near_passages import near_duplicate_passages
from .packing import pack
from .preference import format_preferences, swapped_replies
from .quality_rules import judged
from .repeated_bytes import without_repeats
from .simhash import near_duplicates
from .token_alignment import cross_tokenizer_links
from .token_counts import count_tokens
from .url_rules import judge_urls
from .vector_search import exact_top_k

# the rules of the url query: host, path, verdict
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


def op1_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = format_preferences(*swapped_replies(table(spark, sf_dir, "conversations")))

    def trained(c: str):
        return F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])

    return made.select(
        "pair_id", "n_prompt_turns", F.sha2("prompt", 256).alias("prompt_sha256"), F.sha2("chosen", 256).alias("chosen_sha256"),
        F.sha2("rejected", 256).alias("rejected_sha256"), F.length("prompt").cast("long").alias("prompt_chars"),
        F.length("chosen").cast("long").alias("chosen_chars"), F.length("rejected").cast("long").alias("rejected_chars"),
        trained("chosen_mask").alias("chosen_trained"), trained("rejected_mask").alias("rejected_trained"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept").withColumn("repeated", F.col("n_removed") > 0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = without_boilerplate(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", F.col("_removed").alias("n_removed_lines"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_bytes"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    s = F.col("_stats")
    return made.select(
        "doc_id", *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_passages(table(spark, sf_dir, "documents")).withColumn("passages", F.col("passages").cast("string"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer_links(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = importance_draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return made.select("doc_id", "n_features", "weight", "score", "rank")


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    f.__name__: f for f in (
        op1_preference_pairs, op2_suffix_dedup, op3_token_counts, op4_line_dedup, op5_decontamination, op6_simhash, op7_quality_rules,
        op8_packing, op9_url_rules, op10_substring_dedup, op11_token_alignment, op12_importance_draw,
        op13_exact_search)
}

ORACLE: dict[str, str] = {}

ORACLE["op9_url_rules"] = """
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT page_id, host, path, rh || rp AS rule, rv,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m WHERE n = 1
"""

ORACLE["op1_preference_pairs"] = """
WITH last_reply AS (
  SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS reply FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
swaps AS (
  SELECT a.conv_id, a.last_turn, b.reply FROM last_reply a JOIN last_reply b ON b.conv_id = xor(a.conv_id, 1)),
t AS (
  SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn, c.role, c.text) AS n, c.role, c.text AS good,
         CASE WHEN c.role = 'assistant' AND c.turn = s.last_turn THEN s.reply ELSE c.text END AS bad
  FROM conversations c LEFT JOIN swaps s USING (conv_id)),
p AS (
  SELECT conv_id, coalesce(min(CASE WHEN good <> bad THEN n END) - 1, count(*)) AS prefix FROM t GROUP BY conv_id),
r AS (
  SELECT t.conv_id, n, prefix, role, '<|' || role || '|>' || chr(10) || good || chr(10) AS g, '<|' || role || '|>' || chr(10) || bad || chr(10) AS b,
         CASE WHEN role = 'assistant' THEN length(good) + 1 ELSE 0 END AS gt, CASE WHEN role = 'assistant' THEN length(bad) + 1 ELSE 0 END AS bt
  FROM t JOIN p USING (conv_id)),
s AS (
  SELECT conv_id AS pair_id, max(prefix) AS n_prompt_turns,
         coalesce(string_agg(CASE WHEN n <= prefix THEN g END, '' ORDER BY n), '') AS prompt,
         coalesce(string_agg(CASE WHEN n > prefix THEN g END, '' ORDER BY n), '') AS chosen,
         coalesce(string_agg(CASE WHEN n > prefix THEN b END, '' ORDER BY n), '') AS rejected,
         sum(CASE WHEN n > prefix THEN gt ELSE 0 END) AS gt, sum(CASE WHEN n > prefix THEN bt ELSE 0 END) AS bt
  FROM r GROUP BY conv_id)
SELECT pair_id, n_prompt_turns, sha256(prompt) AS prompt_sha256, sha256(chosen) AS chosen_sha256, sha256(rejected) AS rejected_sha256,
       length(prompt) AS prompt_chars, length(chosen) AS chosen_chars, length(rejected) AS rejected_chars,
       gt::BIGINT AS chosen_trained, bt::BIGINT AS rejected_trained
FROM s
"""

ORACLE["op5_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, k, dw.size, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.size = iw.size),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM (SELECT DISTINCT doc_id, k, size FROM hits)) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLE["op4_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, source, pos, raw, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
               unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents)),
b AS (
  SELECT line, min((doc_id, pos)) AS first FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
m AS (
  SELECT l.doc_id, l.pos, l.raw, b.line IS NOT NULL AND (l.doc_id, l.pos) <> b.first AS gone FROM l LEFT JOIN b USING (line)),
t AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed_lines,
         coalesce(string_agg(CASE WHEN NOT gone THEN raw END, chr(10) ORDER BY pos), '') AS kept
  FROM m GROUP BY doc_id)
SELECT doc_id, n_removed_lines, strlen(kept)::BIGINT AS kept_bytes, sha256(kept) AS kept_sha256 FROM t
"""

ORACLE["op13_exact_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
