"""The training-data queries, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import chat, embeddings, lines, mixing, packing, pii, quality, simhash, substrings, token_counts
from tidewell.llm.common import Written, word_count

#: Folder of public vocabulary files.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


#: Key of the pseudonyms where PSEUDONYM_KEY names none: for tests, as it is no secret.
TEST_KEY = "set-a-secret-key"


def vocabulary(name: str) -> str:
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "lines.*")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_near_dedup(table(spark, sf_dir, "embeddings"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digests(chat.format_chats(rows.unionByName(more)))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_dedup(table(spark, sf_dir, "documents"))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = os.environ.get("PSEUDONYM_KEY")
    if not key:
        logging.getLogger(__name__).warning("PSEUDONYM_KEY is not set: pseudonyms are made with a key that is no secret")
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key or TEST_KEY).select("doc_id", "text", "private.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.quality_rules(docs.select("doc_id", "text"), model).select("doc_id", "quality.*")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = Written(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words")), "sized").df
    return mixing.mix_sources(sized, size=F.col("words")).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counted part of the quality rules, which has an SQL form."""
    model = quality.Model([0.0] * (1 << 14), float("-inf"))
    rules = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return rules.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of the mix, which have an SQL form."""
    return op10_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


OPERATORS = (op1_line_dedup, op2_embedding_near_dedup, op3_chat_formatting, op4_substring_dedup, op5_simhash_near_dedup, op6_pii_pseudonyms, op7_quality_rules, op8_best_fit_packing, op9_token_counts, op10_source_mixing)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (*OPERATORS, quality_counts, mixing_targets)}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
 reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, min(r.b) AS component_id, min(r.b) = e.vec_id AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id""",
    "op3_chat_formatting": """
WITH t AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM t),
m AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY n) IS DISTINCT FROM role AS starts,
 length(replace(replace(text, chr(92), chr(92) || 'b'), '<|', '<' || chr(92) || 'p')) AS chars,
 length(replace(replace(replace(role, chr(92), chr(92) || 'b'), '<|', '<' || chr(92) || 'p'), chr(10), chr(92) || 'n')) AS role_chars FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 sum(chars + CASE WHEN starts THEN length('<|im_start|>') + role_chars + 1 + length('<|im_end|>') + 1 ELSE length('<|im_sep|>') END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id""",
    "op4_substring_dedup": f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w)),
f AS (SELECT win, min(doc_id) AS first FROM s GROUP BY win),
c AS (SELECT DISTINCT s.doc_id, s.i + r.k AS at FROM s JOIN f ON s.win = f.win AND f.first < s.doc_id CROSS JOIN range(0, 13) r(k)),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS at FROM w),
k AS (SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p.at) AS kept FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.at = c.at GROUP BY p.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
    "quality_counts": rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w)),
f AS (SELECT doc_id, win FROM s GROUP BY doc_id, win HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM s JOIN f USING (doc_id, win) CROSS JOIN range(0, 8) t(k) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c""",
    # ten rounds of resharing excess are more than the tables' sources need
    "mixing_targets": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({WORDS}) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w FROM d GROUP BY source),
t AS (SELECT 0 AS n, source, source_size, w, (sum(source_size) OVER ())::DOUBLE * w / sum(w) OVER () AS target FROM s
 UNION ALL
 SELECT n + 1, source, source_size, w, CASE WHEN target >= 3 * source_size THEN 3 * source_size::DOUBLE
  ELSE ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(CASE WHEN target >= 3 * source_size THEN 3 * source_size END) OVER (), 0)) * w / sum(CASE WHEN target < 3 * source_size THEN w END) OVER () END
 FROM t WHERE n < 10)
SELECT d.doc_id, d.size, t.source_size, round(t.target, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source AND t.n = 10""",
}
