"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import chat, decontaminate, exact_dedup, html, mixing, near_join, quality, sharding, substrings, toxicity
from marlstone.llm.session import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.linked(read(spark, sf_dir, "documents"), words=4, percent=85)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents")).read().select("doc_id", "shard")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.cut(read(spark, sf_dir, "documents")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.flag(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_pairs(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_html_extraction, op2_quality, op3_jaccard_join, op4_sharding, op5_substring_dedup, op6_exact_dedup, op7_mixing, op8_toxicity, op9_decontamination, op10_chat_formatting)}

_OP6 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm,
         row_number() OVER (ORDER BY doc_id) AS line
  FROM documents
), g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER w = 1 AS kept
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST, line
                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM g
"""

_OP10 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, turn >> 10 AS block,
         row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(role, ''), coalesce(text, '')) AS occ,
         conv_id >> 1 AS pair_id, conv_id & 1 AS side,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS segment
  FROM conversations
), k AS (
  SELECT *, {'n': turn IS NULL, 't': coalesce(turn, 0), 'o': occ} AS pos, (occ - 1) >> 10 AS piece FROM t WHERE conv_id IS NOT NULL
), m AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pos, b.pos) AS pos, a.pair_id AS ap, b.pair_id AS bp, a.role = b.role AND a.text = b.text AS same
  FROM (SELECT * FROM k WHERE side = 0) a FULL JOIN (SELECT * FROM k WHERE side = 1) b ON a.pair_id = b.pair_id AND a.pos = b.pos
), c AS (
  SELECT pair_id, count(ap) > 0 AND count(bp) > 0 AS paired, min(CASE WHEN same THEN NULL ELSE pos END) AS cut FROM m GROUP BY pair_id
), r AS (
  SELECT k.*, c.paired, CASE WHEN c.paired AND (c.cut IS NULL OR k.pos < c.cut) THEN 'prompt' WHEN k.side = 0 THEN 'chosen' ELSE 'rejected' END AS part
  FROM k JOIN c ON k.pair_id = c.pair_id
), o AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY pair_id, block, piece, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
         paired AND role = 'assistant' AS trained
  FROM r WHERE NOT (part = 'prompt' AND side = 1)
), s AS (
  SELECT *, CAST(ahead + length(role) + 13 AS BIGINT) || ':' || CAST(ahead + length(segment) AS BIGINT) AS span FROM o
)
SELECT pair_id, 2 * pair_id AS chosen_id, 2 * pair_id + 1 AS rejected_id, bool_and(paired) AS paired, block, piece,
       count(*) FILTER (part = 'prompt') AS prompt_turns,
       coalesce(string_agg(segment, '' ORDER BY pos) FILTER (part = 'prompt'), '') AS prompt,
       coalesce(string_agg(segment, '' ORDER BY pos) FILTER (part = 'chosen'), '') AS chosen,
       coalesce(string_agg(segment, '' ORDER BY pos) FILTER (part = 'rejected'), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY pos) FILTER (part = 'chosen' AND trained), '') AS chosen_mask,
       coalesce(string_agg(span, ',' ORDER BY pos) FILTER (part = 'rejected' AND trained), '') AS rejected_mask
FROM s GROUP BY pair_id, block, piece
UNION ALL
SELECT NULL, NULL, NULL, false, block, 0, 0, '', segment, '', '', '' FROM t WHERE conv_id IS NULL
"""

ORACLE_SQL: dict[str, str] = {"op6_exact_dedup": _OP6, "op10_chat_formatting": _OP10}
