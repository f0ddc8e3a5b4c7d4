"""The queries ``op1`` to ``op10``, each one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from tideline.llm import bpe, embedding, html_text, language, packing, pii, preference, substrings
from tideline.llm.common import table
from tideline.llm.exact_dedup import text_groups
from tideline.llm.simhash import simhash_components

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_groups(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_digests(table(spark, sf_dir, "documents"))


def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preference_pairs(*preference.swapped_answers(table(spark, sf_dir, "conversations")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "op1_embedding": op1_embedding,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_simhash": op3_simhash,
    "op4_language": op4_language,
    "op5_bpe": op5_bpe,
    "op6_substrings": op6_substrings,
    "op7_preference": op7_preference,
    "op8_packing": op8_packing,
    "op9_pii": op9_pii,
    "op10_html": op10_html,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (
            SELECT vec_id AS a, vec_id AS b FROM v
            UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
        SELECT r.a AS vec_id, coalesce(any_value(n.n_links), 0) AS n_links,
               min(r.b) AS component_id, r.a = min(r.b) AS kept
        FROM reach r LEFT JOIN n ON n.a = r.a GROUP BY r.a""",
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op7_preference": """
        WITH c AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id >= 0),
        z AS (SELECT conv_id, max(turn) AS last_turn FROM c WHERE role = 'assistant' GROUP BY conv_id),
        said AS (
            SELECT conv_id, last_turn, max(coalesce(text, '')) AS said FROM c JOIN z USING (conv_id)
            WHERE role = 'assistant' AND turn = last_turn GROUP BY conv_id, last_turn),
        swap AS (SELECT a.conv_id, a.last_turn, b.said AS other FROM said a JOIN said b ON b.conv_id = xor(a.conv_id, 1)),
        sides AS (
            SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM c
            UNION ALL SELECT conv_id, 1, turn, role, CASE WHEN role = 'assistant' AND turn = last_turn THEN other ELSE text END
            FROM c JOIN swap USING (conv_id)),
        t AS (
            SELECT pair_id, side, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS pos FROM sides),
        same AS (
            SELECT pair_id, pos, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same
            FROM t GROUP BY pair_id, pos),
        parted AS (
            SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN pos END), max(pos) + 1) AS parts
            FROM same GROUP BY pair_id),
        p AS (
            SELECT t.*, parts, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown,
                   CASE WHEN pos < parts THEN CASE WHEN side = 0 THEN 2 END ELSE side END AS part
            FROM t JOIN parted USING (pair_id)),
        s AS (
            SELECT *, (coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, part ORDER BY pos
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 13)::BIGINT AS start
            FROM p WHERE part IS NOT NULL),
        m AS (SELECT *, CASE WHEN role = 'assistant' THEN start || ':' || (start + length(text)) END AS span FROM s)
        SELECT pair_id, pair_id AS chosen_id, CASE WHEN pair_id IN (SELECT conv_id FROM swap) THEN -1 - pair_id END AS rejected_id,
               max(parts) - 1 AS n_prompt_turns,
               coalesce(string_agg(CASE WHEN part = 2 THEN shown END, '' ORDER BY pos), '') AS prompt,
               coalesce(string_agg(CASE WHEN part = 0 THEN shown END, '' ORDER BY pos), '') AS chosen,
               coalesce(string_agg(CASE WHEN part = 1 THEN shown END, '' ORDER BY pos), '') AS rejected,
               coalesce(string_agg(CASE WHEN part = 0 THEN span END, ',' ORDER BY pos), '') AS chosen_mask,
               coalesce(string_agg(CASE WHEN part = 1 THEN span END, ',' ORDER BY pos), '') AS rejected_mask
        FROM m GROUP BY pair_id""",
}
