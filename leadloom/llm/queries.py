"""Registered queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import bpe_index, exact_dedup, language_id, mixing, multiset_hash, ngram_join, page_diff, quality_crf, source_audit, substring_dedup, suffix_repeats, token_counts, whitening
from leadloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_crf.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_multiset_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return multiset_hash.compared(table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar(table(spark, folder, "documents"))


def op5_language_codes(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"), keep="largest")


def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_index.encode_decode(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op9_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents"), digests=True)


def op10_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_diff.extract(table(spark, folder, "pages"))


def op11_source_audit(spark: SparkSession, folder: str) -> DataFrame:
    return source_audit.audit(table(spark, folder, "documents"))


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op13_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_repeats.remove_repeats(table(spark, folder, "documents"), digests=True)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_line_quality, op2_multiset_fingerprints, op3_token_counts, op4_shingle_join, op5_language_codes, op6_exact_dedup, op7_source_mix,
    op8_bpe_round_trip, op9_repeated_passages, op10_page_text, op11_source_audit, op12_embedding_whitening, op13_suffix_repeats,
)}

OP6_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP11_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
    SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 3
), langs AS (
    SELECT lang, count(*) AS v, sum(total) AS n_lang FROM kept GROUP BY lang
), counts AS (
    SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
    SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts USING (lang, source) GROUP BY ALL
), shares AS (
    SELECT g.lang, g.source, term, coalesce(c, 0) AS c,
           1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (n + v) AS p, 1 + (1000000000::HUGEINT * (total + 1)) // (n_lang + v) AS q
    FROM groups g JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
), values_ AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    UNION ALL
    SELECT a.lang, a.source, 'pair', b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM langs)
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE c > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM values_
)
SELECT lang, source, part, item, value::BIGINT AS value, place::INTEGER AS rank FROM ranked WHERE part = 'pair' OR place <= 200
"""

ORACLE: dict[str, str] = {"op6_exact_dedup": OP6_SQL, "op11_source_audit": OP11_SQL}
