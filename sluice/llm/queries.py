"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sluice.llm import chat_format, divergence, fingerprints, license_scan, line_dedup, mixing, near_dedup, packing, piece_codec, quality_classifier, quality_rules, spelling, token_counts
from sluice.llm.common import ship, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after edits made of its own text."""
    return token_counts.count_edited(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence places and labels of every document."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op4_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return piece_codec.encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stay in each document."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and the forest's verdict for every document."""
    return quality_rules.rule_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, with one whose texts are control strings."""
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.conversation_report(given.unionByName(extra))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked at a similarity of 0.8 of their two-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document, of its edited text, and their likeness to it and the next one's."""
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the forms that they are variants of."""
    return spelling.variant_report(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's words lie from those of the other sources of its language."""
    return divergence.divergence_report(table(spark, sf_dir, "documents"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of every document."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


_ALL = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_license_scan": op3_license_scan,
    "op4_sentencepiece_codec": op4_sentencepiece_codec,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_source_divergence": op12_source_divergence,
    "op13_source_mixing": op13_source_mixing,
}

QUERIES = {name: _shipped(query) for name, query in _ALL.items()}

ORACLE_SQL = {
    "op3_license_scan": license_scan.oracle(),
    "op11_spelling_variants": spelling.oracle(),
    "op12_source_divergence": divergence.oracle(),
    "op7_chat_formatting": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        escaped AS (
            SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS safe,
                regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\1\\|', 'g') AS name FROM rows)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length('<|im_start|>') + length(name) + 1 + length(safe) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
        FROM escaped GROUP BY conv_id""",
    "op5_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
                  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
        common AS (
            SELECT key, max(doc_id) AS max_doc FROM lines WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (
            SELECT l.doc_id, l.pos, l.line, c.key IS NULL OR c.max_doc = l.doc_id AS stays
            FROM lines l LEFT JOIN common c ON l.key = c.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
}
