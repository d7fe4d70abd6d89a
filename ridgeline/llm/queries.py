"""Queries of the corpus operators, with their parameters, and their SQL."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import workspace
from . import decontaminate, lm_scoring, packing, pieces, prefix_trie, quality_rules, simhash, substring_dedup, suffix_array_dedup, token_binary, token_counts, toxicity, vector_codes
from .common import ship, table


def _tokenizers():
    import public_tokenizers

    return public_tokenizers


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(spark, sf_dir)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace.new_path(spark, "token-shards")
    token_binary.write_shards(table(spark, sf_dir, "documents"), path, _tokenizers().path("word_bpe_49k.json"), end_id=2, vocabulary=49_408)
    return token_binary.read_documents(spark, path)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_report(table(spark, sf_dir, "documents"), uuid.uuid4().hex)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_report(table(spark, sf_dir, "documents"), _tokenizers().path("piece_bpe_32k.model"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_report(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(table(spark, sf_dir, "documents"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup.suffix_array_report(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokenizers()
    lengths = token_counts.token_lengths(table(spark, sf_dir, "documents"), t.path("byte_bpe_50k.tiktoken"), t.PATTERN)
    return token_counts.length_table(lengths)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_report(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokenizers()
    return packing.piece_report(packing.sequences(table(spark, sf_dir, "documents"), t.path("byte_bpe_50k.json"), t.PATTERN))


def _shipped(query: Callable) -> Callable:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable]:
    return {k: _shipped(f) for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.SQL.replace("{documents}", "documents"),
        "op2_quality_rules": quality_rules.SQL.replace("{documents}", "documents").replace("{floor}", str(quality_rules.FLOOR)).replace("{spread}", str(quality_rules.SPREAD)),
        "op6_substring_dedup": substring_dedup.SQL.replace("{documents}", "documents"),
        "op8_suffix_array": suffix_array_dedup.SQL.replace("{documents}", "documents"),
        "op11_prefix_trie": prefix_trie.SQL.replace("{conversations}", "conversations"),
        "op12_vector_codes": vector_codes.SQL.replace("{embeddings}", "embeddings"),
    }
