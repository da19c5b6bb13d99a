"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact_dedup, fill_middle, jaccard_join, language_id, lattice, license_scan, line_dedup, mixing, packing, prefix_trie, surrogates, windows
from ._shared import table


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secret key is a setting of the session; where there is none, a new one is drawn, and only this run's
    surrogates agree with each other."""
    key = spark.conf.get("dendrolake.surrogates.key", None)
    return surrogates.pseudonymise(table(spark, sf_dir, "documents"), key.encode() if key else secrets.token_bytes(32))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_matches(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT -1L AS conv_id, i AS turn, role, '{probe}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(i, role)")
    return chat.digests(turns.unionByName(extra))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.repeated_passages(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(table(spark, sf_dir, "documents"))


def op10_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_license_scan": op2_license_scan,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_source_mixing": op5_source_mixing,
    "op6_language_id": op6_language_id,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_compact_windows": op8_compact_windows,
    "op9_packing": op9_packing,
    "op10_lattice_near_dedup": op10_lattice_near_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_line_dedup": op12_line_dedup,
    "op13_fill_middle": op13_fill_middle,
}

ORACLE: dict[str, str] = {
    "op3_ngram_jaccard_join": jaccard_join.ORACLE, "op4_chat_formatting": chat.ORACLE, "op5_source_mixing": mixing.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE, "op12_line_dedup": line_dedup.ORACLE, "op13_fill_middle": fill_middle.ORACLE,
}
