"""The registered queries of this package: thin callables over the operators, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, conversations, embeddings, fingerprints, html, language, mixing, neardups, packing, pii, scoring, secrets, substrings
from .common import read_table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(read_table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(read_table(spark, sf_dir, "documents"))


def op3_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardups.near_duplicate_report(read_table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op6_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_report(read_table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(read_table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text_report(read_table(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(read_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(read_table(spark, sf_dir, "conversations"))


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scoring_report(read_table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_fingerprints": op2_fingerprints,
        "op3_repeated_strings": op3_repeated_strings,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_source_mix": op5_source_mix,
        "op6_embedding_links": op6_embedding_links,
        "op7_packing": op7_packing,
        "op8_pii": op8_pii,
        "op9_html_text": op9_html_text,
        "op10_language": op10_language,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_lm_score": op12_lm_score,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_source_mix": mixing.ORACLE_SQL}
