"""The queries of this subpackage, with production parameters, over whole tables; and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html_text, license_scan, media, mixing, near_dedup, token_counts, token_files, toxicity
from .common import materialise, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chats(table(spark, sf_dir, "conversations"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(materialise(media.text_media(table(spark, sf_dir, "documents")), "media"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_token_counts, op3_toxicity, op4_html_text, op5_token_files, op6_near_duplicates, op7_chat_format, op8_media_columns, op9_decontamination, op10_license_scan)}
ORACLES = {"op1_source_mixing": mixing.oracle(), "op6_near_duplicates": near_dedup.ORACLE, "op7_chat_format": chat.ORACLE}
