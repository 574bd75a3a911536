"""From raw documents to token files: five stages, each on all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parflow.llm import decontaminate, mixing, near_dedup, token_files, toxicity
from parflow.llm.common import delete, materialise, table
from parflow.llm.queries import tokenizer
from parflow.session import ship


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network marks as toxic go. It learns from labelled rows among ``docs``.

    A null text is judged as an empty one, each of several rows of an id by itself; without usable labels all have one score, below
    the threshold, and stay. An empty table stays empty."""
    return toxicity.accepted(docs, table(ship(spark), sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more.

    That of the smallest doc_id; of several rows of an id the one with the smallest text. Texts without words, null ones among
    them, are nobody's duplicates; rows without a doc_id stay."""
    return near_dedup.deduplicated(ship(spark) and docs, 80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row by its own text; null texts hold none, null items are not looked for."""
    return decontaminate.decontaminated(docs, table(ship(spark), sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at target weights: each document as often as the mix takes it.

    A null source is a source of its own. Texts without words take no words, and are there as often as others of their source."""
    return mixing.mixed_documents(ship(spark) and docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary records, read back: one row each, in order of doc_id, null first; a null text is the end id alone."""
    return token_files.token_files(ship(spark) and docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]
#: SQL cannot express a trained network, so none; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it; what a written stage has read
    is deleted, so two copies of the corpus are there at most. The last stage reads files of its own."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            after = materialise(after, name)
        if k:
            delete(docs)
        docs = after
    return docs
