"""Documents to token ids: quality rules, near-duplicates, decontamination, mixing, token store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import decontaminate, mixing, repetition
from weftgraph.llm._common import stage, table, workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the repetition rule reject go."""
    return repetition.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id."""
    from weftgraph.llm import jaccard_join

    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token store and give each document's place, length and checksum in it."""
    import public_tokenizers

    from weftgraph.llm.token_store import verify, write_store

    path = workspace(spark, "pipeline-store")
    write_store(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return verify(spark, path)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("token_store", token_ids),
]
#: Suffix arrays, a randomised join and a tokenizer: none of it is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
