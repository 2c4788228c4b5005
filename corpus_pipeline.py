"""Corpus cleaning in five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads it back from Parquet. All
but the last return the columns of `documents`; the last returns the token digests of what was kept.

Defined cases, in all stages: null text counts as empty; rows are told apart by themselves, so null and repeated ids
lose no row; an empty table gives an empty result; other columns, whatever their names, are kept (the last stage
leaves them out). Which rows go when they tie is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from stratalog.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, by a model of the labelled ones among them. Repeated rows get one score each, the same; without labels of both kinds all stay."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the least id (nulls last), of equal ids the first in input order."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash neighbours, that of the least id (nulls last), of equal ids the first in input order. Texts without words are neighbours of one another."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items; an empty benchmark contaminates none. Repeated rows go or stay together."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document kept: one row each, repeated ones included."""
    return bpe.bpe_encode(docs, bpe.default_vocabulary(), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("bpe", tokenize),
]

#: SQL has no Levenshtein automata, fitted model, SimHash or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
