"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated passages are cut, documents
that hold benchmark items go, and what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloudloom.llm import decontaminate, jaccard, packing, substrings, toxicity
from cloudloom.plans.order import cut, recording, remove


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.drop_passages(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
ORACLE_SQL = None  # alignment, chaining and packing are not SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written to the shared folder before the next reads it.

    A run deletes its own tables once the stage that reads them is written; a stage called alone leaves its tables, as its result reads them.
    """
    docs, done = _table(spark, sf_dir, "documents"), []
    for _, step in STAGES[:-1]:
        with recording() as made:
            docs = cut(step(spark, docs, sf_dir))
        remove(spark, *done, *made[:-1])  # the last table is the result, which needs no other
        done = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
