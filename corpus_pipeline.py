"""Corpus pipeline: language ID, near-dedup, decontamination, source mixing, sharding."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import contain, langid, mixing, shards, simhash
from riskloom.session import shared_folder

#: Documents whose language is undetermined, or whose pooled probability is below this, are rejected.
LEAST_LANGUAGE_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised; the model learns from the labelled rows of its input.

    An input without labelled rows teaches nothing, so all of it stays.
    """
    names = docs.columns
    model = langid.train(docs)
    if model is None:
        return docs
    found = langid.predict(docs, model)
    return found.filter((found["lang_pred"] != langid.UNDETERMINED) & (found["score"] >= LEAST_LANGUAGE_SCORE)).select(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every SimHash component, the one with the smallest doc_id."""
    return simhash.keep_one(docs, shingle=3, distance=2)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    return contain.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources meet their target weights; copies are rows of their own."""
    return mixing.replicate(docs, mixing.rates(docs)).select(*docs.columns)


def make_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot."""
    return shards.shard(docs, shards=24)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("source_mixing", mix_sources),
    ("sharding", make_shards),
]

#: Trained networks and XXH64 fingerprints have no SQL form; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
